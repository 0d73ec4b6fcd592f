"""Removal of long repeated passages by a compacted De Bruijn graph of token k-mers.

A window of ``length`` consecutive words is an edge of the graph, from the k-mer of its
first words to that of its last (k is one less than ``length``).

1. Only windows that may repeat become edges: equal windows share their anchor, the
   5-mer in them with the smallest hash, so windows whose anchor is in one document
   only are left out, and so are copies of whole texts (told by their SHA-256).
   Consecutive windows with one anchor are a stretch. Stretches with the same words (told
   by their SHA-256) are settled together; where all stretches of an anchor have the
   same words nothing branches, and the others go on, window by window.
2. Edges that occur in several documents are kept with the coordinates of their source,
   the first document that has them. A k-mer with one such edge in and one out doesn't
   branch; joins on k-mers link the two, and pointer jumping (a join a round, the
   reach doubling each time) compacts every nonbranching path to its first edge.
3. Occurrences behind their source are put together along a path: neighbouring windows
   of a document whose sources are neighbours too are one span with the coordinates
   of one source span.
4. The words of each span and of its source span are fetched from the two texts and
   compared. Hashes only propose; were two to collide, the windows of their edges
   would be grouped by their words instead.

Every word of a verified span is removed. Nothing is removed from null or empty texts.
A null id counts as larger than any other. Rows with one id are parts of one document:
none repeats another, each has its own result row. Other columns are ignored, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajflow.llm import words as W
from trajflow.llm.components import dropped, written

BLOCK_BYTES = 4 << 20
KMER = 5
_LAST = (1 << 63) - 1


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the first smallest of the ``span`` values from each place on, by doubling the reach."""
    best, reach = np.arange(len(values)), 1
    while reach < span:
        step = min(reach, span - reach)
        near, far = best[:-step], best[step:]
        best, reach = np.where(values[far] < values[near], far, near), reach + step
    return best


def stretches(data: np.ndarray, offsets: np.ndarray, length: int):
    """Text, first window, windows and anchor of every run of windows with one anchor."""
    starts, ends, doc = W.bounds(data, offsets)
    hashes = W.word_keys(data, starts, ends)
    begin = np.searchsorted(doc, np.arange(len(offsets) - 1))
    n = len(hashes) - length + 1
    at = np.flatnonzero(doc[:n] == doc[length - 1 :]) if n > 0 else np.empty(0, np.int64)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    k = min(KMER, length)
    kmer = np.zeros(len(hashes) - k + 1, np.uint64)
    where, found = W.windows(hashes, doc, k)
    kmer[where] = found
    anchor = _least(kmer, length - k + 1)[at]
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[at[1:]] != doc[at[:-1]])))
    count = np.diff(np.append(first, len(at)))
    owner = doc[at[first]]
    return owner, at[first] - begin[owner], count, kmer[anchor[first]]


def _scan(docs: DataFrame, length: int, whole: bool) -> DataFrame:
    """Anchors of every document; ``whole`` adds coordinates."""
    names = ["doc", "anchor"] + (["part", "first", "count"] if whole else [])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in W.blocks(batch.column(2), BLOCK_BYTES):
                owner, first, count, anchor = stretches(data, offsets, length)
                take = pa.array(owner)
                columns = [batch.column(0).slice(i, j - i).take(take), pa.array(anchor.view(np.int64))]
                if whole:
                    columns += [
                        batch.column(1).slice(i, j - i).take(take),
                        pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)),
                    ]
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = "doc long, anchor long" + (", part long, first int, count int" if whole else "")
    return docs.select("doc", "part", "text").mapInArrow(scan, fields)


def _asked(batch: pa.RecordBatch, i: int, j: int):
    """Row and fields of each entry of column 3 of rows ``i`` to ``j``."""
    wanted = batch.column(3).slice(i, j - i)
    owner = np.repeat(np.arange(j - i), wanted.value_lengths().to_numpy())
    return owner, wanted.flatten()


def _edges(rows: DataFrame, length: int) -> DataFrame:
    """``src, dst, doc, part, first`` of each wanted window of rows (doc, part, text, wanted: first and count)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in W.blocks(batch.column(2), BLOCK_BYTES):
                starts, ends, doc = W.bounds(data, offsets)
                at, kmer = W.windows(W.word_keys(data, starts, ends), doc, length - 1)
                node = np.zeros(len(starts) + 1, np.uint64)
                node[at] = kmer
                begin = np.searchsorted(doc, np.arange(j - i))
                owner, flat = _asked(batch, i, j)
                first, count = (flat.field(c).to_numpy().astype(np.int64) for c in (0, 1))
                owner, first = np.repeat(owner, count), np.repeat(first, count) + (
                    np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                )
                place, take = begin[owner] + first, pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node[place].view(np.int64)), pa.array(node[place + 1].view(np.int64)),
                        *(batch.column(c).slice(i, j - i).take(take) for c in (0, 1)), pa.array(first.astype(np.int32)),
                    ],
                    ["src", "dst", "doc", "part", "first"],
                )

    return rows.mapInArrow(scan, "src long, dst long, doc long, part long, first int")


def _passages(rows: DataFrame, length: int, digest: bool = False) -> DataFrame:
    """``doc, part, first, count, anchor, body``: the words of wanted windows, from rows (doc, part, text, wanted).

    With ``digest`` the body is the SHA-256 of the words.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in W.blocks(batch.column(2), BLOCK_BYTES):
                starts, ends, doc = W.bounds(data, offsets)
                begin = np.searchsorted(doc, np.arange(j - i))
                owner, flat = _asked(batch, i, j)
                first, count = (flat.field(c).to_numpy().astype(np.int64) for c in (0, 1))
                low = begin[owner] + first
                # Equal words may be set apart by different white space, so they are joined anew.
                spaced, at = W.spaced(data, starts, ends)
                high = at[low + count + length - 1] - 1
                low = at[low]
                take, size = pa.array(owner), np.cumsum(high - low)
                x = 0
                while x < len(low):  # stretches overlap, so their bytes may be many times the block's
                    y = max(x + 1, int(np.searchsorted(size, size[x] + BLOCK_BYTES)))
                    if digest:
                        bodies = [hashlib.sha256(spaced[b:e]).digest() for b, e in zip(low[x:y].tolist(), high[x:y].tolist())]
                        bodies = pa.array(bodies, pa.binary())
                    else:
                        bodies = W.slices(spaced, low[x:y], high[x:y]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(c).slice(i, j - i).take(take[x:y]) for c in (0, 1)),
                            *(flat.field(c)[x:y] for c in (0, 1, 2)), bodies,
                        ],
                        ["doc", "part", "first", "count", "anchor", "body"],
                    )
                    x = y

    return rows.mapInArrow(scan, "doc long, part long, first int, count int, anchor long, body binary")


def _kept(rows: DataFrame, length: int) -> DataFrame:
    """Result rows from (doc, part, text, spans)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(2), batch.column(3)):
                words = (text.as_py() or "").encode().split()
                n, found = len(words), spans.as_py()
                if found and n >= length:
                    change = np.zeros(n + 1, np.int64)
                    for s in found:
                        change[s["first"]] += 1
                        change[min(n, s["first"] + s["count"] - 1 + length)] -= 1
                    words = [w for w, c in zip(words, np.cumsum(change)) if not c]
                out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _edge():
    return F.xxhash64("src", "dst")


def compacted(edges: DataFrame) -> DataFrame:
    """``edge, path``: the first edge of the nonbranching path that each edge (``src``, ``dst``) is on.

    Edges are named by a hash. On a path that closes to a ring any of its edges may stand for it.
    """
    into = edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("a")).where("n = 1")
    out = edges.groupBy("src").agg(F.count("*").alias("m"), F.min("dst").alias("b")).where("m = 1")
    links = into.join(out, F.col("dst") == F.col("src")).select(
        F.xxhash64("a", "dst").alias("before"), F.xxhash64("src", "b").alias("edge")
    )
    named = edges.select(_edge().alias("edge")).join(links, "edge", "left")
    state = written(named.select("edge", F.coalesce("before", "edge").alias("path"), F.col("before").isNull().alias("done")), "paths")
    left = None
    while True:
        now = state.where("NOT done").count()
        # On chains every round brings some edges to the end; what stays as it is are rings.
        if not now or now == left:
            return state
        left = now
        ahead = state.select(F.col("edge").alias("at"), F.col("path").alias("to"), F.col("done").alias("ended"))
        moved = state.where("NOT done").join(ahead, F.col("path") == F.col("at")).select(
            "edge", F.col("to").alias("path"), F.col("ended").alias("done")
        )
        old, state = state, written(state.where("done").unionByName(moved), "paths")
        dropped(old)


def _by_document(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, part, text, wanted: first, count, anchor) of all wanted windows (doc, part, first, count and maybe anchor)."""
    anchor = F.col("anchor") if "anchor" in rows.columns else F.lit(0).cast("long").alias("anchor")
    wanted = rows.groupBy("doc", "part").agg(F.collect_list(F.struct("first", "count", anchor)).alias("wanted"))
    return texts.join(wanted, ["doc", "part"]).select("doc", "part", "text", "wanted")


def settled(texts: DataFrame, found: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans of stretches whose words as a whole are a smaller document's, and the stretches that need the graph.

    Stretches are grouped by the SHA-256 of their words, so copies leave one row a task. A
    stretch is for the graph if its document is the first with these words and
    other words stand at the anchor elsewhere.
    """
    bodies = written(_passages(_by_document(found, texts), length, digest=True), "bodies")
    different = written(bodies.groupBy("anchor", "body").agg(F.min("doc").alias("low")), "different")
    several = different.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    both = bodies.join(different, ["anchor", "body"]).drop("body")
    both = written(both, "placed")
    dropped(bodies)
    columns = ["doc", "part", "first", "count"]
    branching = written(both.where("doc = low").join(several, "anchor").select(*columns), "branching")
    copies = written(both.where("doc > low").select(*columns), "copies")
    dropped(different, both)
    return copies, branching


def repeated_spans(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """Verified spans (doc, part, first, count) of the candidate windows ``found`` that repeat a smaller document's."""
    occurrences = written(_edges(_by_document(found, texts), length), "edges")
    edges = occurrences.groupBy("src", "dst").agg(
        F.min(F.struct("doc", "part", "first")).alias("low"), F.max("doc").alias("high")
    ).where(F.col("low.doc") < F.col("high"))
    edges = written(edges.select("src", "dst", "low"), "repeated")
    paths = compacted(edges)
    placed = edges.withColumn("edge", _edge()).join(paths.select("edge", "path"), "edge").drop("edge")
    later = occurrences.join(placed, ["src", "dst"]).where(F.col("doc") > F.col("low.doc")).select(
        "doc", "part", "first", "path", F.col("low.doc").alias("from_doc"), F.col("low.part").alias("from_part"),
        (F.col("low.first") - F.col("first")).alias("shift"),
    )
    runs = later.groupBy("doc", "part", "path", "from_doc", "from_part", "shift").agg(
        F.array_sort(F.collect_list("first")).alias("at")
    )
    at = F.col("at")
    begins = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) != x - 1))
    ends = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != x + 1))
    spans = runs.select("*", F.inline(F.arrays_zip(begins.alias("a"), ends.alias("b")))).select(
        "doc", "part", F.col("a").alias("first"), (F.col("b") - F.col("a") + 1).alias("count"),
        "from_doc", "from_part", (F.col("a") + F.col("shift")).alias("from_first"),
    )
    spans = written(spans, "spans")
    dropped(paths, edges)

    # The words at both coordinates; a source span is fetched once, however many repeat it.
    sources = spans.select(
        F.col("from_doc").alias("doc"), F.col("from_part").alias("part"), F.col("from_first").alias("first"), "count"
    ).distinct()
    asked = spans.select("doc", "part", "first", "count").unionByName(sources).distinct()
    bodies = written(_passages(_by_document(asked, texts), length), "passages")
    own = spans.join(bodies, ["doc", "part", "first", "count"])
    source = bodies.select(
        F.col("doc").alias("from_doc"), F.col("part").alias("from_part"), F.col("first").alias("from_first"), "count", "body"
    )
    keys = ["from_doc", "from_part", "from_first", "count"]
    compared = own.join(source.withColumnRenamed("body", "source"), keys)
    compared = written(
        compared.select("doc", "part", "first", "count", (F.col("body") == F.col("source")).alias("same")), "compared"
    )
    dropped(bodies, spans)
    good = compared.where("same").select("doc", "part", "first", "count")
    wrong = compared.where("NOT same")
    if wrong.isEmpty():
        dropped(occurrences)
        return good
    # Hashes that collided: the windows of these edges are told apart by their words.
    windows = wrong.select("doc", "part", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)).alias("first"))
    bad = occurrences.join(windows, ["doc", "part", "first"]).select("src", "dst").distinct()
    all_of = occurrences.join(bad, ["src", "dst"]).select("doc", "part", "first", F.lit(1).alias("count"))
    words = written(_passages(_by_document(all_of, texts), length), "passages")
    least = words.groupBy("body").agg(F.min("doc").alias("least"))
    exact = words.join(least, "body").where("least < doc").select("doc", "part", "first", "count")
    return good.unionByName(exact)


def remove_repeats(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"),
        F.col(text_col).alias("text"),
    )
    repeated_ids = not source.groupBy("doc").count().where("count > 1").isEmpty()
    source = source.withColumn("part", F.xxhash64("text") if repeated_ids else F.lit(0).cast("long"))
    texts = source.where("text IS NOT NULL").select("doc", "part", "text")
    if repeated_ids:
        texts = texts.distinct()

    digests = texts.select("doc", "part", F.unhex(F.sha2("text", 256)).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    same = written(digests.join(first, "digest").where("low < doc").select("doc", "part"), "same")

    anchors = _scan(texts, length, False).groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    anchors = written(anchors.where("low < high").select("anchor"), "anchors")
    every = written(_scan(texts, length, True).join(anchors, "anchor"), "every")
    dropped(anchors)
    others = every.join(same, ["doc", "part"], "left_anti")
    several = others.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    found = written(others.join(several.select("anchor"), "anchor"), "stretches")
    dropped(every)
    alike, branching = settled(texts, found, length)
    dropped(found)

    # A copy of a whole text goes from its first word to behind its last.
    copies = same.select("doc", "part", F.lit(0).alias("first"), F.lit(1 << 30).alias("count"))
    spans = copies.unionByName(alike).unionByName(repeated_spans(texts, branching, length))
    spans = written(spans.groupBy("doc", "part").agg(F.collect_list(F.struct("first", "count")).alias("spans")), "lists")
    dropped(same, alike, branching)
    joined = source.join(spans, ["doc", "part"], "left")
    return _kept(joined.select("doc_id", "part", "text", "spans"), length)
