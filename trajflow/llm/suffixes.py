"""Removal of repeated byte strings by hash-compared suffix sorting.

A string of ``length`` bytes is removed where it also starts earlier: in a document
with a smaller id, or earlier in the same one. Equal strings hold the same anchor, the
``KGRAM`` bytes in them with the smallest hash, so all suffixes that can agree on
``length`` bytes meet at their anchor:

1. Consecutive strings with one anchor form a stretch. Spark counts the anchors; a
   stretch whose anchor occurs once repeats nothing.
2. The bytes of the others are grouped as they are. Of equal stretches only the first
   has anything to keep, so copies, however many, leave one row per task. Copies of
   whole texts, told by their SHA-256, are left out before.
3. The suffixes of an anchor's different stretches, those with the anchor at one
   distance at a time, are sorted by mergesort. A comparison finds the common extension of two suffixes by binary search over prefix
   polynomial hashes and looks at one byte behind it. Neighbours in the order are then
   compared byte by byte; if two are out of order, or not as equal as their hashes, a
   collision is at hand and their group is sorted by its bytes.
4. An anchor with many stretches is sorted in several runs, dealt by content, whose
   distinct strings Spark merges by grouping them.

Nothing is removed from null or empty texts, or texts shorter than ``length``. A null
id counts as larger than any other. Rows with one id and different texts count as
documents in the order of their texts' hashes (``xxhash64``); rows with one id and
equal texts are one document, each with a result row. Other columns are ignored,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajflow.llm import words as W
from trajflow.llm.components import dropped, written
from trajflow.session import hashed

LENGTH = 100
KGRAM = 32
#: Bytes scanned at a time; bounds the temporary arrays.
BLOCK_BYTES = 2 << 20
#: Bytes sorted at a time, each the start of a suffix or nearly so.
SORT_BYTES = 1 << 19
#: Bytes of an anchor's different stretches that one run of the sort takes.
RUN_BYTES = 1 << 19
_LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)


def _powers(base: int, size: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base % (1 << 64), np.uint64)]))


class Prefixes:
    """Polynomial hashes of all substrings of ``data``, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.power = _powers(_BASE, len(data))
        terms = (data.astype(np.uint64) + np.uint64(1)) * self.power[:-1]
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the hashes of ``size`` bytes from ``a`` and from ``b`` are equal."""
        left = (self.sum[a + size] - self.sum[a]) * self.power[b]
        return left == (self.sum[b + size] - self.sum[b]) * self.power[a]

    def common(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Length of the common extension of the suffixes at ``a`` and ``b``, up to ``limit``."""
        whole = self.equal(a, b, np.full(len(a), limit))
        low = np.where(whole, limit, 0)
        rest = np.flatnonzero(~whole)
        low[rest] = self._search(a[rest], b[rest], limit)
        return low

    def _search(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.full(len(a), limit - 1)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.equal(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of the ``k`` bytes from each place."""
    hashes = Prefixes(data)
    back = _powers(pow(_BASE, -1, 1 << 64), len(data))
    return W.mix((hashes.sum[k:] - hashes.sum[:-k]) * back[: len(data) - k + 1])


def anchored(data: np.ndarray, offsets: np.ndarray, length: int):
    """Place of every string within one text of ``data``, its anchor's place and hash."""
    count = len(data) - length + 1
    none = np.empty(0, np.int64)
    if count <= 0:
        return none, none, none.astype(np.uint64)
    crossing = np.zeros(count + 1, np.int64)
    inner = offsets[1:-1]
    np.add.at(crossing, np.clip(inner - length + 1, 0, count), 1)
    np.add.at(crossing, np.minimum(inner, count), -1)
    at = np.flatnonzero(np.cumsum(crossing[:-1]) == 0)
    k = min(KGRAM, length)
    hashes = grams(data, k)
    # The place in the lower bits makes the leftmost of equal hashes the smallest.
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    span, width = length - k + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: -(span - width)], least[span - width :])
    place = (least[at] & _PLACE).astype(np.int64)
    return at, place, hashes[place]


def stretches(data: np.ndarray, offsets: np.ndarray, length: int):
    """Text, first byte, strings, anchor of every stretch of the texts in ``data``; whether the anchor is at several places."""
    at, place, anchor = anchored(data, offsets, length)
    if not len(at):
        return at, at, at, anchor, at.astype(bool)
    doc = np.searchsorted(offsets[1:], at, "right")
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    owner, size = doc[first], np.diff(np.append(first, len(at)))
    return owner, at[first] - offsets[owner], size, anchor[first], place[first] != place[first + size - 1]


def _parts(column: pa.Array, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Bounded runs of texts: first, end, bytes before, bytes, offsets. Long texts come in overlapping parts."""
    for i, j, data, offsets in W.blocks(column, BLOCK_BYTES):
        if len(data) <= 2 * BLOCK_BYTES:
            yield i, j, 0, data, offsets
            continue
        for low in range(0, len(data) - length + 1, BLOCK_BYTES):
            part = data[low : low + BLOCK_BYTES + length - 1]
            yield i, j, low, part, np.array([0, len(part)])


def _scan(docs: DataFrame, length: int, whole: bool) -> DataFrame:
    """Anchors of all stretches; ``whole`` adds their coordinates."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, before, data, offsets in _parts(batch.column(2), length):
                owner, first, count, anchor, again = stretches(data, offsets, length)
                if not whole:
                    # An anchor at several places of one stretch is there more than once.
                    anchor = np.concatenate([anchor, anchor[again]])
                columns, names = [pa.array(anchor.view(np.int64))], ["anchor"]
                if whole:
                    take = pa.array(owner)
                    columns += [batch.column(c).slice(i, j - i).take(take) for c in (0, 1)]
                    columns += [pa.array((first + before).astype(np.int32)), pa.array(count.astype(np.int32))]
                    columns.append(pa.array(again))
                    names += ["doc", "part", "first", "count", "again"]
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = "anchor long" + (", doc long, part long, first int, count int, again boolean" if whole else "")
    return docs.select("doc", "part", "text").mapInArrow(scan, fields)


def _bytes_of(rows: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted stretch of rows (doc, part, text, wanted: anchor, first, count, again)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in W.blocks(batch.column(2), BLOCK_BYTES):
                wanted = batch.column(3).slice(i, j - i)
                owner = np.repeat(np.arange(j - i), wanted.value_lengths().to_numpy())
                flat = wanted.flatten()
                first, count = (flat.field(c).to_numpy().astype(np.int64) for c in (1, 2))
                starts = offsets[owner] + first
                sizes = count + length - 1
                ends, low = np.cumsum(sizes), 0
                while low < len(owner):
                    base = ends[low] - sizes[low]
                    high = max(low + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right")))
                    cut = slice(low, high)
                    place = np.arange(sizes[cut].sum()) + np.repeat(starts[cut] - (ends[cut] - sizes[cut] - base), sizes[cut])
                    edges = np.concatenate([[0], ends[cut] - base]).astype(np.int64)
                    body = pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), high - low, [None, pa.py_buffer(edges), pa.py_buffer(data[place])]
                    ).cast(pa.binary())
                    take = pa.array(owner[cut])
                    yield pa.RecordBatch.from_arrays(
                        [
                            flat.field(0).slice(low, high - low), body,
                            *(batch.column(c).slice(i, j - i).take(take) for c in (0, 1)),
                            pa.array(first[cut].astype(np.int32)), flat.field(3).slice(low, high - low),
                        ],
                        ["anchor", "body", "doc", "part", "first", "again"],
                    )
                    low = high

    return rows.mapInArrow(scan, "anchor long, body binary, doc long, part long, first int, again boolean")


def sort_suffixes(data: np.ndarray, place: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``place`` by group and first ``length`` bytes; whether each equals the one before.

    ``group`` rises. A bottom-up mergesort of all groups side by side: in each round
    every suffix finds its rank in the neighbouring run by binary search.
    """
    hashes = Prefixes(data)
    n = len(place)
    order = np.arange(n)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(begin, n))
    low = np.repeat(begin, size)
    end = low + np.repeat(size, size)
    local = np.arange(n) - low
    width = 1
    while width < size.max(initial=0):
        run = local // width
        sibling = low + (run ^ 1) * width
        active = np.flatnonzero(sibling < end)
        mine, right = place[order[active]], (run[active] & 1).astype(bool)
        first, last = sibling[active], np.minimum(sibling[active] + width, end[active])
        lo, hi = first.copy(), last.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            a, b = mine[open_], place[order[middle]]
            common = hashes.common(a, b, length)
            same = common == length
            inside = np.minimum(common, length - 1)
            # Equal suffixes of the left run stay ahead of those of the right one.
            before = np.where(same, right[open_], data[b + inside] < data[a + inside])
            lo[open_] = np.where(before, middle + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], middle)
            open_ = open_[lo[open_] < hi[open_]]
        slot = np.arange(n)
        slot[active] = low[active] + (run[active] >> 1) * 2 * width + (local[active] - run[active] * width) + (lo - first)
        merged = np.empty(n, np.int64)
        merged[slot] = order
        order = merged
        width *= 2
    return _verified(data, place, group, order, length)


def _verified(data, place, group, order, length):
    """The order and its equal neighbours by the bytes themselves; groups out of order are sorted by them."""
    n = len(order)
    equal, wrong = np.zeros(n, bool), np.zeros(n, bool)
    reach = np.arange(length)
    step = max(1, SORT_BYTES // length)
    for low in range(0, n, step):
        at = order[max(0, low - 1) : low + step]
        rows = data[place[at][:, None] + reach]
        differ = rows[1:] != rows[:-1]
        column = differ.argmax(axis=1)
        some = differ[np.arange(len(differ)), column]
        falls = rows[1:][np.arange(len(differ)), column] < rows[:-1][np.arange(len(differ)), column]
        together = group[at[1:]] == group[at[:-1]]
        here = slice(max(0, low - 1) + 1, max(0, low - 1) + 1 + len(differ))
        equal[here] = together & ~some
        wrong[here] = together & some & falls
    for g in np.unique(group[order[wrong]]):
        slots = np.flatnonzero(group == g)
        texts = {s: data[place[s] : place[s] + length].tobytes() for s in slots}
        order[slots] = sorted(slots, key=texts.__getitem__)
        equal[slots] = [i > 0 and texts[order[s]] == texts[order[s - 1]] for i, s in enumerate(slots)]
    return order, equal


def _sorted_runs(rows: DataFrame, length: int) -> DataFrame:
    """Spans of strings that aren't the first of their run, and the first ones (``string``) of anchors with several runs.

    ``rows`` (anchor, run, runs, body, doc, part, first) is sorted by anchor and run.
    """

    def solve(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        anchor, run, runs = (table[c].to_numpy() for c in ("anchor", "run", "runs"))
        data, offsets = W.text_arrays(table["body"].combine_chunks().cast(pa.large_binary()))
        place, own, _ = anchored(data, offsets, length)
        # Equal strings have their anchor at one distance, so only those of one distance are sorted together.
        which = np.cumsum(np.append(0, (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])))
        owner = np.searchsorted(offsets[1:], place, "right")
        group = which[owner] * length + (own - place)
        together = np.argsort(group, kind="stable")
        place, owner, group = place[together], owner[together], group[together]
        start = table["first"].to_numpy().astype(np.int64)[owner] + place - offsets[owner]
        doc, part = table["doc"].to_numpy()[owner], table["part"].to_numpy()[owner]
        order, equal = sort_suffixes(data, place, group, length)
        early = np.empty(len(owner), np.int64)
        early[np.lexsort((start, part, doc))] = np.arange(len(owner))
        heads = np.flatnonzero(~equal)
        least = np.minimum.reduceat(early[order], heads) if len(heads) else early
        first = early[order] == np.repeat(least, np.diff(np.append(heads, len(order))))
        open_ = np.sort(order[first & (runs[owner[order]] > 1)])
        # Neighbouring strings of a stretch that go together are one span.
        later = np.sort(order[~first])
        later = later[np.lexsort((start[later], owner[later]))]
        joins = (owner[later[1:]] == owner[later[:-1]]) & (start[later[1:]] == start[later[:-1]] + 1)
        head = np.flatnonzero(np.append(True, ~joins)[: len(later)])
        last = later[np.append(head[1:], len(later)) - 1] if len(head) else later
        chosen = np.concatenate([later[head], open_])
        ends = np.concatenate([start[last], start[open_]]) + length
        strings = [None] * len(head) + [data[place[s] : place[s] + length].tobytes() for s in open_]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc[chosen]), pa.array(part[chosen]), pa.array(start[chosen].astype(np.int32)),
                pa.array(ends.astype(np.int32)), pa.array(strings, pa.binary()),
            ],
            ["doc", "part", "first", "end", "string"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch)
                size += batch.column("body").nbytes
                batch = batch.slice(batch.num_rows)
            if size < SORT_BYTES:
                continue
            table = pa.Table.from_batches(held)
            anchor, run = table["anchor"].to_numpy(), table["run"].to_numpy()
            cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])) + 1
            if not len(cuts):
                continue
            # All but the last group are whole; they are solved in bounded portions.
            sizes = np.cumsum(pc.binary_length(table["body"]).to_numpy().astype(np.int64))
            low = 0
            while low < cuts[-1]:
                base = sizes[low - 1] if low else 0
                fit = cuts[(cuts > low) & (sizes[cuts - 1] <= base + SORT_BYTES)]
                high = int(fit[-1]) if len(fit) else int(cuts[cuts > low][0])
                yield solve(table.slice(low, high - low))
                low = high
            held = table.slice(low).to_batches()
            size = sum(b.column("body").nbytes for b in held)
        if held:
            yield solve(pa.Table.from_batches(held))

    return rows.mapInArrow(scan, "doc long, part long, first int, end int, string binary")


def _kept(rows: DataFrame) -> DataFrame:
    """Spans and remaining bytes from (doc_id, part, text, spans: first, end)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in W.blocks(batch.column(2), BLOCK_BYTES):
                found = batch.column(3).slice(i, j - i)
                owner = np.repeat(np.arange(j - i), found.value_lengths().fill_null(0).to_numpy())
                flat = found.flatten()
                change = np.zeros(len(data) + 1, np.int32)
                np.add.at(change, offsets[owner] + flat.field(0).to_numpy(), 1)
                np.add.at(change, offsets[owner] + flat.field(1).to_numpy(), -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.zeros(len(data) + 1, bool)
                edge[offsets] = True
                begins, stops = gone.copy(), gone.copy()
                begins[1:] &= ~gone[:-1] | edge[1:-1]
                stops[:-1] &= ~gone[1:] | edge[1:-1]
                begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
                of = np.searchsorted(offsets[1:], begin, "right")
                spans = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of, np.arange(j - i + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays(
                        [pa.array((x - offsets[of]).astype(np.int64)) for x in (begin, stop)], ["begin", "end"]
                    ),
                )
                left = np.concatenate([[0], np.cumsum(~gone)])[offsets].astype(np.int64)
                kept = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), j - i, [None, pa.py_buffer(left), pa.py_buffer(data[~gone])]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(offsets)), spans, kept],
                    ["doc_id", "n_bytes", "spans", "kept"],
                )

    fields = "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary"
    return rows.mapInArrow(cut, fields)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES
) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (maximal removed byte ranges) and kept (the other bytes)."""
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"),
        F.col(text_col).alias("text"),
    )
    repeated_ids = not source.groupBy("doc").count().where("count > 1").isEmpty()
    source = source.withColumn("part", F.xxhash64("text") if repeated_ids else F.lit(0).cast("long"))
    long_enough = source.where(F.octet_length("text") >= length).select("doc", "part", "text")
    if repeated_ids:
        long_enough = long_enough.distinct()

    # A copy of a whole text is covered by strings that start in the first one, so it needs no sorting.
    texts = long_enough.select("doc", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("end"))
    first = texts.groupBy("digest").agg(F.min(F.struct("doc", "part")).alias("low"), F.count("*").alias("n")).where("n > 1")
    same = texts.join(first, "digest").where(F.struct("doc", "part") != F.col("low"))
    same = written(same.select("doc", "part", F.lit(0).alias("first"), "end"), "same")

    anchors = _scan(long_enough, length, False).groupBy("anchor").count().where("count > 1").select("anchor")
    anchors = written(anchors, "anchors")
    every = written(_scan(long_enough, length, True).join(anchors, "anchor"), "every")
    dropped(anchors)
    others = every.join(same.select("doc", "part"), ["doc", "part"], "left_anti")
    several = others.groupBy("anchor").agg(F.count("*").alias("n"), F.max("again").alias("loop")).where("n > 1 OR loop")
    found = written(others.join(several.select("anchor"), "anchor"), "stretches")
    dropped(every)
    wanted = found.groupBy("doc", "part").agg(F.collect_list(F.struct("anchor", "first", "count", "again")).alias("wanted"))
    texts = long_enough.join(wanted, ["doc", "part"]).select("doc", "part", "text", "wanted")
    bodies = written(_bytes_of(texts, length), "bodies")
    dropped(found)

    early = F.min(F.struct("doc", "part", "first")).alias("low")
    different = written(bodies.groupBy("anchor", "body").agg(early, F.max("again").alias("again")), "different")
    copies = bodies.join(different, ["anchor", "body"]).where(F.struct("doc", "part", "first") != F.col("low"))
    end = F.col("first") + F.octet_length("body")
    copied = written(copies.select("doc", "part", "first", end.cast("int").alias("end")), "copies")
    dropped(bodies)

    # A stretch alone at its anchor can repeat itself only if the anchor is at several places of it.
    classes = different.groupBy("anchor").agg(
        F.count("*").alias("n"), F.max("again").alias("again"),
        F.ceil(F.sum(F.octet_length("body")) / run_bytes).alias("runs"),
    ).where("n > 1 OR again").select("anchor", "runs")
    runs = different.join(classes, "anchor").select(
        "anchor", F.pmod(F.xxhash64("body"), "runs").alias("run"), "runs", "body", "low.doc", "low.part", "low.first"
    )
    dealt = hashed(runs, "anchor", "run").sortWithinPartitions("anchor", "run")
    strings = written(_sorted_runs(dealt, length), "strings")
    several = strings.where("string IS NOT NULL")
    merged = several.groupBy("string").agg(early)
    again = several.join(merged, "string").where(F.struct("doc", "part", "first") != F.col("low"))
    columns = ["doc", "part", "first", "end"]
    later = strings.where("string IS NULL").select(*columns).unionByName(again.select(*columns))
    spans = same.unionByName(copied).unionByName(later)

    by_row = written(spans.groupBy("doc", "part").agg(F.collect_list(F.struct("first", "end")).alias("spans")), "spans")
    dropped(different, strings, copied, same)
    return _kept(source.join(by_row, ["doc", "part"], "left").select("doc_id", "part", "text", "spans"))
