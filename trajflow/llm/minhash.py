"""Near-duplicates by MinHash: banding, signature check, exact check, components.

A document's set is its distinct word shingles (words lower-cased in A-Z); with fewer
words than a shingle has, the whole sequence is the only one. Documents with equal
sets form a class, which is one node from then on, so thousands of copies cost one
signature. A signature is the minima of many universal hash functions; nodes that
agree in a whole band share a bucket.

Pairs within a bucket aren't listed. A bucket's hub, its best connected node, is
compared with every member. Where members are then in several components, bounds on
what two can have in common (within the hub and outside of it, without the shingles
that only one of them has) rule out most pairs across components, and so do parity
bitmaps: two sets differ in at least as many shingles as their bitmaps do in bits. The
others are compared, so that each pair of a bucket is compared, connected or ruled out.
The signatures first drop pairs that are hopeless (eight standard deviations below the
threshold); the rest are decided on full sets. With 40 bands of 5 rows, a pair right at
a threshold of 0.8 shares no bucket once in eight million; with 30 bands, one at 0.85
once in forty million.

Null or empty texts have no shingles and are linked with nothing. Rows with a null id
are linked with nothing, and have no component. Rows that share an id count as one
document. Only the named columns are read; others may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajflow.llm import words as W
from trajflow.llm.components import components, written

BLOCK_BYTES = 2 << 20
#: 64-bit parts of a parity bitmap.
PARITY = 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each distinct shingle, ordered by both."""
    data = W.LOWER[data]
    starts, ends, doc = W.bounds(data, offsets)
    hashes = W.hash_words(data, starts, ends)
    at, found = W.windows(hashes, doc, size)
    docs, sets = [doc[at]], [found]
    count = np.bincount(doc, minlength=len(offsets) - 1)
    for short in range(1, size):
        at, found = W.windows(hashes, doc, short)
        fits = count[doc[at]] == short
        docs.append(doc[at][fits])
        sets.append(W.mix(found[fits] + np.uint64(short)))
    doc, found = np.concatenate(docs), np.concatenate(sets)
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    return doc[new], found[new]


def signatures(
    docs: DataFrame, id_col: str, text_col: str, size: int, hashes: int, seed: int = 1
) -> DataFrame:
    """Set size, digest of the set and signature (16 bits of each minimum) per row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        factor = rng.integers(0, 1 << 64, hashes, dtype=np.uint64) | np.uint64(1)
        shift = rng.integers(0, 1 << 64, hashes, dtype=np.uint64)
        for batch in batches:
            for i, j, data, offsets in W.blocks(batch.column(1), BLOCK_BYTES):
                n = j - i
                doc, found = shingle_sets(data, offsets, size)
                count = np.bincount(doc, minlength=n)
                digest = np.zeros((n, 2), np.uint64)
                minima = np.zeros((n, hashes), np.uint16)
                if len(doc):
                    have = np.flatnonzero(count)
                    first = np.searchsorted(doc, have)
                    digest[have, 0] = np.add.reduceat(W.mix(found), first)
                    digest[have, 1] = np.bitwise_xor.reduceat(W.mix(found ^ W.ODD), first)
                    with np.errstate(over="ignore"):
                        for k in range(hashes):
                            value = (found * factor[k] + shift[k]) >> np.uint64(32)
                            minima[have, k] = np.minimum.reduceat(value, first).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n),
                        pa.array(count, pa.int64()),
                        pa.array([x.tobytes() for x in digest], pa.binary()),
                        pa.array([x.tobytes() for x in minima], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "minima"],
                )

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return source.mapInArrow(scan, "doc_id long, n_shingles long, digest binary, minima binary")


def _alike(pairs: DataFrame, hashes: int, least: int) -> DataFrame:
    """Pairs whose signatures agree in ``least`` places or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, hashes) for c in (2, 3)
            )
            yield batch.select([0, 1]).filter(pa.array((a == b).sum(axis=1) >= least))

    return pairs.mapInArrow(check, "u long, v long")


def _confirmed(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Adds to (u, v, text of u, text of v): linked if 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in W.blocks(batch.column(2), BLOCK_BYTES):
                n = j - i
                sets = [shingle_sets(data, offsets, size)]
                sets.append(shingle_sets(*W.text_arrays(batch.column(3).slice(i, n)), size))
                sizes = [np.bincount(doc, minlength=n) for doc, _ in sets]
                doc, found = (np.concatenate([s[k] for s in sets]) for k in (0, 1))
                order = np.lexsort((found, doc))
                doc, found = doc[order], found[order]
                twice = (doc[1:] == doc[:-1]) & (found[1:] == found[:-1])
                common = np.bincount(doc[1:][twice], minlength=n)
                whole = sizes[0] + sizes[1] - common
                linked = (100 * common >= percent * whole) & (whole > 0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, n).columns[:2], pa.array(common, pa.int64()), pa.array(linked)],
                    ["u", "v", "common", "linked"],
                )

    return pairs.mapInArrow(check, "u long, v long, common long, linked boolean")


def _with_hubs(members: DataFrame) -> DataFrame:
    """Adds each bucket's ``hub``: its member that shares most over all buckets."""
    degree = members.groupBy("node").agg(F.sum("m").alias("degree"))
    hubs = (
        members.join(degree, "node").groupBy("bucket")
        .agg(F.max(F.struct("degree", (-F.col("node")).alias("least"))).alias("top"))
        .select("bucket", (-F.col("top.least")).alias("hub"))
    )
    return members.join(hubs, "bucket")


def _owned(texts: DataFrame, size: int) -> DataFrame:
    """``node`` and ``own``: how many of its shingles are in no other of these texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in W.blocks(batch.column(1), BLOCK_BYTES):
                doc, found = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(found.view(np.int64))],
                    ["node", "shingle"],
                )

    rows = texts.select("id", "text").mapInArrow(scan, "node long, shingle long")
    only = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("high"))
    return only.where("node = high").groupBy("node").agg(F.count("*").alias("own"))


def _parities(texts: DataFrame, size: int) -> DataFrame:
    """``node`` and ``bits``: of each hash bucket of shingles, whether the set has an odd number.

    What two sets share cancels out, so the bits in which two bitmaps differ are at most
    as many as the shingles that only one of the sets has, whatever the sets' sizes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in W.blocks(batch.column(1), BLOCK_BYTES):
                doc, found = shingle_sets(data, offsets, size)
                at = W.mix(found) % np.uint64(64 * PARITY)
                bits = np.zeros((j - i) * PARITY, np.uint64)
                np.bitwise_xor.at(bits, doc * PARITY + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(j - i + 1) * PARITY, pa.int32()), pa.array(bits.view(np.int64))
                )
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["node", "bits"])

    return texts.select("id", "text").mapInArrow(scan, "node long, bits array<long>")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    bands: int = 40,
    rows: int = 5,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept (the component's first id)."""
    hashes = bands * rows
    made = written(signatures(docs, id_col, text_col, size, hashes), "signatures")
    real = made.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = written(
        real.groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.first("minima").alias("minima"), F.first("n_shingles").alias("n")
        ),
        "classes",
    )
    keys = F.array(
        *(F.xxhash64(F.lit(b), F.substring("minima", 2 * rows * b + 1, 2 * rows)) for b in range(bands))
    )
    in_band = classes.select("node", "n", F.explode(keys).alias("bucket"))
    shared = in_band.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    members = written(_with_hubs(in_band.join(shared, "bucket")), "members")
    share = percent / 100
    least = math.floor(hashes * share - 8 * math.sqrt(hashes * share * (1 - share)))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = written(texts.join(members.select(F.col("node").alias("id")).distinct(), "id", "left_semi"), "texts")

    def links_of(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) that were compared on full sets: what is ``common``, whether ``linked``."""
        sides = [
            classes.select(F.col("node").alias(x), F.col("minima").alias(f"minima_{x}")) for x in ("u", "v")
        ]
        close = pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "minima_u", "minima_v")
        close = _alike(close, hashes, least)
        both = close.join(texts.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u").join(
            texts.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v"
        )
        return written(_confirmed(both.select("u", "v", "text_u", "text_v"), size, percent), "compared")

    pairs = members.where("node != hub").select(
        F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")
    ).distinct()
    compared = links_of(pairs)
    links = compared.where("linked").select("u", "v")
    groups = components(links)
    named = members.join(groups, "node", "left").select(
        "bucket", "node", "n", "hub", F.coalesce("component", "node").alias("component")
    )
    mixed = named.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least")
    ).where("low != high")
    named = named.join(mixed, "bucket")
    pool = texts.join(named.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    to_hub = compared.select(F.col("u").alias("hub"), F.col("v").alias("node"), F.col("common").alias("a"))
    to_hub = to_hub.unionByName(
        compared.select(F.col("v").alias("hub"), F.col("u").alias("node"), F.col("common").alias("a"))
    ).groupBy("hub", "node").agg(F.max("a").alias("a"))
    named = named.join(_owned(pool, size), "node", "left").na.fill(0, ["own"]).join(to_hub, ["hub", "node"], "left")
    # What a node shares with any other bounds its overlap with each of them.
    shares = F.col("n") - F.col("own")
    hopeful = (100 + percent) * shares >= percent * (F.col("n") + F.greatest("least", percent * F.col("n") / 100))
    named = written(
        named.where(hopeful).select(
            "bucket", "node", "n", "component", (F.col("component") == F.col("low")).alias("main"),
            shares.alias("s"), F.when(F.col("node") == F.col("hub"), F.col("n")).otherwise(F.col("a")).alias("a"),
        ),
        "pool",
    )
    hopefuls = texts.join(named.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    named = named.join(_parities(hopefuls, size), "node")
    columns = ("node", "n", "component", "s", "a", "bits")
    x = named.where("NOT main").select("bucket", *(F.col(c).alias(f"{c}_x") for c in columns))
    y = named.select("bucket", *(F.col(c).alias(f"{c}_y") for c in (*columns, "main")))
    needed = percent * (F.col("n_x") + F.col("n_y"))
    # Common shingles lie in the bucket's hub or outside of it, and are bounded in either part.
    parted = F.least("a_x", "a_y") + F.least(F.col("s_x") - F.col("a_x"), F.col("s_y") - F.col("a_y"))
    known = F.col("a_x").isNotNull() & F.col("a_y").isNotNull()
    differ = sum((F.bit_count(F.col("bits_x")[k].bitwiseXOR(F.col("bits_y")[k])) for k in range(PARITY)), F.lit(0))
    fits = (
        (F.col("component_x") != F.col("component_y"))
        & (F.col("main_y") | (F.col("node_x") < F.col("node_y")))
        & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
        & ((100 + percent) * F.least("s_x", "s_y") >= needed)
        & (~known | ((100 + percent) * parted >= needed))
        & ((100 + percent) * (F.col("n_x") + F.col("n_y") - differ) >= 2 * needed)
    )
    fresh = x.join(y, "bucket").where(fits).select(F.least("node_x", "node_y").alias("u"), F.greatest("node_x", "node_y").alias("v"))
    more = links_of(fresh.distinct().join(compared.select("u", "v"), ["u", "v"], "left_anti"))
    if not more.where("linked").isEmpty():
        groups = components(links.unionByName(more.where("linked").select("u", "v")))
    found = made.join(classes.select("digest", "node"), "digest", "left").join(groups, "node", "left")
    unset = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(unset, F.col("doc_id")).otherwise(F.coalesce("component", "node"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` without the near-duplicates of a document with a smaller id; null ids stay."""
    found = near_duplicates(docs, id_col, text_col, **parameters)
    gone = found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("NOT kept")
    return docs.join(gone.select(F.col("doc_id").alias(id_col)), id_col, "left_anti").select(*docs.columns)
