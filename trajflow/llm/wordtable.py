"""Chunked distinct-word tables: work once per distinct word, join back by position.

A scan turns each chunk of documents into its distinct words (one row each, by a
64-bit hash, as words are told apart within a chunk too) and one row that holds the
documents' words as numbers into them, and the words packed. The answers for all
distinct words are found in one place each, come back to the chunks that use them,
and are put in position there. A word that is in every document has one row per
chunk, so no key grows with the number of its occurrences.

Where nothing is needed but an answer to each word, ``packed_chunks`` has one row for
each chunk and bucket of words in place of one for each of its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajflow.llm import words as W
from trajflow.session import scratch_path

#: Text bytes in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 24 << 20
#: Of these, looked at at a time.
_BLOCK = 2 << 20
#: The same where words travel packed: larger, as fewer chunks repeat fewer words.
PACKED_BYTES = 32 << 20
_SCHEMA = (
    "chunk long, code int, key long, kind int, hits long, docs array<long>, marks array<boolean>, "
    "sizes array<long>, codes binary, words binary"
)
_ARROW = pa.schema(
    [
        ("chunk", pa.int64()),
        ("code", pa.int32()),
        ("key", pa.int64()),
        ("kind", pa.int32()),
        ("hits", pa.int64()),
        ("docs", pa.list_(pa.int64())),
        ("marks", pa.list_(pa.bool_())),
        ("sizes", pa.list_(pa.int64())),
        ("codes", pa.binary()),
        ("words", pa.binary()),
    ]
)


def pack_codes(codes: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_codes(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 40), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _pack_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words, a line each, compressed."""
    size = ends - starts + 1
    stops = np.cumsum(size) - 1
    inside = np.ones(int(size.sum()), bool)
    inside[stops] = False
    lines = np.full(len(inside), 10, np.uint8)
    places = np.arange(len(inside)) + np.repeat(starts - (stops + 1 - size), size)
    lines[inside] = data[places[inside]]
    return zstandard.ZstdCompressor(level=1).compress(lines.tobytes())


def unpack_lines(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 40), np.uint8)


def unpack_words(blob: bytes) -> pa.Array:
    """A chunk's words by code."""
    lines = unpack_lines(blob)
    inside = lines != 10
    ends = np.flatnonzero(~inside)
    offsets = np.append(0, ends - np.arange(len(ends)))
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(lines[inside]))


#: First byte from which a code has more bytes.
WIDE = 160


def pack_ranks(ranks: np.ndarray) -> bytes:
    """Frequency ranks: one byte each, or a byte for the size and the rest by size.

    Ranks below ``WIDE`` are their own first byte. Larger ones are grouped by their bit
    length and the two bits after the first, which the first byte tells; they may have
    up to 31 bits, more than the words of any chunk.
    """
    squeeze = zstandard.ZstdCompressor(level=1)
    first, length = ranks.astype(np.uint8), np.frexp(ranks.astype(np.float64))[1]
    wide = np.flatnonzero(ranks >= WIDE)
    large, length = ranks[wide].astype(np.uint32), length[wide]
    kind = (length - 8) * 4 + ((large >> (length - 3).astype(np.uint32)) & 3)
    first[wide] = WIDE + kind
    order = np.argsort(kind, kind="stable")
    parts = [squeeze.compress(first.tobytes())]
    edges = np.searchsorted(kind[order], np.arange(4 * 24 + 1))
    for k in range(4 * 24):
        rest = large[order[edges[k] : edges[k + 1]]] & np.uint32((1 << (k // 4 + 5)) - 1)
        planes = rest.astype("<u4").view(np.uint8).reshape(-1, 4).T[: -(-(k // 4 + 5) // 8)]
        parts += [squeeze.compress(plane.tobytes()) if len(plane) else b"" for plane in planes]
    sizes = np.array([len(p) for p in parts], "<u8").tobytes()
    return np.array([len(parts)], "<u8").tobytes() + sizes + b"".join(parts)


def unpack_ranks(blob: bytes) -> np.ndarray:
    count = int(np.frombuffer(blob, "<u8", 1)[0])
    ends = np.cumsum(np.frombuffer(blob, "<u8", count, 8).astype(np.int64)) + 8 * (count + 1)
    opener = zstandard.ZstdDecompressor()

    def part(i: int) -> np.ndarray:
        piece = blob[ends[i - 1] if i else 8 * (count + 1) : ends[i]]
        return np.frombuffer(opener.decompress(piece, max_output_size=1 << 40) if piece else b"", np.uint8)

    first = part(0)
    out = first.astype(np.int64)
    wide = np.flatnonzero(first >= WIDE)
    kind = first[wide] - np.uint8(WIDE)
    order = np.argsort(kind, kind="stable")
    edges = np.searchsorted(kind[order], np.arange(4 * 24 + 1))
    at = 1
    for k in range(4 * 24):
        planes = -(-(k // 4 + 5) // 8)
        if edges[k] < edges[k + 1]:
            rest = sum(part(at + i).astype(np.int64) << (8 * i) for i in range(planes))
            out[wide[order[edges[k] : edges[k + 1]]]] = rest + ((4 + k % 4) << (k // 4 + 5))
        at += planes
    return out


def _by_frequency(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Old numbers by falling frequency, and the new number (small if frequent) of each."""
    order = np.argsort(-np.bincount(codes, minlength=size), kind="stable")
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    return order, rank


def _first_places(codes: np.ndarray, size: int) -> np.ndarray:
    first = np.empty(size, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return first


def _chunk(number: int, texts: list[pa.Array], docs: list, marks: list, lower: bool, kinds) -> Iterator[pa.RecordBatch]:
    column = pa.concat_arrays(texts)
    data, offsets = W.text_arrays(column)
    if lower:
        data = W.LOWER[data]
    # Block by block, as the places in the bytes take more room than the words' hashes.
    found = []
    for i, j, part, at in W.blocks(column, _BLOCK):
        part = data[offsets[i] : offsets[j]]
        starts, ends, doc = W.bounds(part, at)
        hashes = W.word_keys(part, starts, ends)
        kind = kinds(part, starts, ends, doc) if kinds else np.zeros(len(starts), np.int32)
        if kinds:
            hashes = W.mix(hashes + kind.astype(np.uint64))
        found.append((hashes, starts + offsets[i], (ends - starts).astype(np.int32), (doc + i).astype(np.int32), kind))
    hashes, starts, ends, doc, kind = (np.concatenate(x) for x in zip(*found))
    del found
    codes, unique = pd.factorize(hashes)
    del hashes
    keys = unique.view(np.int64)
    first = _first_places(codes, len(unique))
    starts, kind = starts[first], kind[first]
    ends = starts + ends[first]
    marked = np.array(marks, dtype=bool)
    hits = np.bincount(codes, weights=marked[doc], minlength=len(unique)).astype(np.int64)
    order, rank = _by_frequency(codes, len(unique))
    sizes = np.bincount(doc, minlength=len(column))
    row = {name: pa.nulls(1, kind_) for name, kind_ in zip(_ARROW.names, _ARROW.types)}
    row |= {
        "chunk": pa.array([number], pa.int64()),
        "docs": pa.array([docs], pa.list_(pa.int64())),
        "marks": pa.array([marks], pa.list_(pa.bool_())),
        "sizes": pa.array([sizes], pa.list_(pa.int64())),
        "codes": pa.array([pack_codes(rank[codes])], pa.binary()),
        "words": pa.array([_pack_words(data, starts[order], ends[order])], pa.binary()),
    }
    yield pa.RecordBatch.from_arrays(list(row.values()), schema=_ARROW)
    del codes, doc
    for i in range(0, len(order), 50_000):
        at = order[i : i + 50_000]
        n = len(at)
        row = {name: pa.nulls(n, kind_) for name, kind_ in zip(_ARROW.names, _ARROW.types)}
        row |= {
            "chunk": pa.array(np.full(n, number), pa.int64()),
            "code": pa.array(np.arange(i, i + n), pa.int32()),
            "key": pa.array(keys[at]),
            "kind": pa.array(kind[at], pa.int32()),
            "hits": pa.array(hits[at], pa.int64()),
        }
        yield pa.RecordBatch.from_arrays(list(row.values()), schema=_ARROW)


def chunks(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    mark=None,
    lower: bool = False,
    kinds: Callable | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Write and read back the chunks of ``docs``.

    ``mark`` is a boolean column; ``hits`` counts a word's occurrences in marked
    documents. ``kinds`` gives each occurrence a small number; equal words of
    different kinds then have rows of their own.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        texts, ids, marks = [], [], []
        for batch in batches:
            for i, j, data, _ in W.blocks(batch.column(1), chunk_bytes // 4):
                if size and size + len(data) > chunk_bytes:
                    yield from _chunk(number, texts, ids, marks, lower, kinds)
                    number, size, texts, ids, marks = number + 1, 0, [], [], []
                texts.append(batch.column(1).slice(i, j - i).fill_null("").cast(pa.large_string()))
                ids += batch.column(0).slice(i, j - i).to_pylist()
                marks += batch.column(2).slice(i, j - i).to_pylist()
                size += len(data)
        if texts:
            yield from _chunk(number, texts, ids, marks, lower, kinds)

    flag = F.coalesce(mark, F.lit(False)) if mark is not None else F.lit(False)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), flag.alias("mark"))
    path = scratch_path(docs.sparkSession, "chunks")
    source.mapInArrow(scan, _SCHEMA).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(_SCHEMA).parquet(path)


_PACKED = pa.schema(
    [
        ("chunk", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("docs", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())), ("codes", pa.binary()), ("buckets", pa.binary()),
    ]
)


def packed_chunks(
    docs: DataFrame, id_col: str, text_col: str, buckets: int, chunk_bytes: int = PACKED_BYTES
) -> DataFrame:
    """Write and read back the chunks of ``docs`` with their words packed by bucket.

    A chunk's distinct words are dealt by hash to ``buckets`` rows (``words``: one blob,
    by rising code). Its row of texts has the documents' ids, numbers of words, their
    codes and the bucket of each code.
    """

    def emit(number: int, texts: list[pa.Array], ids: list) -> Iterator[pa.RecordBatch]:
        data, offsets = W.text_arrays(pa.concat_arrays(texts))
        starts, ends, doc = W.bounds(data, offsets)
        codes, unique = pd.factorize(W.hash_words(data, starts, ends))
        order, rank = _by_frequency(codes, len(unique))
        bucket = (unique[order] % np.uint64(buckets)).astype(np.int64)
        at = _first_places(codes, len(unique))[order]
        sizes = np.bincount(doc, minlength=len(ids))
        row = {name: pa.nulls(1, kind) for name, kind in zip(_PACKED.names, _PACKED.types)} | {
            "chunk": pa.array([number], pa.int64()),
            "docs": pa.array([ids], pa.list_(pa.int64())),
            "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "codes": pa.array([pack_ranks(rank[codes])], pa.binary()),
            "buckets": pa.array([pack_codes(bucket)], pa.binary()),
        }
        yield pa.RecordBatch.from_arrays(list(row.values()), schema=_PACKED)
        by_bucket = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in np.flatnonzero(np.diff(edges)):
            mine = at[by_bucket[edges[b] : edges[b + 1]]]
            size = ends[mine] - starts[mine] + 1
            places = np.arange(size.sum()) + np.repeat(starts[mine] - (np.cumsum(size) - size), size)
            blob = np.append(data, np.uint8(10))[places] if ends[mine].max() == len(data) else data[places]
            blob[np.cumsum(size) - 1] = 10
            row = {name: pa.nulls(1, kind) for name, kind in zip(_PACKED.names, _PACKED.types)} | {
                "chunk": pa.array([number], pa.int64()),
                "bucket": pa.array([b], pa.int32()),
                "words": pa.array([squeeze.compress(blob.tobytes())], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(row.values()), schema=_PACKED)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        texts, ids = [], []
        for batch in batches:
            for i, j, data, _ in W.blocks(batch.column(1), chunk_bytes // 4):
                if size and size + len(data) > chunk_bytes:
                    yield from emit(number, texts, ids)
                    number, size, texts, ids = number + 1, 0, [], []
                texts.append(batch.column(1).slice(i, j - i).fill_null("").cast(pa.large_string()))
                ids += batch.column(0).slice(i, j - i).to_pylist()
                size += len(data)
        if texts:
            yield from emit(number, texts, ids)

    fields = (
        "chunk long, bucket int, words binary, docs array<long>, sizes array<long>, codes binary, buckets binary"
    )
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    path = scratch_path(docs.sparkSession, "packed")
    source.mapInArrow(scan, fields).write.option("compression", "uncompressed").parquet(path)
    return docs.sparkSession.read.schema(fields).parquet(path)


def split_words(blob: bytes) -> list[str]:
    """The words of a packed row, by rising code."""
    return zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 40).decode().split("\n")[:-1]


def words_of(table: DataFrame) -> DataFrame:
    return table.where(F.col("code").isNotNull()).select("chunk", "code", "key", "kind", "hits")


def put_back(table: DataFrame, answers: DataFrame, keys: list[str], place: Callable, schema: str) -> DataFrame:
    """``place(texts, words)`` for each chunk, with the answers to its words by code.

    ``texts`` has one row (docs, marks, sizes, codes); ``words`` has ``code`` and the
    columns of ``answers`` that aren't keys.
    """
    found = words_of(table).select(F.col("chunk").alias("at"), "code", *keys).join(answers, keys).drop(*keys)
    texts = table.where(F.col("code").isNull()).select("chunk", "docs", "marks", "sizes", "codes")
    return texts.groupBy("chunk").cogroup(found.groupBy("at")).applyInArrow(place, schema)
