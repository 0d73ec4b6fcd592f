"""BPE encoding and decoding over a distinct-word table.

Words are split at ASCII white space, where the tokenizer (which drops white space
and never looks across it) always splits too. Each distinct word of the corpus is
encoded once; its ids come back to the positions of the word in every document. Words
and ids travel packed, a row for each chunk of documents and bucket of words.
Decoding looks each id's piece up in the vocabulary and joins the pieces as the
tokenizers library does for a file without decoder: by one space.

Null text counts as empty and has no ids. Rows with a null or a repeated document id
are encoded like any others, one result row for each input row. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajflow.llm import wordtable

#: Text bytes of a chunk whose ids are cut into sequences: each of its pieces is a row in memory.
SEQUENCE_BYTES = 16 << 20
#: Words a task keeps the ids of, and the characters of the longest such word.
REMEMBERED = 2_000_000
LONG = 256


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file; every executor has the files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_words(packed: DataFrame, path: str, buckets: int) -> DataFrame:
    """``chunk``, ``bucket``, ``counts`` and ``ids`` (packed numbers) of rows of packed words.

    All of a bucket's words meet in one task, which encodes each of them once; only a
    word that is very long, or of a task with more than ``REMEMBERED``, may be encoded
    again for another chunk.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _tokenizer(path), {}
        for batch in batches:
            for chunk, bucket, blob in zip(*(c.to_pylist() for c in batch.columns)):
                words = wordtable.split_words(blob)
                fresh = [w for w in words if w not in known]
                if len(known) + len(fresh) > REMEMBERED:
                    known, fresh = {}, words
                for i in range(0, len(fresh), 10_000):
                    part = fresh[i : i + 10_000]
                    found = tokenizer.encode_batch_fast(part, add_special_tokens=False)
                    known.update(zip(part, (x.ids for x in found)))
                lists = [known[w] for w in words]
                for w in fresh:
                    if len(w) > LONG:
                        del known[w]
                ids = np.fromiter(itertools.chain.from_iterable(lists), np.uint32)
                counts = np.fromiter(map(len, lists), np.uint32, len(lists))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()),
                        pa.array([wordtable.pack_codes(counts)], pa.binary()),
                        pa.array([wordtable.pack_codes(ids)], pa.binary()),
                    ],
                    ["at", "bucket", "counts", "ids"],
                )

    rows = packed.where(F.col("bucket").isNotNull()).select("chunk", "bucket", "words")
    return rows.repartition(buckets, "bucket").mapInArrow(encode, "at long, bucket int, counts binary, ids binary")


class Placed:
    """The ids of one chunk's documents, in order."""

    def __init__(self, texts: pa.Table, words: pa.Table):
        self.docs = texts["docs"][0].as_py()
        self.ends = np.cumsum(np.array(texts["sizes"][0].as_py(), np.int64))
        self.codes = wordtable.unpack_ranks(texts["codes"][0].as_py())
        bucket = wordtable.unpack_codes(texts["buckets"][0].as_py())
        order = np.argsort(words["bucket"].to_numpy())
        counts, ids = (
            np.concatenate([np.empty(0, "<u4"), *(wordtable.unpack_codes(column[int(i)].as_py()) for i in order)])
            for column in (words["counts"], words["ids"])
        )
        self.flat = ids.astype("<u4")
        ends = np.cumsum(counts, dtype=np.int64)
        self.first, self.size = np.empty(len(bucket), np.int64), np.empty(len(bucket), np.int64)
        code = np.argsort(bucket, kind="stable")
        self.first[code], self.size[code] = ends - counts, counts

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        begin = 0
        for doc, end in zip(self.docs, self.ends, strict=True):
            codes = self.codes[begin:end]
            size = self.size[codes]
            place = np.arange(size.sum()) + np.repeat(self.first[codes] - (np.cumsum(size) - size), size)
            yield doc, self.flat[place]
            begin = end


def encoded(
    docs: DataFrame, use: Callable[[int | None, np.ndarray], Iterator[tuple]], fields: T.StructType,
    path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = wordtable.PACKED_BYTES,
) -> DataFrame:
    """Rows that ``use(doc id, ids)`` gives for each document; a task places ``chunk_bytes`` of text at a time."""
    spark = docs.sparkSession
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = wordtable.packed_chunks(docs, id_col, text_col, buckets, chunk_bytes)
    answers = encode_words(table, path, buckets)
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in fields])

    def place(texts: pa.Table, words: pa.Table) -> pa.Table:
        rows = [row for doc, ids in Placed(texts, words) for row in use(doc, ids)]
        columns = list(zip(*rows)) if rows else [()] * len(schema)
        return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    texts = table.where(F.col("bucket").isNull()).select("chunk", "docs", "sizes", "codes", "buckets")
    both = texts.groupBy("chunk").cogroup(answers.groupBy("at"))
    return both.applyInArrow(place, fields.simpleString()[len("struct<") : -1])


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and its ``ids``."""

    def use(doc, ids):
        yield doc, ids.astype(np.int32)

    fields = T.StructType().add("doc_id", "long").add("ids", T.ArrayType(T.IntegerType()))
    return encoded(docs, use, fields, path or vocabulary(), id_col, text_col)


def pieces(spark, path: str | None = None) -> DataFrame:
    """``id`` and ``piece`` of the vocabulary, whose file bounds its size."""
    tokenizer = _tokenizer(path or vocabulary())
    table = sorted((i, p) for p, i in tokenizer.get_vocab(with_added_tokens=True).items())
    return spark.createDataFrame(table, "id int, piece string")


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` of rows of ids, by a join with the vocabulary's pieces.

    Each row needs an id of its own. A row without ids gives an empty text, an id
    outside the vocabulary gives no piece, as in the tokenizers library.
    """
    spread = rows.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(ids_col).alias("pos", "id"))
    named = spread.join(F.broadcast(pieces(rows.sparkSession, path)), "id", "left")
    ordered = F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece"))))
    return named.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), " ").alias("text"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Ids and decoded text of every document as lengths and digests.

    The decoded text is put together where the ids are, by a lookup of the pieces in
    the vocabulary's table, so that whole texts aren't shuffled again.
    """
    path = path or vocabulary()
    tokenizer = _tokenizer(path)
    last = max(tokenizer.get_vocab(with_added_tokens=True).values())
    names = [tokenizer.id_to_token(i) for i in range(last + 1)]
    table = [(str(i), "" if p is None else p) for i, p in enumerate(names)]

    def use(doc, ids):
        found = [table[i] for i in ids.tolist()]
        numbers = " ".join([x[0] for x in found]).encode()
        text = " ".join([x[1] for x in found]).encode()
        yield doc, len(ids), hashlib.sha256(numbers).hexdigest(), hashlib.sha256(text).hexdigest()

    fields = (
        T.StructType().add("doc_id", "long").add("n_tokens", "long")
        .add("ids_sha256", "string").add("decoded_sha256", "string")
    )
    return encoded(docs, use, fields, path)


def sequences(docs: DataFrame, end_id: int, limit: int, path: str | None = None) -> DataFrame:
    """Token sequences with ``end_id`` after each document, cut into pieces of ``limit``."""

    def use(doc, ids):
        ids = np.append(ids.astype("<u4"), np.uint32(end_id)).astype("<u4")
        for piece, start in enumerate(range(0, len(ids), limit)):
            part = ids[start : start + limit]
            yield doc, piece, start, len(part), zlib.crc32(part.tobytes())

    fields = (
        T.StructType().add("doc_id", "long").add("piece", "integer").add("start", "long")
        .add("length", "long").add("ids_crc32", "long")
    )
    return encoded(docs, use, fields, path or vocabulary(), chunk_bytes=SEQUENCE_BYTES)
