"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, weighted by the bytes they cover in it (count x length).
For each of ``samples`` draws, gamma-distributed numbers that depend on the term alone
pick one (term, quantised weight); two texts pick the same with a probability equal to
the generalised Jaccard similarity of their weights. The fingerprint is 16 bits of each
pick in hexadecimal; likeness is the share of equal ones.

A null or empty text, or one of white space, has no terms and the fingerprint ''; two
such are alike (1), one is unlike any other (0). Rows are ordered by id (null first),
then text, for "the next document"; repeated ids are rows of their own. A table of one
row is followed by itself. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajflow.llm import words as W
from trajflow.llm.components import written

SAMPLES = 64
BLOCK_BYTES = 4 << 20
_ROWS = 16_384
_UNIT = 2.0**-32


def _uniform(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) of each 64-bit hash."""
    return (
        ((x >> np.uint64(32)).astype(np.float64) + 0.5) * _UNIT,
        ((x & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * _UNIT,
    )


def draws(term: np.ndarray, weight: np.ndarray, samples: int) -> np.ndarray:
    """Per item and sample, the logarithm to be minimised; it also names (term, level)."""
    out = np.empty((len(term), samples), np.float32)
    salt = W.mix(np.arange(1, 3 * samples + 1, dtype=np.uint64) * W.ODD).reshape(3, samples)
    log_weight = np.log(weight)[:, None]
    for i in range(0, len(term), _ROWS):
        t = term[i : i + _ROWS, None]
        a, b = _uniform(W.mix(t ^ salt[0]))
        r = -np.log(a * b)
        a, b = _uniform(W.mix(t ^ salt[1]))
        log_c = np.log(-np.log(a * b))
        beta, _ = _uniform(W.mix(t ^ salt[2]))
        level = np.floor(log_weight[i : i + _ROWS] / r + beta)
        out[i : i + _ROWS] = log_c - r * (level - beta) - r
    return out


def sketch(data: np.ndarray, offsets: np.ndarray, samples: int) -> np.ndarray:
    """Fingerprints (uint16, one row a text); rows of texts without words are 0."""
    n = len(offsets) - 1
    out = np.zeros((n, samples), np.uint16)
    starts, ends, doc = W.bounds(data, offsets)
    if not len(starts):
        return out
    codes, unique = pd.factorize(W.hash_words(data, starts, ends))
    size = np.zeros(len(unique), np.int64)
    size[codes] = ends - starts
    pair, count = np.unique(doc * len(unique) + codes, return_counts=True)
    owner, code = pair // len(unique), pair % len(unique)
    item, which = np.unique(code * (1 << 32) + count, return_inverse=True)
    term = item >> 32
    table = draws(unique[term], (item & 0xFFFFFFFF).astype(np.float64) * size[term], samples)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    edge = np.append(first, len(owner))
    step = 0
    while step < len(first):  # some texts at a time, to bound the gathered rows
        to = max(step + 1, int(np.searchsorted(edge, edge[step] + 65_536)))
        to = min(to, len(first))
        rows = table[which[edge[step] : edge[to]]]
        low = np.minimum.reduceat(rows, first[step:to] - edge[step], axis=0)
        bits = W.mix(low.view(np.uint32).astype(np.uint64)) & np.uint64(0xFFFF)
        out[owner[first[step:to]]] = bits.astype(np.uint16)
        step = to
    return out


def _sketches(texts: list[str], samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and whether a text has any words, in blocks."""
    column = pa.array(texts, pa.large_string())
    found, some = [np.empty((0, samples), np.uint16)], [np.empty(0, bool)]
    for _, _, data, offsets in W.blocks(column, BLOCK_BYTES):
        found.append(sketch(data, offsets, samples))
        filled = np.zeros(len(offsets) - 1, bool)
        filled[np.searchsorted(offsets[1:], np.flatnonzero(W.SOLID[data]), "right")] = True
        some.append(filled)
    return np.concatenate(found), np.concatenate(some)


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    return np.where(some_a & some_b, (a == b).mean(axis=1), (some_a == some_b).astype(float))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_FIELDS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compared(ids: list, texts: list[str], following: list[str], samples: int, chained: bool) -> list[pa.Array]:
    """Result columns; if ``chained``, each following text but the last is the next row's."""
    changed = [edited(a, b) for a, b in zip(texts, following)]
    if chained:
        prints, some = _sketches([*texts, following[-1]], samples)
        mine, mine_some, nexts, next_some = prints[:-1], some[:-1], prints[1:], some[1:]
    else:
        mine, mine_some = _sketches(texts, samples)
        nexts, next_some = _sketches(following, samples)
    other, other_some = _sketches(changed, samples)
    columns = [
        ids,
        [len(t) for t in texts],
        [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        [p.astype(">u2").tobytes().hex() if s else "" for p, s in zip(mine, mine_some)],
        [p.astype(">u2").tobytes().hex() if s else "" for p, s in zip(other, other_some)],
        likeness(mine, other, mine_some, other_some),
        likeness(mine, nexts, mine_some, next_some),
    ]
    return [pa.array(c, t) for c, t in zip(columns, _TYPES)]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprint of every text, of its edited form, and likeness to that and to the next text."""
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    ordered = source.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def row(columns: list[pa.Array], kind: str, texts: list) -> pa.RecordBatch:
            n = len(texts)
            more = [pa.array([part] * n, pa.int64()), pa.array([kind] * n, pa.string()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays([*columns, *more], [*_NAMES, "part", "kind", "body"])

        def bare(doc) -> list[pa.Array]:
            return [pa.array([doc], pa.int64()), *(pa.nulls(1, t) for t in _TYPES[1:])]

        held: tuple | None = None
        for batch in batches:
            for i in range(0, len(batch), 2_000):
                ids, texts = (batch.column(c).slice(i, 2_000).to_pylist() for c in (0, 1))
                if held is None:
                    yield row(bare(ids[0]), "head", [texts[0]])
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                if len(ids) > 1:
                    yield row(_compared(ids[:-1], texts[:-1], texts[1:], samples, True), "done", [None] * (len(ids) - 1))
                held = ids[-1], texts[-1]
        if held:
            yield row(bare(held[0]), "tail", [held[1]])

    made = written(ordered.mapInArrow(scan, f"{_FIELDS}, part long, kind string, body string"), "fingerprints")
    # One head and one tail for each partition: the last text of one goes with the first of the next.
    parts = sorted(r.part for r in made.where("kind = 'head'").select("part").collect())
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, next long")
    heads = made.where("kind = 'head'").select(F.col("part").alias("next"), F.col("body").alias("following"))
    tails = made.where("kind = 'tail'").select("doc_id", "body", "part").join(after, "part").join(heads, "next")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays(_compared(ids, texts, following, samples, False), _NAMES)

    last = tails.select("doc_id", "body", "following").mapInArrow(compare, _FIELDS)
    return made.where("kind = 'done'").select(*_NAMES).unionByName(last)
