"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal.

Features are the share of a text's words that are a given n-gram: words (1, 2), word
shapes (1, 2, 3; runs of capitals, other letters and digits shrink to one sign each)
and repetitions of the word before, hashed into 2 ** 18 places. The weights are fitted
by follow-the-regularised-leader updates in a fixed order on a bounded sample of the
labelled rows (``sample`` rows, drawn by hash), which is the only bound here. Scoring
is one pass over all whole texts: a sparse dot product of shares and weights.

Null and empty texts have no features and score as the bias does. A document labelled
more than once takes its lowest label; null labels and ids are left out of the fit.
Without any labels every score is 0.5. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajflow.llm import words as W

PLACES = 1 << 18
#: Labelled rows that the fit uses at most (in expectation).
SAMPLE = 8_000
BLOCK_BYTES = 2 << 20

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[48:58] = ord("0")


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's shape."""
    kind = _SHAPE[data]
    new = W.SOLID[data]
    new[1:] &= kind[1:] != kind[:-1]
    new[starts] = True
    at = np.flatnonzero(new)
    first = np.searchsorted(at, starts)
    return W.hash_words(kind[at], first, np.append(first[1:], len(at)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and place of every n-gram occurrence, by text; words of each text."""
    starts, ends, doc = W.bounds(data, offsets)
    n = np.bincount(doc, minlength=len(offsets) - 1)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), n
    word, shape = W.hash_words(data, starts, ends), _shapes(data, starts, ends)
    again = np.flatnonzero((word[1:] == word[:-1]) & (doc[1:] == doc[:-1])) + 1
    docs, places = [doc[again]], [np.full(len(again), 7, np.int64)]
    for family, (hashes, size) in enumerate([(word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3)]):
        at, found = W.windows(hashes, doc, size)
        docs.append(doc[at])
        places.append((W.mix(found + np.uint64(family)) & np.uint64(PLACES - 1)).astype(np.int64))
    doc, place = np.concatenate(docs), np.concatenate(places)
    return doc, place, n


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, alpha=0.5, beta=1.0, l1=1e-4, l2=1e-4) -> np.ndarray:
    """Weights by place, the bias last, after FTRL-proximal updates in the given order."""
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for places, shares, label in rows:
            w = weights(z[places], n[places])
            gradient = (_sigmoid(w @ shares) - label) * shares
            square = n[places] + gradient**2
            z[places] += gradient - (np.sqrt(square) - np.sqrt(n[places])) / alpha * w
            n[places] = square
    return weights(z, n).astype(np.float32)


def fit(labelled: DataFrame, sample: int = SAMPLE, epochs: int = 4) -> np.ndarray:
    """Weights from rows of ``doc_id``, ``text``, ``label``, already bounded by ``sample``."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, j, data, offsets in W.blocks(batch.column(1), BLOCK_BYTES):
                doc, place, n = features(data, offsets)
                key, count = np.unique(doc * (PLACES + 1) + place, return_counts=True)
                cut = np.searchsorted(key, np.arange(j - i + 1) * (PLACES + 1))
                out = []
                for k in range(j - i):
                    at = slice(cut[k], cut[k + 1])
                    places = (key[at] - k * (PLACES + 1)).astype("<i4")
                    shares = (count[at] / max(1, n[k])).astype("<f4")
                    out.append((places.tobytes(), shares.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        pa.array([x[0] for x in out], pa.binary()),
                        pa.array([x[1] for x in out], pa.binary()),
                    ],
                    ["doc_id", "label", "places", "shares"],
                )

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for row in batch.itertuples():
                places = np.append(np.frombuffer(row.places, "<i4"), PLACES)
                shares = np.append(np.frombuffer(row.shares, "<f4"), np.float32(1))
                rows.append((places, shares.astype(np.float64), row.label))
        if rows:
            yield pd.DataFrame({"weights": [ftrl(rows, epochs).tobytes()]})

    found = labelled.select("doc_id", "text", F.col("label").cast("int")).mapInArrow(
        extract, "doc_id long, label int, places binary, shares binary"
    )
    ordered = found.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", "label"))
    got = ordered.mapInPandas(train, "weights binary").first()
    return np.frombuffer(got.weights, np.float32) if got else np.zeros(PLACES + 1, np.float32)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, sample: int = SAMPLE) -> DataFrame:
    """Labelled documents for ``fit``; ``usable`` is a condition on ``doc_id``."""
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("label"))
    )
    share = min(1.0, sample / max(1, marks.count()))
    drawn = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(drawn, "doc_id")


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in W.blocks(batch.column(1), BLOCK_BYTES):
                doc, place, n = features(data, offsets)
                total = np.bincount(doc, weights=weights[place], minlength=j - i)
                value = _sigmoid(weights[-1] + total / np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(value, pa.float64())], ["doc_id", "score"]
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan, "doc_id long, score double")


def accepted(docs: DataFrame, weights: np.ndarray, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, with all their columns."""

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        out = []
        for _, _, data, offsets in W.blocks(pa.array(text, pa.string(), from_pandas=True), BLOCK_BYTES):
            doc, place, n = features(data, offsets)
            total = np.bincount(doc, weights=weights[place], minlength=len(offsets) - 1)
            out.append(_sigmoid(weights[-1] + total / np.maximum(n, 1)) >= least)
        return pd.Series(np.concatenate(out) if out else np.empty(0, bool))

    return docs.where(good(docs[text_col]))
