"""Language of whole texts: script ranges, then Viterbi over words.

Training counts hashed byte trigrams (with word ends) and scripts of words for each
language of the labelled rows, over all of them. A word's score for a language is the
log-likelihood of its trigrams; a language that (nearly) never used the word's script
in training is no candidate for it. Viterbi with a penalty for every switch then gives
each word a language, so mixed texts come out as spans; the text's language is the one
with most letters, its score the share of letters it has.

The model is languages x (2 ** 15 + scripts) numbers, whatever the input's size. Null
texts and texts without a letter are ``und`` with score 0, also where nothing was
learned. Rows without language teach nothing; ids may be null or repeated, and other
columns are ignored, whatever their names. Ties go to the language first in order.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajflow.llm import words as W

SLOTS = 1 << 15
BLOCK_BYTES = 2 << 20
UNKNOWN = "und"
#: First code points of script ranges (fixed values), and the script that begins there. Letters in a range
#: without script count as "other"; what is a letter, the Unicode category says.
RANGES = [
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"),
    (0x00AA, "latin"), (0x00AB, "none"), (0x00B5, "latin"), (0x00B6, "none"), (0x00BA, "latin"),
    (0x00BB, "none"), (0x00C0, "latin"), (0x0250, "latin"), (0x02B0, "none"), (0x0370, "greek"),
    (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "none"), (0x2C00, "other"), (0x3000, "none"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "none"), (0xF900, "han"), (0xFB00, "other"), (0xFE00, "none"), (0x20000, "han"),
]
SCRIPTS = list(dict.fromkeys(name for _, name in RANGES))
_FIRST = np.array([first for first, _ in RANGES])
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in RANGES])


@functools.cache
def _script_of() -> np.ndarray:
    """Script number of every code point that is a letter, 0 of the others."""
    points = np.arange(sys.maxunicode + 1)
    letter = np.fromiter((chr(p).isalpha() for p in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    script = _SCRIPT[np.searchsorted(_FIRST, points, "right") - 1]
    return np.where(letter, np.where(script == 0, SCRIPTS.index("other"), script), 0)


def _scripts(data: np.ndarray) -> np.ndarray:
    """Script number at the first byte of every letter, 0 elsewhere."""
    ascii_ = np.zeros(256, np.int64)
    ascii_[:128] = _script_of()[:128]
    out = ascii_[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        a, b, c, d = (wide[lead + k] for k in range(4))
        point = np.where(
            a < 0xE0, (a & 31) << 6 | (b & 63),
            np.where(
                a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | (c & 63),
                (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | (d & 63),
            ),
        )
        out[lead] = _script_of()[np.minimum(point, sys.maxunicode)]
    return out


def parts(data: np.ndarray, offsets: np.ndarray):
    """Words' starts, texts, trigram slots by byte, scripts and letters."""
    starts, ends, doc = W.bounds(data, offsets)
    plain = np.where(W.SOLID[data], W.LOWER[data], 32).astype(np.uint64)
    before, after = np.roll(plain, 1), np.roll(plain, -1)
    before[offsets[:-1][offsets[:-1] < len(data)]] = 32
    after[offsets[1:][offsets[1:] > 0] - 1] = 32
    slot = (W.mix(before << np.uint64(16) | plain << np.uint64(8) | after) & np.uint64(SLOTS - 1)).astype(np.int64)
    script = _scripts(data)
    if not len(starts):
        return starts, ends, doc, slot, starts, starts
    letters = np.add.reduceat(script > 0, starts, dtype=np.int64)
    return starts, ends, doc, slot, np.maximum.reduceat(script, starts), letters


class Model:
    """Languages with their log-likelihoods by slot and the scripts they use."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.names = sorted({r[0] for r in rows})
        number = {name: k for k, name in enumerate(self.names)}
        counts = np.zeros((SLOTS + len(SCRIPTS), len(self.names)))
        for name, slot, n in rows:
            counts[slot, number[name]] = n
        grams = counts[:SLOTS] + 0.5
        self.table = np.log(grams / grams.sum(axis=0)).astype(np.float32)
        used = counts[SLOTS:]
        self.allowed = used >= 0.001 * np.maximum(used.sum(axis=0), 1)
        self.allowed[0] = True
        self.allowed[~self.allowed.any(axis=1)] = True


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all rows with text and language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for i, j, data, offsets in W.blocks(batch.column(0), BLOCK_BYTES):
                starts, ends, doc, slot, script, _ = parts(data, offsets)
                langs = np.array(batch.column(1).slice(i, j - i).to_pylist(), dtype=object)
                by_byte = np.searchsorted(offsets[1:], np.arange(len(data)), "right")
                solid = W.SOLID[data]
                for name in set(langs):
                    total = totals.setdefault(name, np.zeros(SLOTS + len(SCRIPTS), np.int64))
                    mine = langs == name
                    total[:SLOTS] += np.bincount(slot[mine[by_byte] & solid], minlength=SLOTS)
                    total[SLOTS:] += np.bincount(script[mine[doc]], minlength=len(SCRIPTS))
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                ["lang", "slot", "n"],
            )

    known = docs.select(text_col, lang_col).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = known.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in rows.collect()])  # languages x slots numbers


def viterbi(scores: np.ndarray, first: np.ndarray, size: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word, for all texts at once; ``first`` and ``size`` say whose words."""
    n = scores.shape[1]
    label = np.zeros(len(scores), np.int16)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # texts with more words than t
    best = np.zeros((len(size), n), np.float32)
    origin = np.zeros((len(scores), n), np.int16)
    same = np.arange(n, dtype=np.int16)
    for t in range(longest):
        a = active[t]
        at = first[:a] + t
        now = best[:a]
        if t:
            top = now.argmax(axis=1)
            high = now[np.arange(a), top][:, None] - np.float32(penalty)
            origin[at] = np.where(now >= high, same, top[:, None])
            now = np.maximum(now, high)
            now -= now.max(axis=1, keepdims=True)
        best[:a] = now + scores[at]
    current = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = first[:a] + t
        label[at] = current[:a]
        if t:
            current[:a] = origin[at, current[:a]]
    return label


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0,
    spans: bool = True,
) -> DataFrame:
    """Per row: doc_id, lang_pred, score and, if wanted, ``spans`` of words by language."""
    kinds = [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]
    fields = "doc_id long, lang_pred string, score double"
    if spans:
        kinds.append(("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
        fields += ", spans array<struct<start: bigint, end: bigint, lang: string>>"
    schema = pa.schema(kinds)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(model.names)
        for batch in batches:
            rows, base = len(batch), 0
            scores, docs_of, letters_of = [], [], []
            for i, j, data, offsets in W.blocks(batch.column(1), BLOCK_BYTES):
                starts, ends, doc, slot, script, letters = parts(data, offsets)
                if len(starts) and count:
                    gram = model.table[slot]
                    gram[~W.SOLID[data]] = 0
                    found = np.add.reduceat(gram, starts, axis=0)
                    found[~model.allowed[script]] -= 1e3
                    found[letters == 0] = 0
                    scores.append(found)
                    docs_of.append(doc + i)
                    letters_of.append(letters)
            if scores:
                scores, doc, letters = (np.concatenate(x) for x in (scores, docs_of, letters_of))
                size = np.bincount(doc, minlength=rows)
                first = np.cumsum(size) - size
                label = viterbi(scores, first, size, penalty)
                share = np.bincount(doc * count + label, weights=letters, minlength=rows * count).reshape(rows, count)
                total = share.sum(axis=1)
                top = share.argmax(axis=1)
                value = np.where(total > 0, share[np.arange(rows), top] / np.maximum(total, 1), 0.0)
                names = [model.names[k] if s else UNKNOWN for k, s in zip(top, total > 0)]
            else:
                value, names = np.zeros(rows), [UNKNOWN] * rows
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(value, pa.float64())]
            if spans:
                columns.append(pa.array(_spans(doc, label, first, model.names, rows) if len(scores) else [[]] * rows, schema.field("spans").type))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan, fields)


def _spans(doc, label, first, names, rows) -> list[list[dict]]:
    """Runs of words of one language in each text, by word number, end exclusive."""
    out: list[list[dict]] = [[] for _ in range(rows)]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
    at = np.flatnonzero(new)
    for start, end in zip(at, np.append(at[1:], len(doc))):
        d = doc[start]
        out[d].append({"start": int(start - first[d]), "end": int(end - first[d]), "lang": names[label[start]]})
    return out
