"""Secret scans: patterns, and dictionary-primed zstandard novelty.

Three kinds are found by pattern (assign, access, hex). A fourth, ``novel``, by
compression: every string of 12 or more characters in a sensitive context (a word such
as "password" or "token" up to 40 characters before, in the same line), also one that an
equals sign sets off from its name. A candidate is reported if zstandard, primed with the
identifier dictionary and the text around it without copies of the candidate, still needs
``least`` bytes or more for each of its characters. The dictionary holds the commonest
identifiers of all candidates' surroundings, counted over all documents, but no word that
is known only from candidates of a single text; its size is a parameter. Spans are code
points, end exclusive; of nested novel ones the outermost is reported.

Null counts as the empty text, which has no spans. Ids may be null or repeated: there
is one result row for each input row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajflow.llm import words as W
from trajflow.llm.components import written

KINDS = ["assign", "access", "hex", "novel"]
BLOCK_BYTES = 4 << 20
AROUND = 512
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Sensitive words as whole parts of an identifier: `api_key` and `secretKey`, but not `monkey` or `passengers`.
_CONTEXT = re.compile(
    r"(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))"
    r"(pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private)?key|auth(?:orization|entication)?|"
    r"cred(?:ential)?|bearer)s?(?:(?![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))",
    re.I | re.A,
)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}", re.A)
_VALUE = re.compile(r"(?<==)[A-Za-z0-9+/_-]{12,}=*", re.A)
#: Characters between a context word and a candidate.
DISTANCE = 40
_HINTS = [b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"cred", b"bearer", b"akia"]
_IS_HEX = np.zeros(256, bool)
_IS_HEX[48:58] = True
_IS_HEX[97:103] = True


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans found by pattern, ordered."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Strings in a sensitive context that may be secrets."""
    ends = sorted(m.end(1) for m in _CONTEXT.finditer(text))
    found = []
    for m in (*_RUN.finditer(text), *_VALUE.finditer(text)) if ends else ():
        last = bisect_right(ends, m.start())
        if last and m.start() - ends[last - 1] <= DISTANCE and "\n" not in text[ends[last - 1] : m.start()]:
            found.append(m.span())
    return sorted(found)


def _with_surroundings(text: str) -> list[dict]:
    """Candidates with the text around them, in which copies of the candidate are blank."""
    out = []
    for s, e in candidates(text):
        string, far = text[s:e], AROUND + e - s
        before = text[max(0, s - far) : s].replace(string, " " * (e - s))[-AROUND:]
        after = text[e : e + far].replace(string, " " * (e - s))[:AROUND]
        out.append({"start": s, "end": e, "string": string, "around": before + after})
    return out


#: Ordinary words that stand ahead of every dictionary, so that a small one has letter statistics too.
STARTER = (
    b"the of and to in is that for it as with was on be by at this from or an are not which have has can will all one "
    b"their more when if other time about into than some only new two may first then each so up out use get set name "
    b"value type data file list user config service system request response error return function class object number "
    b"string index default public static private import const "
)
#: Marginal bytes a character from which a string is reported; ordinary words take up to about 0.7.
LEAST = 0.8


def novelty(string: str, around: str, identifiers: bytes) -> float:
    """Marginal compressed bytes for each character of ``string``.

    The dictionaries and the surroundings are compressed with the string and
    without it. In a frame of that size the compressor codes literals by their
    frequency, so what looks like the text around it is cheap even where
    nothing of it is a copy, and a string of evenly used characters is not.
    """
    press = zstandard.ZstdCompressor(level=19, write_content_size=False)
    prime = STARTER + identifiers + b" " + around.encode() + b" "
    return (len(press.compress(prime + string.encode() + b" ")) - len(press.compress(prime))) / len(string)


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with a hint of any kind, found without looking at them one by one."""
    marks = []
    low = W.LOWER[data].tobytes()
    for hint in _HINTS:
        at = low.find(hint)
        while at >= 0:
            marks.append(at)
            k = int(np.searchsorted(offsets, at, "right"))
            at = low.find(hint, int(offsets[k]) if k < len(offsets) else len(low))  # on to the next text
    other = np.flatnonzero(~_IS_HEX[data])
    edges = np.concatenate([[-1], other, [len(data)]])
    marks += (edges[:-1][np.diff(edges) > 24] + 1).tolist()
    flags = np.zeros(len(offsets) - 1, bool)
    if marks:
        # A run of hex digits may go on over the end of a text, so its neighbours count too.
        ends = edges[1:][np.diff(edges) > 24] - 1
        for at in (np.array(marks, np.int64), ends.astype(np.int64)):
            flags[np.searchsorted(offsets[1:], at, "right").clip(0, len(flags) - 1)] = True
        for a, b in zip(edges[:-1][np.diff(edges) > 24] + 1, ends):
            lo, hi = np.searchsorted(offsets[1:], [a, b], "right")
            flags[lo : hi + 1] = True
    return flags


def _all_spans(found: list[tuple[int, int, int]], maybe, identifiers: bytes, least: float) -> list[tuple[int, int, int]]:
    """Spans found by pattern, and novel candidates that don't lie within one of them or another."""
    novel = []
    for c in sorted(maybe, key=lambda c: (c["start"], -c["end"])):
        inside = any(s <= c["start"] and c["end"] <= e for s, _, e in (*found, *novel[-1:]))
        if not inside and novelty(c["string"], c["around"], identifiers) >= least:
            novel.append((c["start"], KINDS.index("novel"), c["end"]))
    return sorted([*found, *novel])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, pattern spans, candidates with their surroundings."""
    base = "array<struct<start: int, kind: int, end: int>>"
    around = "array<struct<start: int, end: int, string: string, around: string>>"
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    around_type = pa.list_(
        pa.struct([("start", pa.int32()), ("end", pa.int32()), ("string", pa.string()), ("around", pa.string())])
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in W.blocks(batch.column(1), BLOCK_BYTES):
                spans: list[list[dict]] = [[] for _ in range(j - i)]
                maybe: list[list[dict]] = [[] for _ in range(j - i)]
                for k in np.flatnonzero(_suspects(data, offsets)):
                    text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                    spans[k] = [{"start": s, "kind": kind, "end": e} for s, kind, e in patterns(text)]
                    maybe[k] = _with_surroundings(text)
                ids = batch.column(0).slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(spans, base_type), pa.array(maybe, around_type)], ["doc_id", "base", "candidates"]
                )

    return source.mapInArrow(search, f"doc_id long, base {base}, candidates {around}")


def identifier_dictionary(scanned: DataFrame, size: int = 1_000) -> bytes:
    """The commonest identifiers around candidates, the commonest last (nearest for the compressor)."""

    def words_in(column: str):
        return F.flatten(F.transform(column, lambda x: F.regexp_extract_all(x, F.lit("([A-Za-z_]{4,})"), 1)))

    words = scanned.where(F.size("candidates") > 0).select(
        F.xxhash64("candidates").alias("text"), words_in("candidates.string").alias("own"),
        F.explode(words_in("candidates.around")).alias("word"),
    )
    counted = words.groupBy("word").agg(
        F.count("*").alias("count"), F.bool_and(F.array_contains("own", F.col("word"))).alias("own"),
        (F.min("text") == F.max("text")).alias("alone"),
    )
    top = counted.where(~(F.col("own") & F.col("alone"))).orderBy(F.desc("count"), "word").limit(size)
    return " ".join(r.word for r in reversed(top.collect())).encode()


def report(scanned: DataFrame, identifiers: bytes, least: float = LEAST) -> DataFrame:
    """Adds ``spans`` (array of start, kind, end, ordered) to scanned rows: base and novel ones."""

    @F.pandas_udf("array<struct<start: int, kind: int, end: int>>")
    def spans(base: pd.Series, maybe: pd.Series) -> pd.Series:
        out = []
        for found, strings in zip(base, maybe):
            rows = _all_spans([(b["start"], b["kind"], b["end"]) for b in found], strings, identifiers, least)
            out.append([{"start": s, "kind": k, "end": e} for s, k, e in rows])
        return pd.Series(out)

    return scanned.withColumn("spans", spans("base", "candidates")).drop("candidates")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ``base`` and ``spans`` (start, kind number, end)."""
    scanned = written(scan(docs, id_col, text_col), "scanned")
    return report(scanned, identifier_dictionary(scanned))


def _joined(spans: str):
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digests(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)

    def number(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *(number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"),
    )


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", least: float = LEAST) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark``; all rows and columns stay."""
    scanned = scan(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("body")), "id", "body")
    identifiers = identifier_dictionary(written(scanned.where(F.size("candidates") > 0), "scanned"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        out = texts.tolist()
        column = pa.array(texts, pa.large_string(), from_pandas=True)
        for i, _, data, offsets in W.blocks(column, BLOCK_BYTES):
            for k in np.flatnonzero(_suspects(data, offsets)) + i:
                text, done, at = out[k], [], 0
                for start, _, end in _all_spans(patterns(text), _with_surroundings(text), identifiers, least):
                    if start >= at:
                        done += [text[at:start], mark]
                    at = max(at, end)
                out[k] = "".join(done) + text[at:]
        return pd.Series(out)

    return docs.select(*(cut(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
