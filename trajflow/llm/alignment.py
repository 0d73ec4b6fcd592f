"""Alignment of two tokenizers over a corpus, by inverted bitmaps of token pairs.

Both tokenizers cut the same bytes. A pair of tokens is linked where their byte ranges
overlap; places where both end cut a text into groups. For every pair of ids the
documents that hold it linked are a compressed bitmap, kept in containers of one chunk
of documents each: sorted 16-bit numbers, or plain bits where these are shorter. A pair
that a document links several times is in multiplicity planes besides, which hold the
binary digits of the further times. Containers of different chunks hold different
documents, so OR-ing them is setting them side by side and their set bits add up: to
the pair's number of documents, and with the planes' weights to its number of links.
Joined with those counts, the postings return each document's scores.

Texts are cut into units in front of a space that follows another character and
precedes a visible one. Neither tokenizer has a token across such a place, so each
distinct unit of a chunk is encoded and aligned once. A null or empty text has no
tokens, and neither has one whose joined tokens differ from a space and the text; their
numbers are 0 and their groups ''. Rows with a null or repeated id are documents of
their own. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajflow.llm import words as W
from trajflow.llm.components import written

#: Text bytes and documents of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20
CHUNK_DOCS = 1 << 16
#: Units encoded at a time.
_AT_ONCE = 20_000
#: First bytes of characters before which a space isn't a cut: white space, and those that white space may begin with.
_OPEN = np.ones(256, dtype=bool)
_OPEN[[*W.SPACES, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; every executor has the files."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Side:
    """One tokenizer: ids of units, and the bytes of each id."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.data[np.arange(size.sum()) + np.repeat(self.first[ids] - (np.cumsum(size) - size), size)]


class ByteLevel(_Side):
    """A byte-level BPE file of the tokenizers library; special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        alphabet = {chr(b): b for b in shown}
        alphabet |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        pieces = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        super().__init__([bytes(alphabet[c] for c in p) if set(p) <= alphabet.keys() else p.encode() for p in pieces])

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]


class Pieces(_Side):
    """A sentencepiece model, which puts a space before what it encodes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__(
            [
                bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in enumerate(names)
            ]
        )

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.model.encode([u[1:] for u in units], num_threads=1)


def units(column: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The units of a space and each text, in order, and each text's number of them. No text is empty."""
    empty, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    spaced = pc.binary_join_element_wise(empty, column.cast(pa.large_string()), space)
    data, offsets = W.text_arrays(spaced)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-2] = (data[1:-1] == 32) & (data[:-2] != 32) & _OPEN[data[2:]]
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    array = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data))
    return array, np.diff(np.searchsorted(edges, offsets))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, counts.sum()), counts


class Aligned:
    """Units encoded by both sides: validity, numbers, groups as text, and links by unit."""

    def __init__(self, a: _Side, b: _Side, names: list[str]):
        found = [self._block(a, b, names[i : i + _AT_ONCE]) for i in range(0, len(names), _AT_ONCE)]
        self.valid, self.n_a, self.n_b, self.n_groups, self.n_links, pairs = (
            np.concatenate([f[k] for f in found]) for k in range(6)
        )
        self.groups = list(itertools.chain.from_iterable(f[6] for f in found))
        # Pairs of each unit with the times they are linked in it.
        owner = np.repeat(np.arange(len(names), dtype=np.int64), self.n_links)
        order = np.lexsort((pairs, owner))
        owner, pairs = owner[order], pairs[order]
        head = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (pairs[1:] != pairs[:-1]))[: len(owner)])
        self.pair, self.times = pairs[head], np.diff(np.append(head, len(owner)))
        self.first = np.searchsorted(owner[head], np.arange(len(names) + 1))

    @staticmethod
    def _block(a: _Side, b: _Side, names: list[str]):
        sizes = np.array([len(n.encode()) for n in names], np.int64)
        text = np.frombuffer("".join(names).encode(), np.uint8)
        (ids_a, n_a), (ids_b, n_b) = _flat(a.encode(names)), _flat(b.encode(names))
        sides = [(a, ids_a, n_a), (b, ids_b, n_b)]
        owner = np.arange(len(names))
        valid = np.ones(len(names), bool)
        for side, ids, n in sides:
            valid &= np.bincount(np.repeat(owner, n), weights=side.size[ids], minlength=len(names)) == sizes
        for side, ids, n in sides:
            right = side.joined(ids[np.repeat(valid, n)]) == text[np.repeat(valid, sizes)]
            wrong = np.bincount(np.repeat(owner[valid], sizes[valid])[~right], minlength=len(names)) > 0
            valid = valid & ~wrong
        ids_a, ids_b = ids_a[np.repeat(valid, n_a)], ids_b[np.repeat(valid, n_b)]
        n_a, n_b, sizes = n_a * valid, n_b * valid, sizes * valid
        end_a, end_b = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])
        total = int(sizes.sum())
        ends_a, ends_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        ends_a[end_a], ends_b[end_b] = True, True
        # A link is a stretch between neighbouring ends, of whichever side.
        ends = np.flatnonzero(ends_a | ends_b)
        both = ends_a & ends_b
        pairs = (ids_a[np.cumsum(ends_a)[ends - 1]] * len(b.size) + ids_b[np.cumsum(ends_b)[ends - 1]]) if total else ends
        unit = np.searchsorted(np.cumsum(sizes), ends, "left")
        n_links = np.bincount(unit, minlength=len(names))
        n_groups = np.bincount(unit[both[ends]], minlength=len(names))
        # Order of the groups' text: all of a group's A ids, then its B ids.
        before = np.cumsum(both)
        group_a, group_b = before[end_a - 1], before[end_b - 1]
        count = int(before[-1]) if total else 0
        a_until = np.cumsum(np.bincount(group_a, minlength=count))
        b_before = np.cumsum(np.bincount(group_b, minlength=count)) - np.bincount(group_b, minlength=count)
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        codes[np.arange(len(ids_a)) + b_before[group_a]] = ids_a * 3 + both[end_a]
        codes[np.arange(len(ids_b)) + a_until[group_b]] = ids_b * 3 + 2 * both[end_b]
        known = {c: f"{c // 3}{',|;'[c % 3]}" for c in np.unique(codes).tolist()}
        shown = [known[c] for c in codes.tolist()]
        edges = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        groups = ["".join(shown[i:j]) for i, j in zip(edges, edges[1:])]
        return valid, n_a, n_b, n_groups, n_links, pairs, groups


_FIELDS = (
    "chunk long, pair long, plane int, dense boolean, bits binary, "
    "local int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
)
_ARROW = pa.schema(
    [
        ("chunk", pa.int64()), ("pair", pa.int64()), ("plane", pa.int32()), ("dense", pa.bool_()), ("bits", pa.binary()),
        ("local", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
    ]
)


def _rows(chunk: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    full = {f.name: pa.nulls(n, f.type) for f in _ARROW} | {"chunk": pa.array(np.full(n, chunk, np.int64))}
    full |= {k: v if isinstance(v, pa.Array) else pa.array(v, _ARROW.field(k).type) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([full[f.name] for f in _ARROW], schema=_ARROW)


def _plane(pair: np.ndarray, local: np.ndarray, plane: int, docs: int) -> dict:
    """One container row for each pair; (pair, local) are distinct and sorted."""
    head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
    size = np.diff(np.append(head, len(pair)))
    dense = 2 * size > -(-docs // 8)
    numbers = local.astype("<u2").tobytes()
    bits = [numbers[2 * i : 2 * (i + n)] for i, n in zip(head.tolist(), size.tolist())]
    for r in np.flatnonzero(dense):
        row = np.zeros(docs, np.uint8)
        row[local[head[r] : head[r] + size[r]]] = 1
        bits[r] = np.packbits(row, bitorder="little").tobytes()
    return {"pair": pair[head], "plane": np.full(len(head), plane, np.int32), "dense": dense, "bits": bits}


def planes(pair: np.ndarray, local: np.ndarray, times: np.ndarray, docs: int) -> Iterator[dict]:
    """Plane 0 has the documents of each pair; plane i + 1 those whose further times have the binary digit i."""
    yield _plane(pair, local, 0, docs)
    further = times - 1
    for digit in range(int(further.max(initial=0)).bit_length()):
        has = ((further >> digit) & 1).astype(bool)
        if has.any():
            yield _plane(pair[has], local[has], digit + 1, docs)


def _chunk(a: _Side, b: _Side, number: int, texts: list[pa.Array], ids: list, digest: bool) -> Iterator[pa.RecordBatch]:
    column = pa.concat_arrays(texts)
    full = np.flatnonzero(np.diff(W.text_arrays(column)[1]))
    n, codes, sizes = len(ids), np.empty(0, np.int64), np.zeros(len(ids), np.int64)
    aligned = None
    if len(full):
        array, sizes[full] = units(column.take(pa.array(full)))
        table = array.dictionary_encode()
        codes = table.indices.to_numpy().astype(np.int64)
        aligned = Aligned(a, b, table.dictionary.to_pylist())
        owner = np.repeat(np.arange(n), sizes)
        bad = np.bincount(owner[~aligned.valid[codes]], minlength=n) > 0
        whole = ~bad[owner]
        codes, sizes = codes[whole], np.where(bad, 0, sizes)
    owner = np.repeat(np.arange(n), sizes)
    shown, low = [], 0
    names = aligned.groups if aligned else []
    for high in np.cumsum(sizes).tolist():
        text = "".join([names[c] for c in codes[low:high].tolist()])[:-1]
        shown.append(hashlib.sha256(text.encode()).hexdigest() if digest and text else text)
        low = high
    numbers = {
        k: np.bincount(owner, weights=getattr(aligned, k)[codes], minlength=n).astype(np.int64) if aligned else sizes
        for k in ("n_a", "n_b", "n_groups", "n_links")
    }
    step = 8192
    for i in range(0, n, step):
        cut = slice(i, i + step)
        yield _rows(
            number, local=np.arange(i, min(n, i + step), dtype=np.int32), doc_id=ids[cut], groups=shown[cut],
            **{k: v[cut] for k, v in numbers.items()},
        )
    if not len(codes):
        return
    # Times of each unit in each document, then of each pair.
    unit = len(aligned.valid)
    keys, times = np.unique(owner * unit + codes, return_counts=True)
    doc, code = keys // unit, keys % unit
    width = aligned.first[code + 1] - aligned.first[code]
    place = np.arange(width.sum()) + np.repeat(aligned.first[code] - (np.cumsum(width) - width), width)
    links = aligned.times[place] * np.repeat(times, width)
    posting = (aligned.pair[place] << 16) | np.repeat(doc, width)
    order = np.argsort(posting, kind="stable")
    posting, links = posting[order], links[order]
    head = np.flatnonzero(np.append(True, posting[1:] != posting[:-1]))
    links = np.add.reduceat(links, head)
    pair, local = posting[head] >> 16, posting[head] & 0xFFFF
    for rows in planes(pair, local, links, n):
        for i in range(0, len(rows["pair"]), 1 << 16):
            yield _rows(number, **{k: v[i : i + (1 << 16)] for k, v in rows.items()})


def postings(
    docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text",
    digest: bool = False, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Write and read back the containers (``pair`` not null) and the documents of every chunk.

    A document's ``groups`` are `a1,a2|b1;a3|b2`, or with ``digest`` the SHA-256 of that.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ByteLevel(bytes_path), Pieces(pieces_path)
        number, size, texts, ids = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            for i, j, data, _ in W.blocks(batch.column(1), chunk_bytes // 8):
                if size and (size + len(data) > chunk_bytes or len(ids) + j - i > CHUNK_DOCS):
                    yield from _chunk(a, b, number, texts, ids, digest)
                    number, size, texts, ids = number + 1, 0, [], []
                texts.append(batch.column(1).slice(i, j - i).fill_null("").cast(pa.large_string()))
                ids += batch.column(0).slice(i, j - i).to_pylist()
                size += len(data) + 1
        if ids:
            yield from _chunk(a, b, number, texts, ids, digest)

    return written(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan, _FIELDS), "postings")


def _set_bits():
    return F.when(F.col("dense"), F.bitmap_count("bits")).otherwise((F.octet_length("bits") / 2).cast("long"))


def pair_counts(table: DataFrame, pieces: int) -> DataFrame:
    """``pair, a, b, docs, links, best``: corpus-wide counts; ``best`` where ``docs`` is the highest of the A id."""
    weight = F.when(F.col("plane") < 2, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    one = table.where("pair IS NOT NULL").select("pair", "plane", _set_bits().alias("n"), weight.alias("weight"))
    counts = one.groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("docs"),
        F.sum(F.col("n") * F.col("weight")).alias("links"),
    ).select("pair", F.expr(f"pair div {pieces}").alias("a"), F.expr(f"pair % {pieces}").alias("b"), "docs", "links")
    counts = written(counts, "pairs")
    top = counts.groupBy("a").agg(F.max("docs").alias("top"))
    return counts.join(top, "a").select("pair", "a", "b", "docs", "links", (F.col("docs") == F.col("top")).alias("best"))


def _returned(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
    """Scores of one chunk's documents from its containers with their pairs' counts."""
    docs = docs.sort_by("local")
    n = docs.num_rows
    total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    plane = found["plane"].to_numpy()
    weight = np.where(plane < 2, 1, np.int64(1) << np.maximum(plane - 1, 0).astype(np.int64))
    count, top = found["docs"].to_numpy() * weight, found["best"].to_numpy() * weight
    dense = found["dense"].to_numpy()
    bits = found["bits"].combine_chunks()
    sparse = bits.filter(pa.array(~dense))
    data, offsets = W.text_arrays(sparse)
    local = np.frombuffer(data.tobytes(), "<u2").astype(np.int64)
    size = np.diff(offsets) // 2
    for out, value in ((total, count), (best, top)):
        np.add.at(out, local, np.repeat(value[~dense], size))
    for r in np.flatnonzero(dense):
        row = np.unpackbits(np.frombuffer(bits[int(r)].as_buffer(), np.uint8), count=n, bitorder="little")
        total += row * count[r]
        best += row * top[r]
    keep = [docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table(
        [*keep, pa.array(best), pa.array(total), docs["groups"]],
        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
    )


def scores(table: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document: numbers of tokens, groups and links, ``n_best``, ``count_sum`` and ``groups``."""
    found = table.where("pair IS NOT NULL").select("chunk", "pair", "plane", "dense", "bits")
    # Both grow with the corpus, so they are shuffled at any size; neither is ever broadcast.
    found = found.join(counts.select("pair", "docs", "best").hint("merge"), "pair")
    found = found.drop("pair").withColumnRenamed("chunk", "at")
    docs = table.where("pair IS NULL").drop("pair", "plane", "dense", "bits")
    fields = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return docs.groupBy("chunk").cogroup(found.groupBy("at")).applyInArrow(_returned, fields)


def align(
    docs: DataFrame, bytes_path: str | None = None, pieces_path: str | None = None, id_col: str = "doc_id",
    text_col: str = "text", digest: bool = False,
) -> DataFrame:
    """``scores`` of all of ``docs`` under two vocabulary files."""
    bytes_path = bytes_path or vocabulary("byte_bpe_50k.json")
    pieces_path = pieces_path or vocabulary("piece_bpe_32k.model")
    table = postings(docs, bytes_path, pieces_path, id_col, text_col, digest)
    return scores(table, pair_counts(table, len(Pieces(pieces_path).size)))
