"""Language-model scores by logistic context mixing over the text's words.

A token is a word (bytes, then a terminator) or the end of the text. A byte is spelt in
the bits of a Huffman code of the training bytes that follow the two before it (letters
count by themselves, other bytes by groups), so that likely bytes take few decisions.
The bits are predicted by several hashed contexts: the last 2, 3 and 4 bytes and the
last 6 with the place in the word, the first of them with what the word before was like;
and the whole word before with all bytes so far. Each context's counts of 0 and 1 over
all training occurrences give a log-odds. Gated weights (by place in the word, depth in
the code, and how sure the longest context is) combine those within the word, a second
layer (by how sure the word before is, too) that sum and the word before, and an adaptive
table refines the mixture. Weights and table are learned in small steps over all training
occurrences, with each occurrence's own share taken out of the statistics (what it would
meet if it were new):

    P(text) = P_end * product of (1 - P_end) * P_bits(word | word before)

Occurrences are added up per pair of words, chunk by chunk, before their bits are looked
at, and contexts within a word and their layer once for all words before it. The counts
are tables of fixed size (``SLOTS`` slots) for any corpus, so contexts may share a slot;
they and the weights are all that reaches the driver. How often each distinct word occurs,
for the base score, stays distributed and goes back to the chunks that have the word.

Null counts as the empty text, which is one end token. Rows with a null or repeated id
get a row each; other columns are ignored. With nothing to learn from, each bit is 1/2.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajflow.llm import words as W
from trajflow.llm import wordtable
from trajflow.llm.components import dropped, written

#: What the word before was like: none or a sentence's end, short, other.
KINDS = 3
#: Contexts within a word, and all.
WITHIN = 4
PREDICTORS = 5
#: Slots by predictor; there are many more pairs of words than beginnings of words. A code's nodes may lie behind the last.
BITS = [20] * WITHIN + [22]
_FIRST = np.cumsum([0] + [(1 << b) + 256 for b in BITS])
SLOTS = int(_FIRST[-1])
FAN_IN = 32
#: Text bytes in a chunk, smaller than elsewhere as its words are scored beside the tables.
_CHUNK = 14 << 20
#: Text bytes whose pairs of words are added up at a time, if they come as text, and bytes of pairs looked at at a time.
_TEXT = 6 << 20
_SYMBOLS = 1 << 16
#: Words of texts whose pairs are added up at a time: those of a whole chunk, but for odd ones.
_WORDS = 1 << 22
#: Decisions between updates of the weights.
_STRIDE = 1 << 17
#: Places and depths, by how sure the longest context within the word is (three levels); the same by how sure the word before is.
_INNER = 4 * 8 * 3
_GATES = _INNER * 3
_STEPS = 33
_BLOCK = 1 << 17
_DELTA = 0.4
#: Log-odds are held as whole numbers of this.
_UNIT = np.float32(1 / 1024)
_SALTS = W.mix(np.arange(1, PREDICTORS + 1, dtype=np.uint64))
_SHIFTS = [np.uint64(64 - b) for b in BITS]
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: The first bytes of a number of eight, the last byte first.
_LAST = np.array([(1 << 64) - (1 << 64 - 8 * k) for k in range(9)], np.uint64)


def _groups() -> np.ndarray:
    """The group of a byte in a code's context: none before it, each letter, digits, other ASCII, UTF-8's bytes by range."""
    group = np.full(256, 28)
    group[[0, *W.SPACES]] = 0
    group[97:123] = np.arange(1, 27)
    group[48:58] = 27
    group[128:160], group[160:192], group[192:] = 29, 30, 31
    return group


_GROUP = _groups()
#: The context of a code by the two bytes before, the last one times 256.
_CONTEXT = (_GROUP[:, None] * 32 + _GROUP[None, :]).ravel()


class Code:
    """Huffman codes of bytes: each byte's decisions from the root, fewer for frequent bytes.

    ``hits`` are of one code, or by row of several; ``row`` has the code by the two bytes
    before. ``step`` (twice the node, 0 for the root, small for frequent ones, plus the
    bit) and ``depth`` (7 at most) lie byte after byte and code after code; a byte's begin
    at ``first``.
    """

    def __init__(self, hits: np.ndarray, row: np.ndarray | None = None):
        made = [self._made(own) for own in np.atleast_2d(hits)]
        self.row = np.zeros(1 << 16, np.int64) if row is None else row
        self.length = np.concatenate([length for length, _ in made])
        self.first = np.cumsum(self.length) - self.length
        self.step = np.concatenate([step for _, step in made]).astype(np.int16)
        place = np.arange(len(self.step)) - np.repeat(self.first, self.length)
        self.depth = np.minimum(place, 7).astype(np.int8)

    @property
    def node(self) -> np.ndarray:
        return self.step >> 1

    @property
    def bit(self) -> np.ndarray:
        return self.step & 1

    @staticmethod
    def _made(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of decisions by byte, and their steps one behind the other."""
        n = len(hits)
        heap = [(float(h) + 1e-3, i) for i, h in enumerate(hits)]  # every byte has a code
        heapq.heapify(heap)
        above = np.zeros(2 * n - 1, np.int64)
        for made in range(n, 2 * n - 1):
            low, high = heapq.heappop(heap), heapq.heappop(heap)
            above[low[1]], above[high[1]] = 2 * made, 2 * made + 1
            heapq.heappush(heap, (low[0] + high[0], made))
        root, at, found = 2 * n - 2, np.arange(n), []
        length = np.zeros(n, np.int64)
        while (more := at != root).any():
            length += more
            found.append(above[at])
            at = np.where(more, above[at] >> 1, root)
        steps = np.array(found)[::-1]  # from the root, behind what shorter codes don't have
        taken = np.arange(len(found))[::-1][:, None] < length
        edges = steps.T[taken.T]
        return length, 2 * (root - (edges >> 1)) + (edges & 1)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of ``count`` numbers from each ``first``, one after the other."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


class Symbols:
    """The decisions on the bytes of words with terminators, and what predictors within a word see before each.

    ``size`` bytes of a word, from ``begin``, have ``decisions`` each and ``prefix`` (all
    bytes before). ``cells`` by predictor, ``step`` and ``gate`` are by decision; a word
    has ``count`` of them, from ``first``.
    """

    def __init__(self, words: pa.Array, kind: np.ndarray, code: Code):
        data, offsets = W.text_arrays(words)
        self.size = size = np.diff(offsets) + 1
        self.begin = begin = np.cumsum(size) - size
        total = int(size.sum())
        place = np.arange(total) - np.repeat(begin, size)
        inside = np.ones(total, bool)
        inside[begin + size - 1] = False
        padded = np.full(total + 8, 32, np.uint8)
        symbol = padded[8:]
        symbol[inside] = data
        # The eight bytes before each, the last one in the highest place, none of another word.
        eight = np.ndarray((total,), "<u8", padded, 0, (1,)) & _LAST[np.minimum(place, 8)]
        near = np.repeat(kind.astype(np.uint64) << np.uint64(48), size)
        start = np.minimum(place, 7).astype(np.uint64) << np.uint64(56)
        two = eight >> np.uint64(48)
        seen = [two | near, eight >> np.uint64(40), eight >> np.uint64(32), eight >> np.uint64(16) | start]
        spelt = code.row[two.view(np.int64)] * 256 + symbol
        self.decisions = code.length[spelt]
        at = _spread(code.first[spelt], self.decisions)
        self.step = code.step[at].astype(np.int64)
        self.cells = [_cells((c + _SALTS[i]) * _MIX, self.decisions, self.step, i) for i, c in enumerate(seen)]
        # All bytes so far: the sum of what each byte at its place is mixed to.
        with np.errstate(over="ignore"):
            share = W.mix(symbol | place.astype(np.uint64) << np.uint64(8))
            before = np.cumsum(share) - share
            self.prefix = before - np.repeat(before[begin], size) if total else before
        self.gate = np.repeat(np.minimum(place, 3) * 8, self.decisions) + code.depth[at]
        self.count = np.add.reduceat(self.decisions, begin) if total else self.decisions
        self.first = np.cumsum(self.count) - self.count

    def odds(self, table: np.ndarray, by_cell: bool) -> tuple[np.ndarray, np.ndarray]:
        """The log-odds of predictors within a word, from a table by cell or by slot, and the number of their weights."""
        x = np.empty((WITHIN, len(self.step)), np.float32)
        for k in range(WITHIN):
            np.multiply(table[self.cells[k] if by_cell else self.cells[k] >> 1], _UNIT, out=x[k])
        return x, self.gate * 3 + _far(x[-1])


class Pairs:
    """Words with the word before, each distinct pair once, ordered by word.

    ``words`` are distinct, ``codes`` the texts' words as numbers into them and ``doc``
    their texts. ``inverse`` has the pair of each place, if ``placed``, ``hits`` its places.
    """

    def __init__(self, words: pa.Array, codes: np.ndarray, doc: np.ndarray, placed: bool = True):
        data, offsets = W.text_arrays(words)
        n, size = len(words), np.diff(offsets)
        hashes = np.append(W.word_keys(data, offsets[:-1], offsets[1:]) if n else np.empty(0, np.uint64), np.uint64(0))
        stop = np.isin(data[offsets[1:] - 1], [33, 46, 63]) if n else np.empty(0, bool)
        kinds = np.append(np.where(stop, 0, np.where(size <= 3, 1, 2)), 0)  # the last: no word before
        before = np.full(len(codes), n, np.int32)
        before[1:] = np.where(doc[1:] == doc[:-1], codes[:-1], n)
        mixed = np.argsort(hashes[:n])  # an order that has nothing to do with frequency
        place = np.empty(n, np.int64)
        place[mixed] = np.arange(n)
        key = place[codes]
        key *= KINDS
        key += kinds[before]
        key *= n + 1
        key += before
        del before
        if placed:
            order = np.argsort(key)
            key = key[order]
        else:
            key.sort()
        new = np.flatnonzero(np.diff(key, prepend=-1))
        unique, self.hits = key[new], np.diff(np.append(new, len(key))).astype(np.int32)
        del key, new
        if placed:
            self.inverse = np.empty(len(order), np.int32)
            self.inverse[order] = np.repeat(np.arange(len(unique), dtype=np.int32), self.hits)
            del order
        self.before = hashes[unique % (n + 1)]
        row = unique // (n + 1)
        self.edges = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
        rows = row[self.edges[:-1]]
        self.word, self.kind, self.words = mixed[rows // KINDS], rows % KINDS, words
        self.sizes = size[self.word] + 1

    def parts(self, code: Code) -> Iterator[tuple[slice, Part]]:
        """Runs of pairs, all of a word and kind together."""
        done = np.concatenate([[0], np.cumsum(np.diff(self.edges) * self.sizes)])
        i = 0
        while i < len(self.word):
            j = max(i + 1, int(np.searchsorted(done, done[i] + _SYMBOLS, "right")) - 1)
            at = slice(int(self.edges[i]), int(self.edges[j]))
            seen = Symbols(self.words.take(pa.array(self.word[i:j])), self.kind[i:j], code)
            yield at, Part(seen, np.repeat(np.arange(j - i), np.diff(self.edges[i : j + 1])), self.before[at], self.hits[at])
            i = j


class Part:
    """The decisions of some pairs (``at``: of their words), with their weights and, of the longest context, cells."""

    def __init__(self, seen: Symbols, row: np.ndarray, before: np.ndarray, hits: np.ndarray):
        self.seen, count, size = seen, seen.count[row], seen.size[row]
        self.first = np.cumsum(count) - count
        self.at = _spread(seen.first[row], count)
        byte = _spread(seen.begin[row], size)
        context = seen.prefix[byte] ^ np.repeat(W.mix(before + _SALTS[WITHIN]), size)
        context *= _MIX
        step = seen.step[self.at]
        self.cell = _cells(context, seen.decisions[byte], step, WITHIN)
        self.bit, self.weight = step & 1, np.repeat(hits.astype(np.uint32), count)
        self.word_weight = np.repeat(np.bincount(row, weights=hits, minlength=len(seen.count)).astype(np.uint32), seen.count)

    def odds(self, table: np.ndarray, by_cell: bool, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest context's log-odds, and the number of the second layer's weights, given the first's."""
        x = table[self.cell if by_cell else self.cell >> 1] * _UNIT
        return x, (gate * 3)[self.at] + _far(x)


def _far(odds: np.ndarray) -> np.ndarray:
    size = np.abs(odds)
    return (size > 0.1).view(np.int8) + (size > 1.6).view(np.int8)


def _cells(context: np.ndarray, decisions: np.ndarray, step: np.ndarray, k: int) -> np.ndarray:
    """Twice the slot plus the bit, by decision: a context's nodes lie behind one another, so that frequent ones are close."""
    slot = (context >> _SHIFTS[k]).view(np.int64)
    slot += _FIRST[k]
    slot *= 2
    cells = np.repeat(slot, decisions)
    cells += step
    return cells


def pairs_of(column: pa.Array) -> Iterator[Pairs]:
    """The pairs of a column of texts, by blocks of them."""
    for _, _, data, offsets in W.blocks(column, _TEXT):
        data = W.LOWER[data]
        starts, ends, doc = W.bounds(data, offsets)
        if len(starts):
            codes, unique = pd.factorize(W.word_keys(data, starts, ends))
            first = np.empty(len(unique), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            yield Pairs(W.slices(data, starts[first], ends[first]), codes, doc)


def runs_of(words: pa.Array, codes: np.ndarray, size: np.ndarray, placed: bool = True) -> Iterator[tuple[slice, Pairs]]:
    """The pairs of texts of ``size`` words, by runs of texts: a run's place among the ``codes`` and its pairs."""
    ends = np.cumsum(size)
    i = 0
    while i < len(size):
        begin = int(ends[i] - size[i])
        j = max(i + 1, int(np.searchsorted(ends, begin + _WORDS, "right")))
        at = slice(begin, int(ends[j - 1]))
        if at.start < at.stop:
            doc = np.repeat(np.arange(j - i, dtype=np.int32), size[i:j])
            if j - i == len(size):
                yield at, Pairs(words, codes, doc, placed)
            else:
                mine, known = pd.factorize(codes[at])
                yield at, Pairs(words.take(pa.array(known)), mine, doc, placed)
        i = j


def trained_on(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """Of chunks' rows (``marks``, ``sizes``, ``codes``, ``words``): the marked texts' codes and sizes, and the words."""
    for batch in batches:
        for marks, sizes, codes, words in zip(*batch.columns):
            marks, size = np.array(marks.as_py(), bool), np.array(sizes.as_py(), np.int64)
            yield wordtable.unpack_codes(codes.as_py())[np.repeat(marks, size)], size[marks], words.as_py()


def trained_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[Pairs]:
    for codes, size, words in trained_on(batches):
        for _, pairs in runs_of(wordtable.unpack_words(words), codes, size, False):
            yield pairs


def _packed(vector: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(vector.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.float64)


def _summed(rows: DataFrame) -> DataFrame:
    """Adds up the written vectors (``block``, ``task``, ``vector`` packed) in rounds, and drops them."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for blob in frame["vector"]:
            total = total + _unpacked(blob)
        return pd.DataFrame(
            {"block": [frame["block"].iat[0]], "task": [frame["task"].iat[0]], "vector": [_packed(total)]}
        )

    tasks = (rows.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        tasks = -(-tasks // FAN_IN)
        grouped = rows.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("block", "task")
        parts, rows = rows, written(grouped.applyInPandas(add, "block int, task long, vector binary"), "sums")
        dropped(parts)
        if tasks == 1:
            return rows


def _vector(rows: DataFrame, size: int, block: int, kind: type) -> np.ndarray:
    out = np.zeros(size, kind)
    for row in rows.collect():  # a table of fixed size
        part = _unpacked(row.vector)
        out[row.block * block : row.block * block + len(part)] = part
    dropped(rows)
    return out


def byte_code(texts: DataFrame) -> Code:
    """The codes of bytes as often as they follow two others in the marked texts of chunks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(1 << 18)
        for codes, _, words in trained_on(batches):
            text = wordtable.unpack_lines(words)
            ends = np.flatnonzero(text == 10)
            often = np.repeat(np.bincount(codes, minlength=len(ends)), np.diff(ends, prepend=-1))
            group = _GROUP[np.concatenate([np.full(2, 10, np.uint8), text])]
            context = np.where(group[1:-1] > 0, group[1:-1] * 32 + group[:-2], 0)
            hits += np.bincount(context * 256 + np.where(text == 10, 32, text), weights=often, minlength=1 << 18)
        some = np.flatnonzero(hits)
        counted = pa.array(hits[some].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), counted], ["cell", "hits"])

    hits = np.zeros(1 << 18)
    rows = texts.mapInArrow(count, "cell int, hits long").groupBy("cell").agg(F.sum("hits").alias("hits"))
    for row in rows.collect():  # 2 ** 18 at most
        hits[row.cell] = row.hits
    hits = hits.reshape(32, 32, 256)
    # What follows the last byte's group counts as four observations, what there is at all as one.
    last, all_of = hits.sum(axis=1), hits.sum(axis=(0, 1))
    codes = [all_of]
    row = np.zeros((32, 32), np.int64)
    for a in np.flatnonzero(last.sum(axis=1)):
        prior = 4 * last[a] / last[a].sum() + all_of / all_of.sum()
        row[a] = len(codes)
        codes.append(last[a])
        for b in np.flatnonzero(hits[a].sum(axis=1)):
            row[a, b] = len(codes)
            codes.append(hits[a, b] + prior)
    return Code(np.array(codes), row.ravel()[_CONTEXT])


def bit_counts(texts: DataFrame, code: Code) -> np.ndarray:
    """Counts of 0 and 1 by slot, over all occurrences of words in the marked texts of chunks."""

    shared = texts.sparkSession.sparkContext.broadcast(code)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(2 * SLOTS, np.uint32)
        for pairs in trained_pairs(batches):
            for _, part in pairs.parts(shared.value):
                for cells in part.seen.cells:
                    np.add.at(flat, cells, part.word_weight)
                np.add.at(flat, part.cell, part.weight)
        task = TaskContext.get().partitionId()
        for block in range(-(-len(flat) // _BLOCK)):
            part = flat[block * _BLOCK : (block + 1) * _BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([task], pa.int64()), pa.array([_packed(part.astype(np.float64))], pa.binary())],
                    ["block", "task", "vector"],
                )

    made = written(texts.mapInArrow(count, "block int, task long, vector binary"), "bitcounts")
    shared.unpersist()
    return _vector(_summed(made), 2 * SLOTS, _BLOCK, np.float32).reshape(SLOTS, 2)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _step(x: np.ndarray) -> np.ndarray:
    """Place of a log-odds in the refining table."""
    return (np.clip(x, -8, 8) * 2 + 16.5).astype(np.int64)


class Mixer:
    """Weights of both layers by gate, and the refining table's log-odds."""

    def __init__(self, inner: np.ndarray, outer: np.ndarray, refine: np.ndarray):
        self.inner, self.outer, self.refine = inner, outer, refine

    @staticmethod
    def fresh() -> Mixer:
        line = np.tile((np.arange(_STEPS) - 16) / 2.0, (_GATES, 1))
        return Mixer(np.full((_INNER, WITHIN), 0.4), np.tile([0.8, 0.4], (_GATES, 1)), line)


class Layer:
    """A layer's weights while they are learned in small steps, and their mean by decisions."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.events, self.mean = weights, np.zeros(len(weights)), np.zeros_like(weights)
        self.hit, self.slope = np.zeros(len(weights)), np.zeros_like(weights)

    def meet(self, gate: np.ndarray, x: list[np.ndarray] | np.ndarray, error: np.ndarray, hits: np.ndarray) -> None:
        """Decisions by gate, with their ``hits`` added up by gate."""
        self.hit += hits
        for k, own in enumerate(x):
            self.slope[:, k] += np.bincount(gate, weights=error * own, minlength=len(self.hit))

    def move(self, rate: float) -> None:
        self.weights = self.weights + rate * self.slope / np.maximum(self.hit, 1)[:, None]
        self.events += self.hit
        self.mean += self.weights * self.hit[:, None]
        self.hit, self.slope = np.zeros_like(self.hit), np.zeros_like(self.slope)


def _mixed(weights: np.ndarray, gate: np.ndarray, x: list[np.ndarray] | np.ndarray) -> np.ndarray:
    weights = np.ascontiguousarray(weights.T, np.float32)
    z = weights[0][gate] * x[0]
    for k in range(1, len(x)):
        z += weights[k][gate] * x[k]
    return z


def _whole(odds: np.ndarray) -> np.ndarray:
    return np.rint(odds / _UNIT).astype(np.int16)


def learn(texts: DataFrame, counts: np.ndarray, code: Code, rate: float = 1.0) -> Mixer:
    """One pass in small steps over all training occurrences; the steps' weights are averaged by their decisions."""
    # Log-odds by slot and bit, without an occurrence of the bit; bits that never occur aren't asked for.
    own = np.empty((SLOTS, 2), np.int16)
    for at in range(0, SLOTS, _BLOCK):
        n = counts[at : at + _BLOCK] + np.float32(_DELTA)
        rest = np.maximum(n - 1, np.float32(_DELTA))
        own[at : at + _BLOCK, 0] = _whole(np.log(n[:, 1] / rest[:, 0]))
        own[at : at + _BLOCK, 1] = _whole(np.log(rest[:, 1] / n[:, 0]))
    shared = texts.sparkSession.sparkContext.broadcast((own.ravel(), code))

    def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, code = shared.value
        fresh = Mixer.fresh()
        inner, outer = Layer(fresh.inner), Layer(fresh.outer)
        table, since = np.zeros(2 * _GATES * _STEPS), 0
        for pairs in trained_pairs(batches):
            for _, part in pairs.parts(code):
                seen = part.seen
                x, g = seen.odds(own, True)
                z = _mixed(inner.weights, g, x)
                h = part.word_weight.astype(np.float32)
                met = np.bincount(g, weights=h, minlength=_INNER)
                inner.meet(g, x, h * ((seen.step & 1).astype(np.float32) - _sigmoid(z)), met)
                last, g = part.odds(own, True, g)
                x = [z[part.at], last]
                z = _mixed(outer.weights, g, x)
                h = part.weight.astype(np.float32)
                met = np.bincount(2 * (g * _STEPS + _step(z)) + part.bit, weights=h, minlength=len(table))
                table += met
                outer.meet(g, x, h * (part.bit.astype(np.float32) - _sigmoid(z)), met.reshape(_GATES, -1).sum(axis=1))
                since += len(g)
                if since >= _STRIDE:
                    inner.move(rate)
                    outer.move(rate)
                    since = 0
        inner.move(rate)
        outer.move(rate)
        vector = np.concatenate([inner.mean.ravel(), inner.events, outer.mean.ravel(), outer.events, table])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()),
                pa.array([_packed(vector)], pa.binary()),
            ],
            ["block", "task", "vector"],
        )

    made = written(texts.mapInArrow(pass_over, "block int, task long, vector binary"), "passes")
    sizes = [_INNER * WITHIN, _INNER, _GATES * 2, _GATES, 2 * _GATES * _STEPS]
    vector = _vector(_summed(made), sum(sizes), sum(sizes), np.float64)
    shared.unpersist()
    fresh = Mixer.fresh()
    inner, inner_events, outer, outer_events, table = np.split(vector, np.cumsum(sizes)[:-1])
    for weights, mean, events in ((fresh.inner, inner, inner_events), (fresh.outer, outer, outer_events)):
        some = events > 0
        weights[some] = mean.reshape(weights.shape)[some] / events[some, None]
    # The table's own line counts as 20 observations of each step.
    table = table.reshape(_GATES, _STEPS, 2)
    prior = 20 * np.stack([_sigmoid(-fresh.refine), _sigmoid(fresh.refine)], axis=2)
    fresh.refine = np.log((table[..., 1] + prior[..., 1]) / (table[..., 0] + prior[..., 0]))
    return fresh


def log_probability(pairs: Pairs, odds: np.ndarray, mixer: Mixer, code: Code) -> np.ndarray:
    """Natural logarithm of each pair's probability by its decisions, given the word before."""
    out = np.zeros(len(pairs.hits))
    refined = np.stack([_sigmoid(-mixer.refine), _sigmoid(mixer.refine)], axis=2).astype(np.float32).ravel()
    for place, part in pairs.parts(code):
        x, gate = part.seen.odds(odds, False)
        z = _mixed(mixer.inner, gate, x)
        last, gate = part.odds(odds, False, gate)
        z = _mixed(mixer.outer, gate, [z[part.at], last])
        p = _sigmoid(z * (2 * part.bit - 1).astype(np.float32))
        p += refined[2 * (gate * _STEPS + _step(z)) + part.bit]
        out[place] = np.add.reduceat(np.log(0.5 * p), part.first, dtype=np.float64)
    return out


def scores(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``trains`` says which rows are learned from. Bytes are those of the words, with a
    terminator for each and one for the end.
    """
    table = wordtable.chunks(docs, id_col, text_col, trains, lower=True, chunk_bytes=_CHUNK)
    counts = written(wordtable.words_of(table).groupBy("key").agg(F.sum("hits").alias("c")), "counts")
    ends = table.where(F.col("code").isNull()).agg(F.sum(F.size(F.filter("marks", lambda m: m)))).first()[0] or 0
    got = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    tokens, types = (got[0] or 0) + ends, got[1] + (ends > 0)
    texts = table.where(F.col("code").isNull())
    training = texts.select("marks", "sizes", "codes", "words")
    code = byte_code(training)
    count = bit_counts(training, code)
    mixer = learn(training, count, code)
    odds = _whole(np.log((count[:, 1] + np.float32(_DELTA)) / (count[:, 0] + np.float32(_DELTA))))
    del count
    floor = math.log10(tokens + 0.5 * (types + 1))
    end = (ends + 0.5) / (tokens + 1)
    more, end_score = math.log10(1 - end), math.log10(end)
    shared = docs.sparkSession.sparkContext.broadcast((odds, mixer, code))
    end_base = math.log10(ends + 0.5) - floor
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
            ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
            ("bits_per_byte", pa.float64()),
        ]
    )

    def place(texts: pa.Table, words: pa.Table) -> pa.Table:
        codes = wordtable.unpack_codes(texts["codes"][0].as_py())
        size = np.array(texts["sizes"][0].as_py(), np.int64)
        n = len(size)
        doc = np.repeat(np.arange(n, dtype=np.int32), size)
        text = wordtable.unpack_words(texts["words"][0].as_py())
        c = np.empty(len(text))
        c[words["code"].to_numpy()] = words["c"].to_numpy()
        base = np.log10(c + 0.5) - floor

        def total(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, weights=x[codes], minlength=n)

        score = np.full(n, end_score)
        for at, pairs in runs_of(text, codes, size):
            by_bits = log_probability(pairs, *shared.value) / math.log(10) + more
            score += np.bincount(doc[at], weights=by_bits[pairs.inverse], minlength=n)
        n_bytes = total(pc.binary_length(text).to_numpy(zero_copy_only=False) + 1.0) + 1
        columns = [
            texts["docs"][0].as_py(), [not m for m in texts["marks"][0].as_py()], size + 1,
            (total((c > 0).astype(float)) + (ends > 0)).astype(np.int64), np.full(n, tokens, np.int64),
            total(base) + end_base, score, -score * math.log2(10) / n_bytes,
        ]
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    fields = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
        "bits_per_byte double"
    )
    words = wordtable.words_of(table).select(F.col("chunk").alias("at"), "code", "key")
    found = words.join(counts, "key").drop("key")
    texts = texts.select("chunk", "docs", "marks", "sizes", "codes", "words")
    return texts.groupBy("chunk").cogroup(found.groupBy("at")).applyInArrow(place, fields)
