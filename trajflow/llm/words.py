"""Words of text batches as numpy arrays.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return. UTF-8 has no such byte inside another character, so
bytes and code points agree. Nothing here builds a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = [9, 10, 11, 12, 13, 32]
#: Bytes hashed at a time; bounds the temporary arrays.
BLOCK = 1 << 21

SOLID = np.ones(256, dtype=bool)
SOLID[SPACES] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PRIMES = (2147483629, 2147483587)
_BASES = (1103515249, 1657324663)
_powers = [np.ones(1, dtype=np.int64), np.ones(1, dtype=np.int64)]
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words hashed at a time, and eights of bytes from which a word counts as long.
_WORDS, _LANES = 1 << 16, 32
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = column.fill_null("").cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first, end, bytes, offsets."""
    data, offsets = text_arrays(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; no word crosses two texts."""
    solid = SOLID[data]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[inner] = solid[inner]
    last = solid
    last[:-1] &= ~solid[1:]
    last[inner - 1] = SOLID[data[inner - 1]]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets[1:], starts, "right")


def _powers_of(which: int, size: int) -> np.ndarray:
    table = _powers[which]
    while len(table) < size:
        step = int(table[-1]) * _BASES[which] % _PRIMES[which]
        table = np.concatenate([table, table * step % _PRIMES[which]])
    _powers[which] = table
    return table


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: two polynomials over primes, mixed."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        lo, hi = starts[i], ends[j - 1]
        part = data[lo:hi]
        value = np.where(SOLID[part], part.astype(np.int64) + 1, 0)
        at = starts[i:j] - lo
        place = np.arange(hi - lo) - np.repeat(at, np.diff(np.append(at, hi - lo)))
        longest = int((ends[i:j] - starts[i:j]).max())
        np.minimum(place, longest, out=place)
        both = [
            np.add.reduceat(value * _powers_of(k, longest + 1)[place], at) % _PRIMES[k] for k in (0, 1)
        ]
        out[i:j] = (both[0].astype(np.uint64) << np.uint64(31)) | both[1].astype(np.uint64)
        i = j
    return mix(out + ODD)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from eight bytes at a time; not that of ``hash_words``."""
    eights = np.zeros(len(data) // 8 + 2, "<u8")
    eights.view(np.uint8)[: len(data)] = data
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), _WORDS):
        at, left = starts[i : i + _WORDS], ends[i : i + _WORDS] - starts[i : i + _WORDS]
        state, live = left.astype(np.uint64), None
        for _ in range(_LANES):
            place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
            lane = eights[place] >> shift
            lane |= eights[place + 1] << np.uint64(1) << (np.uint64(63) - shift)
            lane &= _LOW_BYTES[np.minimum(left, 8)]
            mixed = (lane ^ (state if live is None else state[live])) * _MIX1
            mixed ^= mixed >> np.uint64(32)
            if live is None:
                state, live = mixed, np.arange(len(at))
            else:
                state[live] = mixed
            more = np.flatnonzero(left > 8)
            at, left, live = at[more] + 8, left[more] - 8, live[more]
            if not len(live):
                break
        else:
            for word in live:
                whole = data[starts[i + word] : ends[i + word]]
                state[word] = hash_words(whole, np.zeros(1, np.int64), np.array([len(whole)]))[0]
        out[i : i + _WORDS] = state
    return mix(out + ODD)


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``k`` words within one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total ^= hashes[j : j + n]
            total *= _MIX1
            total ^= total >> np.uint64(32)
    return at, mix(total[at])


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words with one space behind each, and where each begins (and, last, the end)."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1], 32, np.uint8)
    solid = data[SOLID[data]]
    out[np.arange(len(solid)) + np.repeat(np.arange(len(size)), size)] = solid
    return out, at


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given byte ranges as one Arrow string column."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(
        len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[place])
    ).cast(pa.string())
