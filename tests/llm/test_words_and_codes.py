"""Small tests of the hashes and codes of words, and of what operators do with them."""

import numpy as np
import pyarrow as pa
import pytest

from trajflow.llm import mixing, substring, wordtable
from trajflow.llm import words as W


def test_mixing_spells_bytes_in_few_decisions():
    code = mixing.Code(np.bincount(np.frombuffer(b"a plain text of plain words " * 50, np.uint8), minlength=256))
    paths = {tuple(zip(code.node[f : f + n], code.bit[f : f + n])) for f, n in zip(code.first, code.length)}
    assert len(paths) == 256 and sum(0.5 ** int(n) for n in code.length) == 1  # a whole prefix code
    assert code.length[32] <= 3 and code.length[ord("z")] > 8

    # The middle of a learned text takes fewer decisions than 8 for each byte.
    texts = pa.array(["a plain text of plain words " * 50])
    (pairs,) = mixing.pairs_of(texts)
    symbols = sum(len(w) + 1 for w in pairs.words.take(pa.array(np.repeat(pairs.word, np.diff(pairs.edges)))).to_pylist())
    assert sum(len(part.at) for _, part in pairs.parts(code)) < 5 * symbols


def test_word_keys_tell_words_apart_wherever_they_stand():
    texts = ["", "a ab abc\tabcdefgh abcdefghi", "abcdefghi abcdefgh  abc ab a", "x" * 1000 + " y " + "x" * 1000, "x" * 999 + "z q"]
    texts += ["你好", " 你好 " + "ab" * 500, "ab" * 500 + "a"]
    data, offsets = W.text_arrays(pa.array(texts))
    starts, ends, _ = W.bounds(data, offsets)
    spelt = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    keys = W.word_keys(data, starts, ends)
    assert len(set(keys.tolist())) == len(set(spelt)) == len(set(zip(keys.tolist(), spelt)))
    assert W.word_keys(data, starts[:0], ends[:0]).tolist() == []


@pytest.mark.parametrize("span", [1, 2, 3, 9, 13])
def test_least_of_a_span_is_the_first(span):
    values = np.random.default_rng(span).integers(0, 40, 3000).astype(np.uint64)
    found = np.lib.stride_tricks.sliding_window_view(values, span).argmin(axis=1)
    assert substring._least(values, span).tolist() == (found + np.arange(len(found))).tolist()


def test_spaced_words_are_what_splitting_and_joining_gives():
    texts = ["", " a  bc\td\n", "e", "f g ", "  ", "你好  x"]
    data, offsets = W.text_arrays(pa.array(texts))
    starts, ends, _ = W.bounds(data, offsets)
    out, at = W.spaced(data, starts, ends)
    listed = [w.encode() for t in texts for w in t.split()]
    assert out.tobytes() == b"".join(w + b" " for w in listed)
    assert [out[a : b - 1].tobytes() for a, b in zip(at, at[1:])] == listed


def test_settled_stretches_move_as_digests(spark, monkeypatch):
    """The words of stretches stay where the texts are; the result is that of brute force."""
    written, seen = substring.written, {}

    def spy(df, name):
        table = written(df, name)
        if name == "bodies":
            seen[name] = {len(r.body) for r in table.select("body").collect()}
        return table

    monkeypatch.setattr(substring, "written", spy)
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, "x y " + "  ".join(words[5:40]) + " z"), (3, "\t".join(words[10:30]) + " q"), (4, None)]
    out = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].n_removed for i in (1, 2, 3, 4)] == [0, 35, 20, 0]
    assert seen["bodies"] == {32}


def test_texts_are_scored_in_runs(monkeypatch):
    """What is held for a run doesn't grow with the chunk; every word keeps its place and the word before it."""
    monkeypatch.setattr(mixing, "_WORDS", 5)
    words = pa.array(["a", "bb", "ccc", "never"])
    codes, size = np.array([0, 1, 0, 1, 2, 0, 2, 2, 1, 0, 0], np.uint32), np.array([0, 2, 1, 7, 0, 1, 0])
    seen, places = [], []
    for at, pairs in mixing.runs_of(words, codes, size):
        row = np.repeat(np.arange(len(pairs.word)), np.diff(pairs.edges))
        found = pairs.words.take(pa.array(pairs.word[row][pairs.inverse])).to_pylist()
        first = pairs.before[pairs.inverse] == 0  # no word before
        seen += list(zip(found, first.tolist()))
        places.append((at.start, at.stop))
    starts = {0, 2, 3, 10}
    assert seen == [(words[int(c)].as_py(), i in starts) for i, c in enumerate(codes)]
    assert places == [(0, 3), (3, 10), (10, 11)]


def test_mixing_learns_from_packed_chunks_in_narrow_tables():
    """A chunk's row holds its texts whole; log-odds take two bytes a cell where executors hold them."""
    texts = ["The cat, the  dog", "", None, "un deux\ttrois the", "x" * 300 + " a"]
    marks = [True, True, False, False, True]
    rows = list(wordtable._chunk(7, [pa.array(texts, pa.large_string())], [1, 2, 3, 4, 5], marks, True, None))
    listed = [w for t in texts for w in (t or "").lower().split()]
    words = wordtable.unpack_words(rows[0]["words"][0].as_py())
    codes = wordtable.unpack_codes(rows[0]["codes"][0].as_py())
    assert words.take(pa.array(codes)).to_pylist() == listed and rows[0]["sizes"][0].as_py() == [4, 0, 0, 4, 2]
    (row,) = mixing.trained_on([rows[0].select(["marks", "sizes", "codes", "words"])])
    assert words.take(pa.array(row[0])).to_pylist() == listed[:4] + listed[8:] and row[1].tolist() == [4, 0, 2]
    assert rows[1]["hits"].to_pylist() == np.bincount(row[0], minlength=len(words)).tolist()

    odds = np.log(np.array([1e-9, 0.4, 1, 7.3, 2e8], np.float32))
    held = mixing._whole(odds)
    assert held.dtype == np.int16 and np.abs(held * mixing._UNIT - odds).max() <= mixing._UNIT / 2
    assert 2 * mixing.SLOTS * held.itemsize < 40 << 20


def test_mixing_spells_bytes_by_the_two_before():
    hits = np.zeros((2, 256))
    hits[0, [97, 98]], hits[1, 99] = 5, 50
    row = np.zeros(1 << 16, np.int64)
    row[97 << 8 | 98] = 1  # after "ba"
    code = mixing.Code(hits, row)
    assert all(sum(0.5 ** int(n) for n in length) == 1 for length in code.length.reshape(2, 256))
    seen = mixing.Symbols(pa.array(["bac", "ca"]), np.zeros(2, np.int64), code)
    spelt = [98, 97, 256 + 99, 32, 99, 97, 32]
    assert seen.decisions.tolist() == code.length[spelt].tolist() and code.length[256 + 99] == 1 < code.length[99]
    assert seen.step.tolist() == [x for i in spelt for x in code.step[code.first[i] : code.first[i] + code.length[i]]]
