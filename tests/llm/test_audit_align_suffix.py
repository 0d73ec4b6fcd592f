"""Suffix dedup, filter audit and tokenizer alignment against brute force, over every odd row."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trajflow.llm import alignment, interactions, suffixes

SCHEMA = "doc_id long, text string, source string, part string, anchor string, pair string, chunk string, kept string"
rng = random.Random(5)
WORDS = ["river", "Stone", "über", "the", "of", "中文", "don't", "x1", "…", "naïve", "SHOUT"]


def prose(n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


PASSAGE = prose(40)
ROWS = [
    (1, prose(60) + " " + PASSAGE, "a"), (2, PASSAGE + " tail " + prose(20), "b"), (3, None, None), (4, "", "a"),
    (5, "Heer " * 120, ""), (6, "y" * 30_000 + " end", "b"), (7, " \n\t", "a"), (8, "  two  spaces  and　more \n\n x ", "a"),
    (9, "[$] & 100% sure | #1", "b"), (10, "<|endoftext|> <s> </s> <unk> is text", "a"), (11, "under▁score ﬁ \x00 nul", "c"),
    (13, prose(70), "c"), (13, PASSAGE, "c"), (14, PASSAGE[:99], "c"), (15, "again and again", "c"), (15, "again and again", "c"),
    (None, PASSAGE + " no id", "c"), (None, "again and again", "c"), (21, "again and again", "d"), (22, prose(3000), "a"),
]
ROWS += [(30 + i, prose(30) + " " + PASSAGE[:150] + " " + prose(30), "hot") for i in range(12)]
ROWS += [(60 + i, ROWS[0][1], "hot") for i in range(8)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + ("p", "a", "q", "c", "k") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def suffix_brute(rows, part, length):
    """Spans and kept bytes by (id, text), with a set of all strings seen."""
    out, seen = {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, part[r[1]])):
        body = (t or "").encode()
        gone = bytearray(len(body))
        for s in range(len(body) - length + 1):
            if seen.setdefault(body[s : s + length], (i, t, s)) != (i, t, s):
                gone[s : s + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out[i, t] = (len(body), spans, bytes(b for b, g in zip(body, gone) if not g))
    return out


@pytest.mark.parametrize("length, run_bytes", [(100, 1 << 20), (100, 300), (20, 2_000)])
def test_suffix_dedup_against_a_set_of_all_strings(spark, docs, none, length, run_bytes):
    ids = docs.select("text", F.xxhash64("text").alias("part")).distinct().collect()
    want = suffix_brute([r[:2] for r in ROWS], {r.text: r.part for r in ids}, length)
    out = suffixes.remove_repeats(docs, length, run_bytes=run_bytes)
    got = out.collect()
    assert len(got) == len(ROWS)
    expected = Counter((i, *map(repr, want[i, t])) for i, t, _ in ROWS)
    found = Counter((r.doc_id, repr(r.n_bytes), repr([tuple(s) for s in r.spans]), repr(bytes(r.kept))) for r in got)
    assert found == expected
    if length == 100 and run_bytes > 300:
        assert suffixes.remove_repeats(none).count() == 0


def test_long_texts_are_scanned_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 700)
    rows = [(1, PASSAGE + prose(400) + PASSAGE), (2, prose(10) + PASSAGE + "y" * 900)]
    want = suffix_brute(rows, {t: 0 for _, t in rows}, 100)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == {i: want[i, t][2] for i, t in rows}


def test_sorting_survives_hash_collisions(monkeypatch):
    """With a hash that calls everything equal the bytes decide."""
    texts = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(30)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    place = np.arange(30) * 40
    group = np.repeat([0, 1, 2], 10)
    right = [sorted(range(g * 10, g * 10 + 10), key=lambda s: texts[s][:8]) for g in range(3)]
    for broken in (False, True):
        if broken:
            monkeypatch.setattr(suffixes.Prefixes, "equal", lambda self, a, b, size: np.ones(len(a), bool))
        order, equal = suffixes.sort_suffixes(data, place, group, 8)
        assert [texts[s][:8] for s in order] == [texts[s][:8] for s in itertools.chain(*right)]
        heads = [i % 10 > 0 and texts[order[i]][:8] == texts[order[i - 1]][:8] for i in range(30)]
        assert equal.tolist() == heads


def audit_brute(rows, labels):
    flags = defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        if i is not None:
            flags[i][0] |= quality == 1
            flags[i][1] |= toxic == 1
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, p in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": t in least and i != least[t],
        }
        parts[p or ""].append(({c for c, f in fails.items() if f}, *(flags[i] if i is not None else (False, False))))
    out = {}
    for part, known in parts.items():
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                earlier = set(order[: step - 1])
                gone = [r for r in known if letter in r[0] and not r[0] & earlier]
                out[part, "".join(order), step] = [
                    sum(not r[0] & set(order[:step]) for r in known), len(gone),
                    sum(letter in r[0] and bool(r[0] & earlier) for r in known), sum(r[0] == {letter} for r in known),
                    sum(r[1] for r in gone), sum(r[2] for r in gone),
                ]
    for part in parts:
        for letter in "ABCDE":
            at = [(part, o, o.index(letter) + 1) for o in map("".join, itertools.permutations("ABCDE"))]
            total = sum(out[k][1] for k in at)
            for k in at:
                out[k].append(total)
    return out


def test_filter_audit_against_every_order(spark, docs, none):
    labels = [(1, 1, 0), (1, 0, 1), (2, 0, None), (9, 1, 1), (None, 1, 1), (21, 1, 0), (31, None, 1), (62, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = interactions.audit(docs, table).collect()
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == audit_brute(ROWS, labels)
    assert len(got) == 600 * len({p or "" for _, _, p in ROWS})
    assert interactions.audit(none, table).count() == 0
    assert interactions.audit(docs, table.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def align_brute(rows):
    a_side = Tokenizer.from_file(alignment.vocabulary("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=alignment.vocabulary("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def a_bytes(i):
        return bytes(letters[c] for c in a_side.id_to_token(i))

    def b_bytes(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()

    found = []
    for i, t in rows:
        links, groups, a, b = [], [], [], []
        if t:
            a, b = a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)
            if not (b"".join(map(a_bytes, a)) == b"".join(map(b_bytes, b)) == (" " + t).encode()):
                a, b = [], []
            ends = []
            for ids, size in ((a, a_bytes), (b, b_bytes)):
                ends.append(list(itertools.accumulate(len(size(x)) for x in ids)))
            for x, end in zip(a, ends[0]):
                begin = end - len(a_bytes(x))
                links += [(x, y) for y, e in zip(b, ends[1]) if e - len(b_bytes(y)) < end and begin < e]
            cuts, low = sorted(set(ends[0]) & set(ends[1])), 0
            for cut in cuts:
                groups.append("|".join(
                    ",".join(str(x) for x, e in zip(ids, en) if low < e <= cut) for ids, en in zip((a, b), ends)
                ))
                low = cut
        found.append((i, a, b, groups, links))
    docs_of = Counter(p for f in found for p in set(f[4]))
    times = Counter(p for f in found for p in f[4])
    top = defaultdict(int)
    for (x, _), n in docs_of.items():
        top[x] = max(top[x], n)
    rows = Counter(
        (i, len(a), len(b), len(g), len(ln), sum(docs_of[p] == top[p[0]] for p in ln), sum(docs_of[p] for p in ln), ";".join(g))
        for i, a, b, g, ln in found
    )
    return rows, docs_of, times, top


def test_alignment_against_all_pairs_of_tokens(docs, none):
    small = [r[:2] for r in ROWS if not r[1] or len(r[1]) < 5_000]
    want, docs_of, times, top = align_brute(small)
    source = docs.where("text IS NULL OR length(text) < 5000")
    names = [alignment.vocabulary(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    table = alignment.postings(source, *names, chunk_bytes=3_000)
    counts = alignment.pair_counts(table, 32_000)
    assert {(r.a, r.b): (r.docs, r.links, r.best) for r in counts.collect()} == {
        p: (n, times[p], n == top[p[0]]) for p, n in docs_of.items()
    }
    assert Counter(map(tuple, alignment.scores(table, counts).collect())) == want
    digests = {r.groups for r in alignment.align(source, digest=True).collect()}
    assert digests == {hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for w in want}
    assert alignment.align(none).count() == 0


def test_long_texts_align_like_short_ones(docs):
    long_ = docs.where("length(text) >= 5000")
    rows = alignment.align(long_).collect()
    assert len(rows) == 2 and all(r.n_links == r.n_a + r.n_b - r.n_groups > 0 for r in rows)
    # An id's links are all the best while a pair is in one document only or its count is the highest.
    assert all(0 < r.n_best <= r.n_links <= r.count_sum for r in rows)


def test_bitmaps_hold_documents_and_times():
    pair, local = np.repeat([3, 8], [300, 2]), np.concatenate([np.arange(300), [1, 70]])
    times = np.ones(302, np.int64)
    times[[0, 5, 301]] = [2, 6, 4]
    planes = list(alignment.planes(pair, local, times, 400))
    assert [p["plane"][0] for p in planes] == [0, 1, 2, 3]
    weights = {0: 1, 1: 1, 2: 2, 3: 4}
    total = Counter()
    for p in planes:
        for key, dense, bits in zip(p["pair"], p["dense"], p["bits"]):
            raw = np.frombuffer(bits, np.uint8)
            n = int(np.unpackbits(raw).sum()) if dense else len(bits) // 2
            total[key] += n * weights[p["plane"][0]]
    assert total == {3: times[:300].sum(), 8: times[300:].sum()}
    assert planes[0]["dense"].tolist() == [True, False]
