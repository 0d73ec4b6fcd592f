"""Spark results against plain loops on seeded random tables."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from randomdata import random_rows
from trajflow.operators import algebra, corpus, evaluate, features, flow, ordered, pairs, sequences, users


def _steps(rows, key):
    last = {}
    for row in rows:
        user, trajectory = row["user_id"], row["trajectory_id"]
        if user is None:
            continue
        before = last.get(user)
        last[user] = row
        if before and trajectory is not None and before["trajectory_id"] == trajectory:
            yield before[key], row[key]


@pytest.mark.parametrize("seed, hot_rows", [(1, None), (2, 20), (3, 5)])
@pytest.mark.parametrize("key", ["POI_id", "POI_category"])
def test_flow_map(checkins, rows_of, seed, hot_rows, key):
    rows = random_rows(seed)
    df = checkins(rows)
    expected = Counter(_steps(rows, key))
    edges = flow.flow_edges(df, key, hot_rows=hot_rows)
    assert {(r["src"], r["dst"]): r["weight"] for r in edges.collect()} == dict(expected)
    nodes = flow.flow_nodes(df, key)
    counted = Counter(r[key] for r in rows if r["user_id"] is not None)
    assert dict(rows_of(nodes)) == dict(counted)
    without = flow.flow_edges(df, key, exclude_user="1", hot_rows=hot_rows)
    left = Counter(_steps([r for r in rows if r["user_id"] != "1"], key))
    assert {(r["src"], r["dst"]): r["weight"] for r in without.collect()} == dict(left)


def _shared(groups):
    found = Counter()
    for members in groups.values():
        found.update(combinations(sorted(members), 2))
    return {(u, v, n) for (u, v), n in found.items()}


@pytest.mark.parametrize("light, blocks, slices", [(64, 1, 1), (0, 1, 1), (0, 4, 3), (4, 3, 2)])
def test_shared_groups(checkins, rows_of, light, blocks, slices):
    rows = random_rows(5, n=600, users=25, pois=9)
    groups = defaultdict(set)
    for r in rows:
        if r["user_id"] is not None:
            groups[r["POI_id"]].add(r["user_id"])
    found = pairs.count_pairs(users.visits(checkins(rows)), "POI_id", "user_id", (), blocks, slices, light)
    assert {tuple(r) for r in found.select("u", "v", "freq").collect()} == _shared(groups)


def _oriented(rows):
    """Counts per orientation with the first group of each."""
    groups = defaultdict(list)
    for r in rows:
        if r["user_id"] is None:
            continue
        for phase, key in enumerate((r["POI_catname"], r["POI_category"])):
            members = groups[(phase, r["local_time"][:13], key)]
            if r["user_id"] not in members:
                members.append(r["user_id"])
    counts, first = Counter(), {}
    for group in sorted(groups):
        for pair in combinations(groups[group], 2):
            counts[pair] += 1
            first.setdefault(pair, group)
    return counts, first


@pytest.mark.parametrize("light, blocks, slices", [(64, 1, 1), (0, 3, 2), (3, 2, 2)])
def test_cooccurrence(checkins, monkeypatch, light, blocks, slices):
    monkeypatch.setattr(pairs, "LIGHT", light)
    rows = random_rows(7, n=700, users=12)
    counts, first = _oriented(rows)
    expected = {}
    for a, b in counts:
        u, v = min(a, b), max(a, b)
        sides = [s for s in ((u, v), (v, u)) if s in counts]
        expected[(u, v)] = counts[max(sides, key=lambda s: first[s])]
    members = users.hourly_members(checkins(rows))
    split = pairs.count_pairs(members, "group", "user_id", ["row_pos"], blocks, slices, light)
    for r in split.collect():
        assert r["forward"] == counts.get((r["u"], r["v"]), 0)
        assert r["backward"] == counts.get((r["v"], r["u"]), 0)
    out = users.cooccurrence_pairs(checkins(rows), blocks=blocks, slices=slices)
    assert {(r["u"], r["v"]): r["freq"] for r in out.collect()} == expected
    plain = users.cooccurrence_pairs(checkins(rows), "unordered", blocks=blocks, slices=slices)
    unordered = Counter()
    for (a, b), n in counts.items():
        unordered[(min(a, b), max(a, b))] += n
    assert {(r["u"], r["v"]): r["freq"] for r in plain.collect()} == dict(unordered)


def test_batches_of_matches_cover_everything(monkeypatch):
    import numpy as np

    monkeypatch.setattr(pairs, "PAIRS_AT_ONCE", 7)
    rng = np.random.default_rng(3)
    left, right = np.sort(rng.integers(0, 9, 40)), np.sort(rng.integers(0, 9, 30))
    found = [p for i, j in pairs._matches(left, right) for p in zip(i.tolist(), j.tolist())]
    assert found == [(i, j) for i in range(40) for j in range(30) if left[i] == right[j]]


def _above_the_counting(df, node):
    """The physical plan's lines above ``node``."""
    return df._jdf.queryExecution().executedPlan().toString().split(node)[0]


@pytest.mark.parametrize("blocks", [1, 3])
def test_pairs_of_large_groups_are_final_where_they_are_counted(checkins, monkeypatch, blocks):
    """Tiles of 5 members; pairs meet no exchange, nor a table of activities."""
    monkeypatch.setattr(pairs, "LIGHT", 2)
    monkeypatch.setattr(pairs, "TILE", 5)
    monkeypatch.setattr(pairs, "OUTER", 6)
    df = checkins(random_rows(21, n=900, users=23, pois=9))
    similar, activity = users.similar_pairs(df), dict(map(tuple, users.user_activity(df).collect()))
    counts, first = _oriented(random_rows(21, n=900, users=23, pois=9))
    expected = {}
    for a, b in counts:
        u, v = min(a, b), max(a, b)
        sides = [s for s in ((u, v), (v, u)) if s in counts]
        freq = counts[max(sides, key=lambda s: first[s])]
        expected[(u, v)] = (freq, freq / (activity[u] + activity[v] - freq))
    assert {(r["u"], r["v"]): (r["freq"], r["similarity"]) for r in similar.collect()} == expected
    plain = users.user_edges(df, blocks=blocks)
    for found in (similar, plain, users.cooccurrence_pairs(df, blocks=blocks)):
        assert "Exchange" not in _above_the_counting(found, "FlatMapGroupsInArrow")
    ranked = users.similar_users(users.user_similarity(similar.select("u", "v", "freq"), users.user_activity(df)), 3)
    nearest = users.nearest_users(df, 3, blocks=blocks)
    columns = ["user_id", "neighbor", "similarity", "rk"]
    assert sorted(nearest.select(columns).collect()) == sorted(ranked.select(columns).collect())


def test_small_groups_are_counted_where_lists_meet(spark, rows_of):
    """Groups of up to 9 members: partners move as lists by the smaller member, and once."""
    rng = random.Random(6)
    rows = {(g, f"m{rng.randrange(40)}") for g in range(60) for _ in range(9)}
    found = pairs.count_pairs(spark.createDataFrame(sorted(rows), "g int, m string"), "g", "m")
    groups = defaultdict(set)
    for g, m in rows:
        groups[g].add(m)
    assert set(rows_of(found, "u", "v", "freq")) == _shared(groups)
    plan = _above_the_counting(found, "Generate")
    assert "Exchange" not in plan and "HashAggregate" in plan


def test_large_and_small_groups_meet(spark, rows_of):
    """A group of 30 among 400 pairs' worth of small ones, with and without order."""
    rng = random.Random(9)
    rows = {(0, m) for m in range(30)} | {(g, rng.randrange(60)) for g in range(1, 120) for _ in range(5)}
    df = spark.createDataFrame([(g, m, rng.random()) for g, m in sorted(rows)], "g int, m int, at double")
    groups = defaultdict(list)
    for g, m, at in sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[2])):
        groups[g].append(m)
    found = pairs.count_pairs(df, "g", "m", light=20)
    assert set(rows_of(found, "u", "v", "freq")) == _shared(groups)
    forward, backward, first = Counter(), Counter(), {}
    for g, members in groups.items():
        for a, b in combinations(members, 2):
            pair = (min(a, b), max(a, b))
            (forward if a < b else backward)[pair] += 1
            first.setdefault(pair, a < b)
    got = pairs.count_pairs(df, "g", "m", ["at"], light=20)
    assert set(rows_of(got, "u", "v", "forward", "backward", "ahead")) == {
        (*p, forward[p], backward[p], ahead) for p, ahead in first.items()
    }


def _sequences(rows, vocab, thres, users_seen=None, align=True):
    """Input and label pairs per trajectory from lists, the way files are read."""
    out = {}
    by_trajectory = defaultdict(list)
    for r in rows:
        if r["trajectory_id"] is not None:
            by_trajectory[r["trajectory_id"]].append(r)
    for trajectory, visits in by_trajectory.items():
        if users_seen is not None and trajectory.split("_")[0] not in users_seen:
            continue
        known = [v for v in visits if v["POI_id"] in vocab]
        features_from = known if align else visits
        steps = len(known) - 1
        if steps < thres:
            continue
        for i in range(steps):
            here, there = features_from[i], features_from[i + 1]
            out[(trajectory, i)] = (
                vocab[known[i]["POI_id"]],
                here["norm_in_day_time"],
                here["latitude"],
                vocab[known[i + 1]["POI_id"]],
                there["norm_in_day_time"],
                there["longitude"],
                here["day_of_week"],
            )
    return out


CHOSEN = ["in_poi", "in_time", "in_lat", "label_poi", "label_time", "label_lon", "label_week"]


def _as_map(steps):
    return {(r["trajectory_id"], r["step"]): tuple(r[c] for c in CHOSEN) for r in steps.collect()}


@pytest.mark.parametrize("hot_rows", [None, 6])
def test_sequences(checkins, spark, hot_rows):
    rows, later = random_rows(11), random_rows(12, pois=10)
    df = checkins(rows)
    vocab_table = features.build_vocab(df, "POI_id")
    vocab = {r["value"]: r["idx"] for r in vocab_table.collect()}
    assert vocab == {v: i for i, v in enumerate(sorted(vocab))}
    steps = sequences.train_sequences(df, vocab_table, hot_rows=hot_rows)
    assert _as_map(steps) == _sequences(rows, vocab, 4)
    seen = spark.createDataFrame([("1",), ("2",), ("4",)], "user_id string")
    for align in (False, True):
        val = sequences.val_sequences(checkins(later), vocab_table, seen, align=align, hot_rows=hot_rows)
        assert _as_map(val) == _sequences(later, vocab, 4, {"1", "2", "4"}, align)


def test_padding_and_packing(checkins):
    df = checkins(random_rows(13, nulls=False))
    steps = sequences.train_sequences(df, features.build_vocab(df, "POI_id"))
    lengths = {r["trajectory_id"]: r["length"] for r in steps.select("trajectory_id", "length").collect()}
    for seed in (None, 3):
        rows = sequences.padded_batches(steps, batch=4, seed=seed).collect()
        batches = defaultdict(set)
        for r in rows:
            batches[r["batch"]].add(r["trajectory_id"])
            assert (r["pos"] >= lengths[r["trajectory_id"]]) == (r["in_poi"] == -1)
        assert sorted(t for b in batches.values() for t in b) == sorted(lengths)
        assert all(len(b) == 4 for n, b in batches.items() if n < len(batches) - 1)
        assert len(rows) == sum(len(b) * max(lengths[t] for t in b) for b in batches.values())
        if seed is None:
            assert [t for n in sorted(batches) for t in sorted(batches[n])] == sorted(lengths)
    for r in sequences.pack(steps).collect():
        assert len(r["input_seq"]) == len(r["label_seq"]) == lengths[r["trajectory_id"]]
        assert [p["poi_idx"] for p in r["input_seq"][1:]] == [p["poi_idx"] for p in r["label_seq"][:-1]]


def _random_ranking(seed):
    rng = random.Random(seed)
    scores, labels = {}, {}
    for t in range(12):
        for s in range(rng.randrange(1, 4)):
            items = rng.sample(range(40), rng.randrange(1, 30))
            scores[(f"t{t}", s)] = {i: float(rng.randrange(6)) for i in items}
            labels[(f"t{t}", s)] = rng.randrange(40)
    return scores, labels


@pytest.mark.parametrize("seed, salts", [(21, None), (22, 4)])
def test_ranking_metrics(spark, seed, salts):
    scores, labels = _random_ranking(seed)
    score_table = spark.createDataFrame(
        [(t, s, i, x) for (t, s), items in scores.items() for i, x in items.items()],
        "traj_id string, step int, item int, score double",
    )
    label_table = spark.createDataFrame(
        [(t, s, i) for (t, s), i in labels.items()], "traj_id string, step int, item int"
    )
    ranked = {key: sorted(items, key=lambda i: (-items[i], i)) for key, items in scores.items()}
    ranks = {k: ranked[k].index(i) + 1 if i in ranked[k] else None for k, i in labels.items()}
    stats = evaluate.label_stats(score_table, label_table, salts=salts).collect()
    assert {(r["traj_id"], r["step"]): r["rank"] for r in stats} == ranks

    [row] = evaluate.metrics_all_steps(score_table, label_table).collect()
    n = len(ranks)
    for k in (1, 5, 10, 20):
        assert row[f"top{k}"] == pytest.approx(sum(r is not None and r <= k for r in ranks.values()) / n)
    assert row["mrr"] == pytest.approx(sum(1 / r for r in ranks.values() if r) / n)
    assert row["map20"] == pytest.approx(sum(1 / r for r in ranks.values() if r and r <= 20) / n)
    assert row["missing"] == sum(r is None for r in ranks.values())
    assert row["top1"] <= row["top5"] <= row["top10"] <= row["top20"] and row["map20"] <= row["mrr"]

    got = {r["traj_id"]: r for r in evaluate.metrics_last_step(score_table, label_table).collect()}
    for t in {t for t, _ in labels}:
        last = max(s for u, s in labels if u == t)
        relevant = {i for (u, _), i in labels.items() if u == t}
        top = ranked[(t, last)][:20]
        dcg = sum(1 / math.log2(p + 2) for p, i in enumerate(top) if i in relevant)
        idcg = sum(1 / math.log2(p + 2) for p in range(min(20, len(relevant))))
        rank = ranks[(t, last)]
        assert got[t]["ndcg20"] == pytest.approx(dcg / idcg)
        assert got[t]["recall20"] == pytest.approx(len(relevant & set(top)) / len(relevant))
        assert got[t]["mrr"] == pytest.approx(1 / rank if rank else 0)
        assert got[t]["top5"] == float(bool(rank and rank <= 5))


@pytest.mark.parametrize("hot_rows", [None, 7])
def test_corpus_samples(checkins, spark, hot_rows):
    rows = random_rows(31)
    names, types = {"n1", "n2", "n4", "n5", "n7"}, {"t1", "t2"}
    allow = spark.createDataFrame(
        [("place_name", n) for n in names] + [("place_type", t) for t in types], "kind string, value string"
    )
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        if r["user_id"] is not None and r["trajectory_id"] is not None:
            groups[(r["user_id"], r["trajectory_id"])].append((r["UTC_time"], i, r))
    expected = {}
    for key, visits in groups.items():
        visits.sort(key=lambda v: v[:2])
        kept = [v[2] for v in visits if v[2]["POI_catname"] in names and v[2]["POI_category"] in types]
        if len(kept) >= 2:
            raw, last = visits[-1][2], kept[-1]
            expected[key] = (
                [v["UTC_time"] for v in kept[:-1]],
                raw["day_of_week"],
                raw["norm_in_day_time"],
                last["UTC_time"].split("T")[0],
                last["POI_catname"],
            )
    points = corpus.corpus_points(checkins(rows), allow, hot_rows=hot_rows)
    got = {}
    for r in corpus.corpus_samples(points).collect():
        source, context = r["input"], r["input"]["context"]
        got[(source["user_id"], source["trajectory_id"])] = (
            [v["timestamp"] for v in source["history"]],
            context["day_of_week"],
            context["time_of_day"],
            context["date"],
            r["output"]["next_location"]["place_name"],
        )
    assert got == expected
    assert corpus.sample_count(checkins(rows), allow).first()[0] == len(expected)


@pytest.mark.parametrize("hot_rows", [1, 9, 40])
def test_ordered_parts_equal_the_plain_window(spark, hot_rows):
    rng = random.Random(hot_rows)
    # One key holds most rows; many rows tie in the first order column.
    rows = [
        ("hot" if rng.random() < 0.7 else rng.choice("abc"), rng.choice([None, *range(12)]), i, rng.random())
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "k string, a int, b int, x double")
    wanted = dict(
        previous={"px": "x", "pa": "a"},
        following={"nx": "x"},
        position="at",
        size="n",
        totals={"top": F.max("x"), "firstx": F.min_by("x", F.struct("a", "b"))},
        running={"sum_b": "b"},
    )
    hot = ordered.hot_keys(df, ["k"], hot_rows)
    assert hot is not None
    plain = ordered.ordered(df, ["k"], ["a", "b"], **wanted)
    parts = ordered.ordered(df, ["k"], ["a", "b"], hot=hot, **wanted)
    assert plain.columns == parts.columns
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, parts.collect()), key=repr)


@pytest.mark.parametrize("first", [None, 7])
def test_hot_rows_that_tie_in_the_first_order_column(spark, first):
    """A constant first column, null keys and far more ranges than 63."""
    df = spark.createDataFrame([(None if i % 2 else "k", first, i) for i in range(400)], "k string, a int, b int")
    wanted = dict(previous={"before": "b"}, following={"after": "b"}, position="at", totals={"n": F.count("*")})
    hot = ordered.hot_keys(df, ["k"], 3)
    assert hot.agg(F.sum("_parts")).first()[0] == 134
    parts = ordered.ordered(df, ["k"], ["a", "b"], hot=hot, **wanted)
    plain = ordered.ordered(df, ["k"], ["a", "b"], **wanted)
    assert sorted(map(tuple, parts.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    sizes = [r[0] for r in ordered.range_parts(df, ["k", "a", "b"], 134).groupBy("_part").count().select("count").collect()]
    assert len(sizes) > 63 and max(sizes) < 40


def test_hot_keys_leave_small_keys_alone(spark):
    df = spark.range(100).select(F.lit("a").alias("k"), F.col("id"))
    assert ordered.hot_keys(df, ["k"]) is None
    assert ordered.hot_keys(df, ["k"], 100) is None
    assert ordered.hot_keys(df, ["k"], small_bytes=0) is None
    [row] = ordered.hot_keys(df, ["k"], 30).collect()
    assert (row["k"], row["_parts"]) == ("a", 4)


def test_many_keys_a_little_hot_share_ranges(spark, monkeypatch):
    """300 keys of 20 rows, hot from 5 on: not 1,200 ranges."""
    df = spark.range(6000).select((F.col("id") % 300).alias("k"), F.xxhash64("id").alias("b"))
    hot, asked, cut = ordered.hot_keys(df, ["k"], 5), [], ordered.range_parts
    monkeypatch.setattr(ordered, "range_parts", lambda d, o, parts: asked.append(parts) or cut(d, o, parts))
    wanted = dict(previous={"before": "b"}, position="at", totals={"n": F.count("*")})
    found = ordered.ordered(df, ["k"], ["b"], hot=hot, **wanted)
    assert asked == [4]
    assert sorted(found.collect(), key=repr) == sorted(ordered.ordered(df, ["k"], ["b"], **wanted).collect(), key=repr)
    # No range is to have more than HOT_ROWS rows.
    monkeypatch.setattr(ordered, "HOT_ROWS", 1000)
    ordered.ordered(df, ["k"], ["b"], hot=hot, **wanted)
    assert asked == [4, 6]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_quantiles_equal_a_sorted_list(spark, parts):
    rng = random.Random(parts)
    rows = [(key, rng.choice([None, *range(9)]), rng.randrange(1, 6)) for key in "ab" for _ in range(40)]
    rows += [("one", 4.5, 1), ("none", None, 3)]
    rows = [(k, None if v is None else float(v), n) for k, v, n in rows]
    shares = [0.0, 0.2, 0.5, 0.77, 1.0]
    counted = spark.createDataFrame(rows, "k string, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
    got = {(r["k"], r["share"]): r["value"] for r in ordered.quantiles(counted, ["k"], shares, parts).collect()}
    want = {}
    for key in ("a", "b", "one"):
        values = sorted(v for k, v, n in rows if k == key and v is not None for _ in range(n))
        want |= {(key, s): float(np.quantile(values, s)) for s in shares}
    assert got == pytest.approx(want)
    assert ordered.quantiles(counted.limit(0), ["k"], shares, parts).count() == 0


def test_dense_index_in_buckets(spark):
    values = random.Random(4).sample(range(10_000), 500)
    df = spark.createDataFrame([(f"v{v:05d}", v % 7) for v in values], "value string, tag int")
    for buckets in (1, 5, 40):
        out = ordered.dense_index(df, ["value"], buckets=buckets).collect()
        assert [r["value"] for r in sorted(out, key=lambda r: r["idx"])] == sorted(f"v{v:05d}" for v in values)
        assert sorted(r["idx"] for r in out) == list(range(500))
    assert ordered.dense_index(df.limit(0), ["value"], buckets=5).count() == 0
    two = ordered.dense_index(df, ["tag", "value"], buckets=6).collect()
    assert [r["tag"] for r in sorted(two, key=lambda r: r["idx"])] == sorted(v % 7 for v in values)


@pytest.mark.parametrize("mode, skip, blocks", [("reference", True, 1), ("reference", False, 4), ("unordered", True, 3)])
def test_nearest_users_equal_the_ranked_pair_table(checkins, rows_of, mode, skip, blocks):
    df = checkins(random_rows(8, n=900, users=17))
    table = users.user_similarity(users.cooccurrence_pairs(df, mode), users.user_activity(df))
    columns = ["user_id", "neighbor", "similarity", "rk"]
    found = users.nearest_users(df, 3, skip, mode, blocks=blocks)
    assert rows_of(found, *columns) == rows_of(users.similar_users(table, 3, skip), *columns)
    assert rows_of(users.nearest_users(df.limit(0), 3, skip, mode)) == []
    # The window after the block tasks sees k rows a user and pair of blocks.
    pairs_seen = users.cooccurrence_pairs(df, mode).count()
    assert found.count() < 2 * pairs_seen


@pytest.mark.parametrize("block", [1, 3, 32])
def test_propagation_in_blocks(spark, block):
    rng = random.Random(block)
    cells = [(a, b, rng.uniform(-1, 1)) for a in range(6) for b in range(6) if rng.random() < 0.6]
    vectors = [(n, [rng.uniform(-1, 1) for _ in range(7)]) for n in range(6)]
    matrix = spark.createDataFrame(cells, "src int, dst int, value double")
    features_ = spark.createDataFrame(vectors, "node int, vector array<double>")
    got = {r["node"]: r["vector"] for r in algebra.propagate(matrix, features_, 7, block).collect()}
    dense = np.zeros((6, 6))
    for a, b, v in cells:
        dense[a, b] = v
    want = dense @ np.array([v for _, v in vectors])
    assert got.keys() == {a for a, _, _ in cells}
    for node, vector in got.items():
        assert vector == pytest.approx(want[node].tolist())


def test_propagation_of_repeated_vectors(spark, monkeypatch):
    """90 nodes share 4 vectors: wide rows meet no exchange, and the sums are those of single nodes."""
    rng = random.Random(2)
    kinds = [[rng.uniform(-1, 1) for _ in range(7)] for _ in range(4)]
    cells = [(a, rng.randrange(90), rng.uniform(-1, 1)) for a in range(90) for _ in range(8)]
    matrix = spark.createDataFrame(cells, "src int, dst int, value double")
    features_ = spark.createDataFrame([(n, kinds[n % 4]) for n in range(90)], "node int, vector array<double>")
    layers = [([[rng.uniform(-1, 1) for _ in range(3)] for _ in range(7)], [0.1, 0, -0.1]), ([[1.0], [2.0], [3.0]], [0.5])]
    assert algebra.repeated_vectors(matrix, features_)[1].count() == 4
    for found in (
        lambda r: algebra.propagate(matrix, features_, 7, 3, repeated=r),
        lambda r: algebra.gcn_forward(matrix, features_, layers, repeated=r),
    ):
        got, want = ({r["node"]: r["vector"] for r in found(flag).collect()} for flag in (True, False))
        assert got.keys() == want.keys()
        assert all(got[n] == pytest.approx(want[n]) for n in want)
    wide = _above_the_counting(algebra.propagate(matrix, features_, 7, 3, repeated=True), "BroadcastHashJoin")
    assert "Exchange" not in wide


def test_iteration_and_eigenvalue_of_a_signed_graph(spark):
    dense = np.array([[3.0, -1, 1], [-1, 3, 1], [2, 1, -1]])
    edges = spark.createDataFrame(
        [(i, j, float(dense[i, j])) for i in range(3) for j in range(3)], "src int, dst int, weight double"
    )
    nodes = spark.createDataFrame([(i,) for i in range(3)], "node int")
    walk = dense / dense.sum(axis=1)[:, None]
    start = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "node int, x double")
    cells = algebra.hashed_cells(algebra.walk_matrix(edges, nodes, shift=1.0), nodes)
    shifted = (walk + np.eye(3)) / 2
    for steps in (1, 4, 7):
        want = np.linalg.matrix_power(shifted, steps) @ [1, 2, 4]
        got = {r["node"]: (r["x"], r["y"]) for r in algebra.iterate(cells, start, steps, 3).collect()}
        unit = want / np.linalg.norm(want)
        assert [got[i][0] for i in range(3)] == pytest.approx(unit.tolist())
        assert [got[i][1] for i in range(3)] == pytest.approx((shifted @ unit).tolist())
    top = max(np.linalg.eigvals(walk).real)
    assert algebra.dominant_eigenvalue(edges, nodes) == pytest.approx(top, abs=1e-5)
    scaled = algebra.laplacian(edges, nodes, "wid_rw_normd_lap_mat", lambda_max=top).collect()
    want = 2 * (np.eye(3) - walk) / top - np.eye(3)
    assert {(r["src"], r["dst"]): r["value"] for r in scaled} == pytest.approx(
        {(i, j): want[i, j] for i in range(3) for j in range(3)}
    )
