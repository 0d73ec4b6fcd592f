"""Small tables with hand-computed results."""

import math

import pytest
from pyspark.sql import functions as F

from trajflow.functions.text import parse_prediction, two_decimals
from trajflow.operators import algebra, corpus, evaluate, features, flow, sequences, users


def test_interleaved_trajectories(checkins, rows_of):
    visits = ["1A0", "1B0", "2A0", "1B0", "1A1", "1B0", "2C0"]
    df = checkins(
        [{"user_id": v[0], "POI_id": v[1], "trajectory_id": f"{v[0]}_{v[2]}"} for v in visits]
    )
    edges, nodes = flow.flow_edges(df), flow.flow_nodes(df)
    assert rows_of(edges) == [("A", "B", 1), ("A", "C", 1), ("B", "B", 1)]
    assert rows_of(nodes) == [("A", 3), ("B", 3), ("C", 1)]
    assert rows_of(flow.degrees(nodes, edges)) == [("A", 2), ("B", 3), ("C", 1)]


PLACES = {"A": (40.70, -74.00), "B": (40.71, -74.00), "C": (40.70, -73.99)}


@pytest.mark.parametrize(
    "move, formula, reward",
    [
        ("AB", "reference", 1.0),
        ("AC", "reference", 0.944364),
        ("BC", "reference", 0.928058),
        ("AB", "haversine", 0.944364),
        ("AC", "haversine", 1.0),
        ("BC", "haversine", 0.859379),
    ],
)
def test_distance_reward(checkins, move, formula, reward):
    rows = [{"POI_id": p, "latitude": PLACES[p][0], "longitude": PLACES[p][1]} for p in move]
    [edge] = flow.flow_edges(checkins(rows), weight="geo", formula=formula).collect()
    assert edge["geo_weight"] == pytest.approx(reward, abs=1e-6)


def test_missing_coordinate_voids_the_edge(checkins):
    rows = [{"POI_id": p} for p in "ABAB"]
    rows[2]["latitude"] = None
    edges = {(r.src, r.dst): r.geo_weight for r in flow.flow_edges(checkins(rows), weight="geo").collect()}
    assert edges[("A", "B")] is None and edges[("B", "A")] is None


def test_first_row_gives_attributes_last_row_the_mapping(checkins, rows_of):
    rows = [{"POI_catname": n, "POI_category": n.upper()} for n in ("x", "y", "z")]
    df = checkins(rows)
    assert rows_of(flow.flow_nodes(df, attributes=["POI_catname"])) == [("A", 3, "x")]
    assert rows_of(features.poi_categories(df)) == [("A", "z", "Z")]


def test_shared_places(checkins, rows_of):
    df = checkins([{"user_id": u, "POI_id": p} for u, p in ["1A", "1A", "1B", "2A", "2B", "3B"]])
    assert rows_of(users.user_nodes(df)) == [("1", 2), ("2", 2), ("3", 1)]
    assert rows_of(users.user_edges(df), "u", "v", "weight") == [("1", "2", 2), ("1", "3", 1), ("2", "3", 1)]
    assert rows_of(users.user_edges(df, exclude_poi="B"), "u", "v", "weight") == [("1", "2", 1)]


def _meetings():
    rows = []
    for hour, order in ((1, "12"), (2, "21"), (3, "21")):
        rows += [{"user_id": u, "local_time": f"2024-01-01 0{hour}:10:00"} for u in order]
    for u in "12":
        rows += [{"user_id": u, "local_time": f"2024-01-0{2 + int(u)} 0{h}:00:00"} for h in (1, 2)]
    return rows


def test_cooccurrence_orientation(checkins, rows_of):
    df = checkins(_meetings())
    activity = users.user_activity(df)
    for mode, freq, similarity in (("reference", 4, 4 / 6), ("unordered", 6, 1.5)):
        pairs = users.cooccurrence_pairs(df, mode)
        assert rows_of(pairs) == [("1", "2", freq)]
        [row] = users.user_similarity(pairs, activity).collect()
        assert row["similarity"] == pytest.approx(similarity)
    assert users.cooccurrence_groups(df).count() == 6
    with pytest.raises(ValueError):
        users.cooccurrence_pairs(df, "other")


def test_zero_denominator_is_null(checkins):
    df = checkins([{"user_id": "1"}, {"user_id": "2"}])
    [row] = users.user_similarity(users.cooccurrence_pairs(df), users.user_activity(df)).collect()
    assert (row["freq"], row["similarity"]) == (2, None)


def test_similar_users_and_blend(spark, rows_of):
    sims = [("0", "1", 0.5), ("0", "2", 0.3), ("0", "3", 0.2)]
    table = spark.createDataFrame(sims, "u string, v string, similarity double")
    top = users.similar_users(table, 2).filter("user_id = '0'")
    assert rows_of(top, "neighbor", "rk") == [("2", 1), ("3", 2)]
    strict = users.similar_users(table, 2, skip_first=False).filter("user_id = '0'")
    assert rows_of(strict, "neighbor", "rk") == [("1", 1), ("2", 2)]
    weights = {r["neighbor"]: r["weight"] for r in users.neighbour_weights(top).collect()}
    assert weights["2"] == pytest.approx(0.524979, abs=1e-6)
    assert weights["3"] == pytest.approx(0.475021, abs=1e-6)
    vectors = spark.createDataFrame(
        [("0", [1.0, 0.0]), ("2", [0.0, 1.0]), ("3", [1.0, 1.0])], "user_id string, vector array<double>"
    )
    mixed = {r["user_id"]: r["vector"] for r in users.neighbor_blend(top, vectors).collect()}
    assert mixed["0"] == pytest.approx([0.7 + 0.3 * 0.475021, 0.3], abs=1e-6)
    assert mixed["3"] == [1.0, 1.0]


def _validation(checkins, spark):
    pois = ["p1", "X", "p2", "p3", "p4", "p5"]
    df = checkins([{"POI_id": p, "norm_in_day_time": (i + 1) / 10} for i, p in enumerate(pois)])
    vocab = spark.createDataFrame([(f"p{i}", i) for i in range(1, 6)], "value string, idx long")
    return df, vocab, spark.createDataFrame([("1",)], "user_id string")


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_validation_pairing(checkins, spark, rows_of, hot_rows):
    df, vocab, known = _validation(checkins, spark)
    columns = ["in_poi", "in_time", "label_poi", "label_time"]
    plain = sequences.val_sequences(df, vocab, known, hot_rows=hot_rows)
    assert rows_of(plain, *columns) == [(i, i / 10, i + 1, (i + 1) / 10) for i in range(1, 5)]
    aligned = sequences.val_sequences(df, vocab, known, align=True, hot_rows=hot_rows)
    times = [0.1, 0.3, 0.4, 0.5, 0.6]
    assert rows_of(aligned, *columns) == [(i, times[i - 1], i + 1, times[i]) for i in range(1, 5)]
    nobody = known.filter("user_id = 'x'")
    assert sequences.val_sequences(df, vocab, nobody).count() == 0
    assert sequences.val_sequences(df, vocab, known, thres=5).count() == 0


def test_label_week(checkins, spark, rows_of):
    df = checkins([{"POI_id": "p1", "day_of_week": d} for d in range(5)])
    vocab = features.build_vocab(df, "POI_id")
    assert [r[0] for r in rows_of(sequences.train_sequences(df, vocab), "label_week")] == [0, 1, 2, 3]
    shifted = sequences.train_sequences(df, vocab, shift_week=True)
    assert [r[0] for r in rows_of(shifted, "label_week")] == [1, 2, 3, 4]
    assert sequences.train_sequences(df, vocab, thres=5).count() == 0


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_relative_location(spark, hot_rows):
    rows = [("t", i, 40.0 + i / 10, 5.0) for i in range(3)]
    df = spark.createDataFrame(rows, "trajectory_id string, step int, lat double, lon double")
    out = sequences.relative_location(df, ["lat", "lon"], hot_rows=hot_rows).orderBy("step").collect()
    assert [r["rel_lat"] for r in out] == pytest.approx([0, 0.008726603, 0.017453205], abs=1e-9)
    assert [r["rel_lon"] for r in out] == [0.0, 0.0, 0.0]


RANKING = [7, 3, 9, 1]


def _ranking(spark):
    scores = [("t", s, item, float(9 - r)) for s in (0, 1) for r, item in enumerate(RANKING)]
    labels = [("t", 0, 3), ("t", 1, 9)]
    return (
        spark.createDataFrame(scores, "traj_id string, step int, item int, score double"),
        spark.createDataFrame(labels, "traj_id string, step int, item int"),
    )


def test_last_step_metrics(spark):
    [row] = evaluate.metrics_last_step(*_ranking(spark)).collect()
    assert (row["top1"], row["top5"], row["recall20"]) == (0.0, 1.0, 1.0)
    assert row["map20"] == row["mrr"] == pytest.approx(1 / 3)
    assert row["ndcg20"] == pytest.approx(0.693426, abs=1e-6)


@pytest.mark.parametrize("salts", [None, 3])
def test_label_stats(spark, salts):
    scores, labels = _ranking(spark)
    labels = labels.union(spark.createDataFrame([("t", 1, 5), ("u", 0, 1)], labels.schema))
    stats = evaluate.label_stats(scores, labels, loss=True, salts=salts).collect()
    ranks = {(r["traj_id"], r["step"], r["label"]): r["rank"] for r in stats}
    assert ranks == {("t", 0, 3): 2, ("t", 1, 9): 3, ("t", 1, 5): None, ("u", 0, 1): None}
    total = math.log(sum(math.exp(9 - r) for r in range(4)))
    assert all(r["logsumexp"] == pytest.approx(total) for r in stats if r["traj_id"] == "t")


def test_equal_scores_rank_the_smaller_item_first(spark):
    scores = spark.createDataFrame(
        [("t", 0, i, 1.0) for i in (4, 2, 3)], "traj_id string, step int, item int, score double"
    )
    labels = spark.createDataFrame([("t", 0, 3)], "traj_id string, step int, item int")
    [row] = evaluate.label_stats(scores, labels).collect()
    assert row["rank"] == 2
    assert evaluate.argmax_decode(scores).first()["item"] == 2
    with pytest.raises(ValueError):
        evaluate.top_k(scores, 0)


def test_cross_entropy_and_mse(spark):
    scores, labels = _ranking(spark)
    ignored = labels.union(spark.createDataFrame([("t", 0, -1)], labels.schema))
    [row] = evaluate.cross_entropy(scores, ignored).collect()
    total = math.log(sum(math.exp(9 - r) for r in range(4)))
    assert row["steps"] == 2 and row["loss"] == pytest.approx(total - 7.5)
    pairs = spark.createDataFrame([(1.0, 3.0), (5.0, -1.0), (2.0, 2.0)], "p double, t double")
    assert evaluate.masked_mse(pairs, "p", "t").first()["loss"] == 2.0


@pytest.mark.parametrize("losses, balance", [((1, 1, 1), 1.0), ((3, 0, 0), 1 / 3), ((0, 0, 0), 0.0)])
def test_loss_balance(spark, losses, balance):
    columns = [F.lit(float(x)) for x in losses]
    assert spark.range(1).select(evaluate.loss_balance(*columns)).first()[0] == pytest.approx(balance)


def test_best_epoch_prefers_later_ties_and_skips_nan(spark):
    rows = [(1, 0.2), (2, 0.5), (5, 0.5), (6, float("nan")), (7, 0.1)]
    scored = spark.createDataFrame(rows, "epoch int, monitor_score double")
    assert evaluate.best_epoch(scored).first()["epoch"] == 5
    assert evaluate.best_epoch(scored.filter("epoch = 6")).count() == 0


def test_mean_of_batch_means(spark):
    rows = [(1, "val", 0, 1.0), (1, "val", 0, 0.0), (1, "val", 1, 1.0)]
    df = spark.createDataFrame(rows, "epoch int, split string, batch int, top1 double")
    assert evaluate.epoch_metrics(df, ["top1"]).first()["top1"] == 0.75
    assert evaluate.epoch_metrics(df, ["top1"], per_sample=True).first()["top1"] == pytest.approx(2 / 3)


def _visits():
    kept = {"POI_catname": "a", "POI_category": "T"}
    return [
        {**kept, "UTC_time": "2024-01-01T09:00:00", "norm_in_day_time": 0.375},
        {**kept, "POI_catname": "b", "UTC_time": "2024-01-01T10:00:00", "norm_in_day_time": 0.42},
        {**kept, "POI_catname": "x", "UTC_time": "2024-01-02T12:00:00", "norm_in_day_time": 0.5, "day_of_week": 2},
    ]


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_validation_context_and_prompt(checkins, spark, hot_rows):
    allow = spark.createDataFrame(
        [("place_name", "a"), ("place_name", "b"), ("place_type", "T")], "kind string, value string"
    )
    rows = list(reversed(_visits()))
    points = corpus.corpus_points(checkins(rows), allow, hot_rows=hot_rows)
    [sample] = corpus.corpus_samples(points).collect()
    context = sample["input"]["context"]
    assert (context["day_of_week"], context["time_of_day"], context["date"]) == (2, 0.5, "2024-01-01")
    assert [v["place_name"] for v in sample["input"]["history"]] == ["a"]
    assert sample["output"]["next_location"]["place_name"] == "b"
    [text] = corpus.render_prompts(corpus.corpus_samples(points)).collect()
    assert text["prompt"] == (
        "User ID: 1\nTrajectory ID: 1_0\n\nHistorical visits: \n"
        "- Time: 2024-01-01T09:00:00, Location: a (T), Weekday: 1, Time of day: 0.38\n\n"
        "Current context:\n- Date: 2024-01-01\n- Weekday: 2\n- Time of day: 0.50\n\n"
        "Please predict the user's next visit location."
    )
    assert text["completion"] == '{"place_name": "b", "place_type": "T"}'


def test_completion_keeps_quotes_and_accents(checkins):
    rows = _visits()
    rows[2]["POI_catname"] = 'Café "x"'
    samples = corpus.corpus_samples(corpus.corpus_points(checkins(rows)))
    assert corpus.render_prompts(samples).first()["completion"] == (
        '{"place_name": "Café \\"x\\"", "place_type": "T"}'
    )


def test_short_trajectories_give_no_sample(checkins):
    assert corpus.corpus_points(checkins(_visits()[:1])).count() == 0


def test_metadata_document(checkins):
    parts = {(r["kind"], r["chunk"]): r["values"] or r["total"] for r in corpus.corpus_metadata(checkins(_visits()), 2).collect()}
    assert parts == {
        ("place_name", 0): ["a", "b"], ("place_name", 1): ["x"], ("place_type", 0): ["T"],
        ("total_samples", 0): 1, ("total_users", 0): 1, ("total_trajectories", 0): 1,
    }
    [texts] = corpus.allow_list_texts(corpus.corpus_metadata(checkins(_visits()), 2)).collect()
    assert texts["place_names"] == '["a","b","x"]'


def test_number_text(spark):
    df = spark.createDataFrame([(0.125,), (1.005,), (None,)], "x double").coalesce(1)
    assert [r[0] for r in df.select(two_decimals("x")).collect()] == ["0.12", "1.00", None]


def test_prediction_text(spark):
    good = '{"place_name":"A","place_type":"B"}'
    raws = [good, good + " junk", "{'place_name':'A'}", "null", "", "5", '{"place_name":"A"}', None]
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "id string, raw string")
    parsed = {r["id"] for r in df.filter(parse_prediction("raw")["parsed"]).collect()}
    assert parsed == {"0", "6"}
    expected = df.select("id", F.lit("A").alias("place_name"), F.lit("B").alias("place_type"))
    [row] = corpus.accuracy(corpus.score_predictions(expected, df, ["id"])).collect()
    assert (row["total"], row["correct"], row["accuracy"]) == (2, 1, 0.5)
    [row] = corpus.accuracy(corpus.score_predictions(expected, df.filter("id = '3'"), ["id"])).collect()
    assert (row["total"], row["accuracy"]) == (0, 0.0)


def test_matrix_kinds(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    edges = spark.createDataFrame([("a", "a", 1), ("a", "b", 3), ("b", "a", 2)], "src string, dst string, weight long")

    def cells(kind, **options):
        out = algebra.laplacian(edges, nodes, kind, **options).collect()
        return {(r["src"], r["dst"]): r["value"] for r in out}

    assert cells("com_lap_mat") == {("a", "a"): 3, ("a", "b"): -3, ("b", "b"): 2, ("b", "a"): -2}
    hat = cells("hat_rw_normd_lap_mat")
    assert hat == pytest.approx({("a", "a"): 0.4, ("a", "b"): 0.6, ("b", "b"): 1 / 3, ("b", "a"): 2 / 3})
    wid = cells("wid_rw_normd_lap_mat")
    assert wid == pytest.approx({("a", "a"): 0.5, ("a", "b"): -1.5, ("b", "b"): 1.0, ("b", "a"): -2.0})
    assert cells("wid_rw_normd_lap_mat", lambda_max=2.0)[("a", "b")] == pytest.approx(-0.75)
    assert algebra.dominant_eigenvalue(edges, nodes) == pytest.approx(1.0, abs=1e-6)
    with pytest.raises(ValueError):
        algebra.laplacian(edges, nodes, "sym")
    sink = nodes.union(spark.createDataFrame([("c",)], "node string"))
    with pytest.raises(Exception, match="without outgoing weight: c"):
        algebra.laplacian(edges, sink, "wid_rw_normd_lap_mat").collect()


def test_node_vectors_match_long_form(spark):
    rows = [("a", 5, 30, 1.0, 2.0), ("b", 7, 4, 3.0, 4.0), ("c", 1, 30, 5.0, 6.0)]
    nodes = spark.createDataFrame(
        rows, "node string, checkin_cnt long, POI_catid_code int, latitude double, longitude double"
    )
    vectors = {r["node"]: list(r["features"].toArray()) for r in features.node_vectors(nodes).collect()}
    assert vectors == {"a": [5, 0, 1, 1, 2], "b": [7, 1, 0, 3, 4], "c": [1, 0, 1, 5, 6]}
    dense = {n: [0.0] * 5 for n in "abc"}
    for r in features.node_features(nodes).collect():
        dense[r["node"]][r["feature"]] = r["value"]
    assert dense == vectors


def test_node_vectors_keep_nodes_without_category(spark):
    rows = [("a", 5, 30, 1.0, 2.0), ("b", 7, None, 3.0, 4.0), ("c", 1, 4, None, 6.0)]
    nodes = spark.createDataFrame(
        rows, "node string, checkin_cnt long, POI_catid_code int, latitude double, longitude double"
    )
    vectors = {r["node"]: list(r["features"].toArray()) for r in features.node_vectors(nodes).collect()}
    assert vectors["a"] == [5, 0, 1, 1, 2] and vectors["b"] == [7, 0, 0, 3, 4]
    assert vectors["c"][:3] == [1, 1, 0] and math.isnan(vectors["c"][3])
    assert features.node_vectors(nodes.filter("node = 'b'")).count() == 1


def test_zscore_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "x double, y double")
    out, means, deviations = features.zscore(df, ["x", "y"])
    assert sorted(tuple(r) for r in out.collect()) == [(-1.0, None), (1.0, None)]
    assert (means, deviations) == ([2.0, 2.0], [1.0, 0.0])


def test_clusters_and_time_features(checkins):
    rows = [{"latitude": 40.0 + (i % 3), "longitude": -74.0 + (i % 3)} for i in range(30)]
    df = features.location_clusters(checkins(rows), k=3)
    sizes = df.groupBy("location_cluster").count().collect()
    assert sorted(r["count"] for r in sizes) == [10, 10, 10]
    lost = features.location_clusters(checkins([*rows, {"latitude": None}, {"longitude": None}]), k=3)
    assert lost.count() == 32 and lost.filter("location_cluster IS NULL").count() == 2
    assert features.location_clusters(checkins([{"latitude": None}]), k=3).first()["location_cluster"] is None
    assert features.location_clusters(checkins(rows).limit(0)).count() == 0
    times = ["2024-01-01 05:59:59", "2024-01-07 06:00:00", "2024-01-02 12:00:00", "2024-01-02 18:00:00", "bad", None]
    out = features.time_features(checkins([{"local_time": t} for t in times])).orderBy("row_pos").collect()
    assert [(r["hour"], r["weekday"], r["time_period"]) for r in out] == [
        (5, 0, "0-5"),
        (6, 6, "6-11"),
        (12, 1, "12-17"),
        (18, 1, "18-23"),
    ]


def test_fill_with_popular_places(spark, rows_of):
    steps = spark.createDataFrame([("t", 0, "a"), ("t", 1, "z")], "trajectory_id string, step int, in_poi string")
    edges = spark.createDataFrame([("a", "b", 3), ("a", "c", 1)], "src string, dst string, weight long")
    popular = spark.createDataFrame([("b", 9), ("d", 5), ("e", 4), ("f", 1)], "node string, checkin_cnt long")
    ranked = sequences.rank_next(steps, edges, 3, popular=popular)
    assert rows_of(ranked) == [
        ("t", 0, "b", 0.75),
        ("t", 0, "c", 0.25),
        ("t", 0, "d", -1.0),
        ("t", 1, "b", -1.0),
        ("t", 1, "d", -2.0),
        ("t", 1, "e", -3.0),
    ]
    assert rows_of(sequences.rank_next(steps, edges, 1)) == [("t", 0, "b", 0.75)]


@pytest.mark.parametrize("hot_rows, at_once", [(None, 1 << 16), (1, 2)])
def test_back_off_to_all_places(spark, rows_of, monkeypatch, hot_rows, at_once):
    monkeypatch.setattr(sequences, "RANKS_AT_ONCE", at_once)
    steps = spark.createDataFrame(
        [("t", 0, "a"), ("t", 1, "z"), ("s", 0, "a"), ("s", 1, "a"), ("s", 2, "f")],
        "trajectory_id string, step int, in_poi string",
    )
    edges = spark.createDataFrame([("a", "b", 3), ("a", "e", 1), ("f", "g", 2)], "src string, dst string, weight long")
    popular = spark.createDataFrame(
        [("b", 9), ("d", 5), ("e", 5), ("f", 1), ("g", 1), ("c", 7)], "node string, checkin_cnt long"
    )
    of_a = [("b", 0.75), ("e", 0.25), ("c", -1.0), ("d", -2.0), ("f", -3.0), ("g", -4.0)]
    of_z = [("b", -1.0), ("c", -2.0), ("d", -3.0), ("e", -4.0), ("f", -5.0), ("g", -6.0)]
    of_f = [("g", 1.0), ("b", -1.0), ("c", -2.0), ("d", -3.0), ("e", -4.0), ("f", -5.0)]
    want = [(t, i, *x) for t, i, rows in (("t", 0, of_a), ("t", 1, of_z), ("s", 0, of_a), ("s", 1, of_a), ("s", 2, of_f)) for x in rows]
    ranked = sequences.rank_next(steps, edges, popular=popular, hot_rows=hot_rows)
    assert rows_of(ranked) == sorted(want, key=repr)
    assert sequences.rank_next(steps, edges, popular=popular.limit(0), hot_rows=hot_rows).count() == 7


def test_dense_export_fills_gaps(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    edges = spark.createDataFrame([("a", "b", 3)], "src string, dst string, weight long")
    rows = [(r["node"], r["row"]) for r in flow.dense_rows(edges, nodes).orderBy("idx").collect()]
    assert rows == [("a", [0.0, 3.0]), ("b", [0.0, 0.0])]
