"""Properties that hold for any input, edge cases, files and the named queries."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from check_queries import normalised
from randomdata import random_rows
from trajflow.operators import algebra, corpus, evaluate, features, flow, sequences, users
from trajflow.plans import catalog
from trajflow.session import kept, release, scratch_dir, scratch_path
from trajflow.sources import io
from trajflow.sources.schema import PLACE_ATTRIBUTES

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(checkins):
    df = checkins(random_rows(41, nulls=False))
    return df, flow.flow_nodes(df, attributes=PLACE_ATTRIBUTES), flow.flow_edges(df, weight="both")


def test_edge_weights_count_the_steps(graph):
    df, _, edges = graph
    w = "OVER (PARTITION BY user_id ORDER BY row_pos)"
    runs = df.selectExpr(f"trajectory_id <> coalesce(lag(trajectory_id) {w}, '') AS start")
    starts = runs.filter("start").count()
    assert edges.agg(F.sum("weight")).first()[0] == df.count() - starts
    assert edges.filter("geo_weight > weight + 1e-9 OR geo_weight < 0.76 * weight").count() == 0


def test_matrix_rows(graph):
    _, nodes, edges = graph
    for kind, total in (("com_lap_mat", 0.0), ("hat_rw_normd_lap_mat", 1.0)):
        sums = algebra.laplacian(edges, nodes, kind).groupBy("src").agg(F.sum("value").alias("s"))
        assert all(r["s"] == pytest.approx(total, abs=1e-9) for r in sums.collect())


def test_results_do_not_depend_on_partitions(checkins, rows_of):
    rows = random_rows(43)
    df = checkins(rows)
    shuffled = df.orderBy(F.rand(5)).repartition(7)
    assert rows_of(flow.flow_edges(df)) == rows_of(flow.flow_edges(shuffled))
    assert rows_of(users.cooccurrence_pairs(df)) == rows_of(users.cooccurrence_pairs(shuffled))
    vocab = features.build_vocab(df, "POI_id")
    assert rows_of(sequences.train_sequences(df, vocab)) == rows_of(sequences.train_sequences(shuffled, vocab))


def test_empty_and_single_inputs(checkins, spark):
    empty = checkins([{}]).limit(0)
    vocab = features.build_vocab(empty, "POI_id")
    assert flow.flow_edges(empty).count() == 0
    assert users.user_edges(empty).count() == 0
    assert users.cooccurrence_pairs(empty).count() == 0
    assert sequences.train_sequences(empty, vocab).count() == 0
    assert corpus.metadata_allow_lists(corpus.corpus_metadata(empty)).count() == 0
    one = checkins([{}])
    assert flow.flow_edges(one).count() == 0 and flow.flow_nodes(one).count() == 1
    assert users.user_edges(one).count() == 0
    assert features.time_features(checkins([{"local_time": None}])).count() == 0
    stats = flow.graph_stats(flow.flow_nodes(one), flow.flow_edges(one)).filter("measure = 'weight'")
    assert {r["stat"]: r["value"] for r in stats.collect()} == dict.fromkeys(
        ["mean", "p0", "p20", "p40", "p60", "p80", "p100"]
    ) | {"count": 0.0}
    with pytest.raises(ValueError):
        flow.flow_edges(one, weight="other")


def test_running_means_with_cuts(spark, rows_of):
    rows = [(e, "val", b, float(b % 5)) for e in (1, 2) for b in range(30)]
    df = spark.createDataFrame(rows, "epoch int, split string, batch int, top1 double")
    plain = evaluate.running_metrics(df, ["top1"])
    parts = evaluate.running_metrics(df, ["top1"], hot_rows=7)
    assert rows_of(plain.withColumn("top1", F.round("top1", 9))) == rows_of(
        parts.withColumn("top1", F.round("top1", 9))
    )
    assert plain.filter("batch = 4 AND epoch = 1").first()["top1"] == 2.0


def test_checkin_files(checkins, spark, tmp_path, rows_of):
    rows = random_rows(45, n=50)
    rows[0]["POI_catname"] = 'Mac, "Cheese" Joint'
    df = checkins(rows)
    io.write_checkins(df, f"{tmp_path}/csv")
    assert rows_of(io.read_checkins(spark, f"{tmp_path}/csv").select(df.columns)) == rows_of(df)
    io.write_checkins(df, f"{tmp_path}/parquet", "parquet")
    assert rows_of(io.read_checkins(spark, f"{tmp_path}/parquet", "parquet").select(df.columns)) == rows_of(df)
    io.write_checkins(df.orderBy("row_pos").coalesce(1).drop("row_pos"), f"{tmp_path}/bare")
    bare = io.read_checkins(spark, f"{tmp_path}/bare")
    assert rows_of(flow.flow_edges(bare)) == rows_of(flow.flow_edges(df))
    io.write_checkins(df.repartition(3).drop("row_pos"), f"{tmp_path}/many")
    with pytest.raises(ValueError):
        io.read_checkins(spark, f"{tmp_path}/many")
    assert io.read_checkins(spark, f"{tmp_path}/many", order=["UTC_time"]).count() == 51
    io.write_checkins(df.drop("POI_category", "row_pos").coalesce(1), f"{tmp_path}/plain")
    assert io.read_checkins(spark, f"{tmp_path}/plain").filter("POI_category IS NULL").count() == 51
    io.write_checkins(df.drop("latitude"), f"{tmp_path}/broken")
    with pytest.raises(ValueError):
        io.read_checkins(spark, f"{tmp_path}/broken")


def test_graph_files(graph, spark, tmp_path, rows_of):
    _, nodes, edges = graph
    io.write_nodes(nodes, f"{tmp_path}/nodes")
    back = io.read_nodes(spark, f"{tmp_path}/nodes")
    assert rows_of(back) == rows_of(nodes) and back.dtypes == nodes.dtypes
    features_ = ["checkin_cnt", "latitude", "longitude"]
    for variant, width in ((1, 3), (2, 1), (0, 2)):
        assert io.read_node_variant(spark, f"{tmp_path}/nodes", variant, features_).columns == features_[:width]
    io.write_adjacency(edges, nodes, f"{tmp_path}/dense")
    listed = flow.indexed_edges(edges, flow.node_index(nodes)).withColumn("weight", F.col("weight").cast("double"))
    assert rows_of(io.read_adjacency(spark, f"{tmp_path}/dense")) == rows_of(listed)
    io.write_edge_list(edges, nodes, f"{tmp_path}/list")
    index, indexed = io.read_edge_list(spark, f"{tmp_path}/list")
    assert rows_of(indexed) == rows_of(listed) and index.count() == nodes.count()
    io.write_graph(nodes, edges, f"{tmp_path}/graph")
    nodes2, edges2 = io.read_graph(spark, f"{tmp_path}/graph")
    assert rows_of(nodes2) == rows_of(nodes) and rows_of(edges2) == rows_of(edges)


def test_corpus_files(checkins, spark, tmp_path, rows_of):
    df = checkins(random_rows(47))
    samples = corpus.corpus_samples(corpus.corpus_points(df))
    io.write_samples(samples, f"{tmp_path}/samples")
    assert rows_of(io.read_samples(spark, f"{tmp_path}/samples")) == rows_of(samples)
    (tmp_path / "array.json").write_text("[" + ",\n".join(r[0] for r in samples.selectExpr("to_json(struct(*))").collect()) + "]")
    assert rows_of(io.read_samples(spark, f"{tmp_path}/array.json", multiline=True)) == rows_of(samples)
    metadata = corpus.corpus_metadata(df)
    io.write_metadata(metadata, f"{tmp_path}/metadata")
    assert rows_of(io.read_metadata(spark, f"{tmp_path}/metadata")) == rows_of(metadata)
    io.write_metadata(corpus.corpus_metadata(df, 2), f"{tmp_path}/chunked")
    assert rows_of(io.read_metadata(spark, f"{tmp_path}/chunked")) == rows_of(metadata)
    [text] = [f for f in os.listdir(f"{tmp_path}/chunked") if f.endswith(".txt")]
    with open(f"{tmp_path}/chunked/{text}") as file:
        names = json.load(file)["valid_place_names"]
    assert names == sorted(names) and len(names) > 2
    io.write_metadata(corpus.corpus_metadata(df.limit(0)), f"{tmp_path}/empty")
    assert io.read_metadata(spark, f"{tmp_path}/empty").filter("values IS NOT NULL OR total > 0").count() == 0
    prompts = corpus.render_prompts(samples)
    io.write_training_lines(prompts, f"{tmp_path}/lines")
    assert rows_of(io.read_training_lines(spark, f"{tmp_path}/lines")) == rows_of(prompts, "prompt", "completion")
    assert rows_of(io.materialise(prompts, f"{tmp_path}/kept")) == rows_of(prompts)
    drawn = corpus.sample_rows(prompts, 3, seed=1)
    assert rows_of(drawn) == rows_of(corpus.sample_rows(prompts.repartition(5), 3, seed=1))
    assert corpus.sample_rows(prompts, 10_000).count() == prompts.count()


def test_caller_scorer(checkins, spark):
    df = checkins(random_rows(49, nulls=False))
    steps = sequences.train_sequences(df, features.build_vocab(df, "POI_id"))

    def scorer(batches):
        for pdf in batches:
            yield pdf[["trajectory_id", "step"]].assign(item=pdf["in_poi"], score=1.0)

    out = sequences.score_sequences(steps, scorer, "trajectory_id string, step int, item long, score double")
    assert out.count() == steps.count()


class _Session:
    """What is asked of a session, with a checkpoint folder or without."""

    master = "local[2]"

    def __init__(self, folder):
        self.folder = folder
        self.conf = self.sparkContext = self
        self.applicationId = "local-1"

    def get(self, name, default):
        return self.folder if name == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return None


def test_scratch_folder_follows_the_session():
    assert scratch_path(_Session("hdfs://shared/"), "x").startswith("hdfs://shared/x-")
    assert scratch_dir(_Session(None)) == scratch_dir(_Session(None)) != "hdfs://shared"


def test_entry(spark):
    assert contract.entry(spark).columns == ["src", "dst", "weight"]


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == set()


@pytest.mark.parametrize(
    "name",
    [
        "flow_nodes_poi",
        "flow_edges_geo",
        "graph_stats",
        "user_edges",
        "user_similarity",
        "val_sequences",
        "padded_batches",
        "metrics_last_step",
        "monitor_scores",
        "corpus_prompts",
        "prediction_accuracy",
    ],
)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "lineitem", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    got = contract.queries()[name](spark, TABLES).toPandas()
    want = con.sql(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normalised(got) == normalised(want)


def test_kept_tables_live_until_released(spark):
    first = kept(spark.range(3), "three")
    assert kept(spark.range(9), "three").count() == 3
    [path] = {f.rsplit("/", 1)[0].removeprefix("file:") for f in first.inputFiles()}
    assert os.path.isdir(path)
    kept(spark.range(1), "one")
    release(spark, "three")
    assert not os.path.isdir(path) and kept(spark.range(9), "three").count() == 9
    assert kept(spark.range(7), "one").count() == 1
    release(spark)
    assert kept(spark.range(2), "one").count() == 2
    release(spark)
