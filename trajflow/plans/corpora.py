"""Queries over prompt corpora and over files written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajflow.operators import corpus, flow
from trajflow.plans import graphs
from trajflow.plans.metrics import epoch_log
from trajflow.plans.registry import cte, query, sql
from trajflow.plans.testdata import ORDER, checkins, training, validation
from trajflow.session import scratch_path
from trajflow.sources import io
from trajflow.sources.schema import CHECKIN, PLACE_ATTRIBUTES

cte(
    "alw",
    "SELECT DISTINCT 'place_name' AS kind, POI_catname AS value FROM tr UNION SELECT DISTINCT 'place_type', POI_category FROM tr",
)


def narrowed(spark, sf_dir):
    """Training allow-lists without one name and one type, so that some rows fall out."""
    lists = corpus.allow_lists(training(spark, sf_dir))
    return lists.filter(~F.col("value").isin("name_3", "type_2"))


def _points_sql(source: str, kept: str) -> str:
    return f"""SELECT user_id, trajectory_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos,
      count(*) OVER (PARTITION BY user_id, trajectory_id) AS n, UTC_time AS timestamp, longitude, latitude,
      POI_catname AS place_name, POI_category AS place_type, day_of_week, norm_in_day_time AS time_of_day,
      context_day, context_time
    FROM (SELECT *, last_value(day_of_week) OVER f AS context_day, last_value(norm_in_day_time) OVER f AS context_time
          FROM {source} WINDOW f AS (PARTITION BY user_id, trajectory_id ORDER BY UTC_time, ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    WHERE {kept} WINDOW w AS (PARTITION BY user_id, trajectory_id ORDER BY UTC_time, ts, event_id)"""


cte(
    "alc",
    "SELECT DISTINCT 'place_name' AS kind, POI_catname AS value FROM ck UNION SELECT DISTINCT 'place_type', POI_category FROM ck",
)
cte("cpa", _points_sql("ck", "true"))
cte("cpt", "SELECT * FROM cpa WHERE n >= 2")
cte(
    "cva",
    _points_sql(
        "va",
        """POI_catname IN (SELECT value FROM alw WHERE kind = 'place_name' AND value <> 'name_3')
        AND POI_category IN (SELECT value FROM alw WHERE kind = 'place_type' AND value <> 'type_2')""",
    ),
)
cte("cpv", "SELECT * FROM cva WHERE n >= 2")


def all_points(spark, sf_dir):
    return corpus.corpus_points(checkins(spark, sf_dir), order=ORDER)


def validation_points(spark, sf_dir):
    return corpus.corpus_points(validation(spark, sf_dir), narrowed(spark, sf_dir), ORDER)


def _flat(samples):
    """History and target of nested samples as rows."""
    target = F.col("output.next_location")
    history = F.transform("input.history", lambda v: F.struct(v.alias("v"), v["place_name"].alias("name")))
    rows = samples.select(
        F.col("input.user_id").alias("user_id"),
        F.col("input.trajectory_id").alias("trajectory_id"),
        F.col("input.context.day_of_week").alias("context_day"),
        F.col("input.context.time_of_day").alias("context_time"),
        F.col("input.context.date").alias("context_date"),
        target["place_name"].alias("target_name"),
        target["place_type"].alias("target_type"),
        F.posexplode(history).alias("pos", "h"),
    )
    return rows.select("*", "h.v.*").drop("h")


FLAT_SQL = """SELECT user_id, trajectory_id, pos, timestamp, longitude, latitude, place_name, place_type,
  day_of_week, time_of_day, context_day, context_time, context_date, target_name, target_type FROM (
    SELECT *, max(split_part(timestamp, 'T', 1)) OVER t AS context_date,
      arg_max(place_name, pos) OVER t AS target_name, arg_max(place_type, pos) OVER t AS target_type
    FROM {table} WINDOW t AS (PARTITION BY user_id, trajectory_id)) WHERE pos < n - 1"""


@query(
    "corpus_metadata",
    sql(
        "ck alc cpa cpt",
        """SELECT kind, value, CAST(0 AS BIGINT) AS total FROM alc
        UNION ALL SELECT 'total_samples', '', count(*) FILTER (pos = 0) FROM cpt
        UNION ALL SELECT 'total_users', '', count(DISTINCT user_id) FROM ck
        UNION ALL SELECT 'total_trajectories', '', count(DISTINCT trajectory_id) FROM ck""",
    ),
)
def corpus_metadata(spark, sf_dir):
    """The document, one row per list entry and total."""
    document = corpus.corpus_metadata(checkins(spark, sf_dir), chunk=7)
    lists = corpus.metadata_allow_lists(document).withColumn("total", F.lit(0).cast("long"))
    rest = document.filter(F.col("values").isNull()).select("kind", F.lit("").alias("value"), "total")
    return lists.unionByName(rest)


@query(
    "allow_list_texts",
    sql(
        "ck alc",
        """SELECT to_json(list(value ORDER BY value) FILTER (kind = 'place_name')) AS place_names,
          to_json(list(value ORDER BY value) FILTER (kind = 'place_type')) AS place_types FROM alc""",
    ),
)
def allow_list_texts(spark, sf_dir):
    return corpus.allow_list_texts(corpus.corpus_metadata(checkins(spark, sf_dir)))


@query("corpus_samples", sql("ck cpa cpt", FLAT_SQL.format(table="cpt")))
def corpus_samples(spark, sf_dir):
    return _flat(corpus.corpus_samples(all_points(spark, sf_dir)))


@query("corpus_val_samples", sql("ck tr va alw cva cpv", FLAT_SQL.format(table="cpv")))
def corpus_val_samples(spark, sf_dir):
    return _flat(corpus.corpus_samples(validation_points(spark, sf_dir)))


@query(
    "corpus_val_points",
    sql("ck tr va alw cva cpv", "SELECT user_id, trajectory_id, pos, CAST(n AS BIGINT) AS n, timestamp, place_name, context_day, context_time FROM cpv"),
)
def corpus_val_points(spark, sf_dir):
    """The step form of the samples, without arrays."""
    return validation_points(spark, sf_dir).select(
        "user_id", "trajectory_id", "pos", "n", "timestamp", "place_name", "context_day", "context_time"
    )


PROMPTS = """SELECT user_id, trajectory_id,
      'User ID: ' || user_id || chr(10) || 'Trajectory ID: ' || trajectory_id || chr(10) || chr(10)
      || 'Historical visits: ' || chr(10)
      || string_agg('- Time: ' || timestamp || ', Location: ' || place_name || ' (' || place_type || '), Weekday: '
           || day_of_week || ', Time of day: ' || printf('%.2f', time_of_day), chr(10) ORDER BY pos) FILTER (pos < n - 1)
      || chr(10) || chr(10) || 'Current context:' || chr(10) || '- Date: ' || max(split_part(timestamp, 'T', 1))
      || chr(10) || '- Weekday: ' || any_value(context_day) || chr(10) || '- Time of day: '
      || printf('%.2f', any_value(context_time)) || chr(10) || chr(10)
      || 'Please predict the user''s next visit location.' AS prompt,
      '{{"place_name": "' || arg_max(place_name, pos) || '", "place_type": "' || arg_max(place_type, pos) || '"}}'
        AS completion
    FROM {table} GROUP BY user_id, trajectory_id"""
cte("prm", PROMPTS.format(table="cpt"))
cte("prv", PROMPTS.format(table="cpv"))


def prompts(spark, sf_dir):
    return corpus.render_prompts(corpus.corpus_samples(all_points(spark, sf_dir)))


@query("corpus_prompts", sql("ck cpa cpt prm", "SELECT * FROM prm"))
def corpus_prompts(spark, sf_dir):
    return prompts(spark, sf_dir)


cte(
    "exp",
    """SELECT user_id, trajectory_id, place_name, place_type, n % 6 AS rule FROM cpv WHERE pos = n - 1""",
)
cte(
    "prd",
    """SELECT user_id, trajectory_id, CASE rule
      WHEN 0 THEN '{"place_name": "' || place_name || '", "place_type": "' || place_type || '"}'
      WHEN 1 THEN '{"place_name": "name_0", "place_type": "' || place_type || '"}'
      WHEN 2 THEN '{"place_name": "' || place_name || '", "place_type": "' || place_type || '"} sure'
      WHEN 3 THEN '{''place_name'': ''' || place_name || '''}'
      WHEN 4 THEN '{"place_name": "' || place_name || '"}' ELSE 'null' END AS raw FROM exp""",
)
cte(
    "scd",
    """SELECT user_id, trajectory_id, coalesce(json_extract_string(raw, '$.place_name') = place_name
        AND json_extract_string(raw, '$.place_type') = place_type, false) AS correct
    FROM (SELECT * FROM prd WHERE json_valid(raw) AND raw LIKE '{%') JOIN exp USING (user_id, trajectory_id)""",
)
SCORED = "ck tr va alw cva cpv exp prd scd"


def scored_predictions(spark, sf_dir):
    """Answers made from the labels by a rule: right, wrong and unreadable ones."""
    points = validation_points(spark, sf_dir)
    expected = points.filter(F.col("pos") == F.col("n") - 1).select(
        "user_id", "trajectory_id", "place_name", "place_type", (F.col("n") % 6).alias("rule")
    )
    name, kind = F.col("place_name"), F.col("place_type")
    full = F.concat(
        F.lit('{"place_name": "'), name, F.lit('", "place_type": "'), kind, F.lit('"}')
    )
    raw = (
        F.when(F.col("rule") == 0, full)
        .when(F.col("rule") == 1, F.concat(F.lit('{"place_name": "name_0", "place_type": "'), kind, F.lit('"}')))
        .when(F.col("rule") == 2, F.concat(full, F.lit(" sure")))
        .when(F.col("rule") == 3, F.concat(F.lit("{'place_name': '"), name, F.lit("'}")))
        .when(F.col("rule") == 4, F.concat(F.lit('{"place_name": "'), name, F.lit('"}')))
        .otherwise(F.lit("null"))
    )
    predictions = expected.select("user_id", "trajectory_id", raw.alias("raw"))
    return corpus.score_predictions(expected.drop("rule"), predictions)


@query(
    "prediction_accuracy",
    sql(
        SCORED,
        """SELECT count(*) AS total, count(*) FILTER (correct) AS correct,
          round(count(*) FILTER (correct) / CAST(count(*) AS DOUBLE), 9) AS accuracy FROM scd""",
    ),
)
def prediction_accuracy(spark, sf_dir):
    return corpus.accuracy(scored_predictions(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


@query(
    "prediction_failures",
    sql(
        SCORED + " prv",
        """SELECT user_id, trajectory_id, raw, completion, prompt FROM scd
        JOIN prd USING (user_id, trajectory_id) JOIN prv USING (user_id, trajectory_id) WHERE NOT correct""",
    ),
)
def prediction_failures(spark, sf_dir):
    """Wrong answers with the prompt they were given to and the completion expected."""
    asked = corpus.render_prompts(corpus.corpus_samples(validation_points(spark, sf_dir)))
    failed = corpus.failures(scored_predictions(spark, sf_dir), asked)
    return failed.select("user_id", "trajectory_id", "raw", "completion", "prompt")


@query(
    "sample_rows",
    sql(
        "ck tr va alw cva cpv",
        """SELECT user_id, trajectory_id FROM cpv WHERE pos = 0
        ORDER BY md5(concat_ws('|', '7', user_id, trajectory_id)), user_id, trajectory_id LIMIT 100""",
    ),
)
def sample_rows(spark, sf_dir):
    """A hundred samples drawn for validation."""
    points = validation_points(spark, sf_dir).filter(F.col("pos") == 0)
    return corpus.sample_rows(points.select(*corpus.SAMPLE_KEYS), 100, seed=7)


COLUMNS = ", ".join(CHECKIN.names)


@query("checkins_csv_roundtrip", sql("ck", f"SELECT event_id AS row_pos, {COLUMNS} FROM ck"))
def checkins_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "checkins")
    rows = checkins(spark, sf_dir).select(F.col("event_id").alias("row_pos"), *CHECKIN.names)
    io.write_checkins(rows, path)
    return io.read_checkins(spark, path)


@query(
    "nodes_csv_roundtrip",
    sql(
        "ck",
        """SELECT POI_id AS node, count(*) AS checkin_cnt, arg_min(POI_catname, (user_id, ts, event_id)) AS POI_catname,
          arg_min(latitude, (user_id, ts, event_id)) AS latitude FROM ck GROUP BY POI_id""",
    ),
)
def nodes_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "nodes")
    io.write_nodes(flow.flow_nodes(checkins(spark, sf_dir), "POI_id", PLACE_ATTRIBUTES, ORDER), path)
    return io.read_nodes(spark, path, ["node", "checkin_cnt", "POI_catname", "latitude"])


@query(
    "node_variants",
    sql(
        "ck",
        """SELECT variant, node, checkin_cnt, CASE WHEN variant <> 2 THEN latitude END AS latitude,
          CASE WHEN variant = 1 THEN longitude END AS longitude
        FROM (SELECT POI_id AS node, count(*) AS checkin_cnt, arg_min(latitude, (user_id, ts, event_id)) AS latitude,
            arg_min(longitude, (user_id, ts, event_id)) AS longitude FROM ck GROUP BY POI_id),
          (VALUES (0), (1), (2)) AS v(variant)""",
    ),
)
def node_variants(spark, sf_dir):
    """A written node table read with three, one and two of its features."""
    path = scratch_path(spark, "nodes")
    io.write_nodes(flow.flow_nodes(checkins(spark, sf_dir), "POI_id", PLACE_ATTRIBUTES, ORDER), path)
    columns = ["node", "checkin_cnt", "latitude", "longitude"]
    parts = []
    for variant in range(3):
        width = {1: 4, 2: 2}.get(variant, 3)
        read = io.read_node_variant(spark, path, variant, columns[1:])
        if read.columns != columns[1:width]:
            raise ValueError(f"variant {variant} has the columns {read.columns}")
        parts.append(io.read_nodes(spark, path, columns[:width]).withColumn("variant", F.lit(variant)))
    first, second, third = parts
    return first.unionByName(second, True).unionByName(third, True)


@query(
    "adjacency_roundtrip",
    sql(
        graphs.NAME,
        """SELECT s.idx AS src_idx, d.idx AS dst_idx, CAST(weight AS DOUBLE) AS weight FROM ed_name
        JOIN (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM no_name) s ON s.node = src
        JOIN (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM no_name) d ON d.node = dst""",
    ),
)
def adjacency_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "adjacency")
    key = "POI_catname"
    io.write_adjacency(graphs.edges(spark, sf_dir, key), graphs.nodes(spark, sf_dir, key), path)
    return io.read_adjacency(spark, path)


@query("graph_roundtrip", sql(graphs.POI, "SELECT src, dst, weight, checkin_cnt FROM ed_poi JOIN no_poi ON node = src"))
def graph_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "graph")
    io.write_graph(graphs.nodes(spark, sf_dir), graphs.edges(spark, sf_dir), path)
    nodes, edges = io.read_graph(spark, path)
    return edges.join(nodes.withColumnRenamed("node", "src"), "src")


@query(
    "edge_list_roundtrip",
    sql(
        graphs.POI + " ix_poi",
        """SELECT s.node AS src, d.idx AS dst_idx, CAST(weight AS DOUBLE) AS weight
        FROM ed_poi JOIN ix_poi s ON s.node = src JOIN ix_poi d ON d.node = dst""",
    ),
)
def edge_list_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "edge-list")
    io.write_edge_list(graphs.edges(spark, sf_dir), graphs.nodes(spark, sf_dir), path)
    index, edges = io.read_edge_list(spark, path)
    named = index.select(F.col("node").alias("src"), F.col("idx").alias("src_idx"))
    return edges.join(named, "src_idx").select("src", "dst_idx", "weight")


@query("corpus_json_roundtrip", sql("ck tr va alw cva cpv", FLAT_SQL.format(table="cpv")))
def corpus_json_roundtrip(spark, sf_dir):
    """Metadata, samples and their flattened rows through files."""
    where = scratch_path(spark, "corpus")
    io.write_metadata(corpus.corpus_metadata(training(spark, sf_dir)), f"{where}/metadata")
    lists = corpus.metadata_allow_lists(io.read_metadata(spark, f"{where}/metadata"))
    allowed = lists.filter(~F.col("value").isin("name_3", "type_2"))
    points = corpus.corpus_points(validation(spark, sf_dir), allowed, ORDER)
    io.write_samples(corpus.corpus_samples(points), f"{where}/samples")
    return _flat(io.read_samples(spark, f"{where}/samples"))


@query("training_lines_roundtrip", sql("ck cpa cpt prm", "SELECT prompt, completion FROM prm"))
def training_lines_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "lines")
    io.write_training_lines(prompts(spark, sf_dir), path)
    return io.read_training_lines(spark, path)


@query(
    "metric_records_roundtrip",
    sql("log btc epo", "SELECT epoch, split, round(top1, 8) AS top1, round(poi_loss, 8) AS poi_loss FROM epo"),
)
def metric_records_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "records")
    rounded = [F.round(c, 8).alias(c) for c in ("top1", "poi_loss")]
    io.write_records(epoch_log(spark, sf_dir).select("epoch", "split", *rounded), path)
    return spark.read.schema("epoch int, split string, top1 double, poi_loss double").json(path)
