"""Queries over features, sequences, batches and candidates."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trajflow.operators import features, flow, sequences
from trajflow.plans.registry import cte, query, sql
from trajflow.plans.testdata import ORDER, checkins, training, validation
from trajflow.session import cut_lineage, kept

PLACE_COLUMNS = ["POI_catid_code", "latitude", "longitude"]


@query(
    "time_features",
    sql(
        "ck",
        """SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS weekday,
          CASE WHEN hour(ts) < 6 THEN '0-5' WHEN hour(ts) < 12 THEN '6-11'
               WHEN hour(ts) < 18 THEN '12-17' ELSE '18-23' END AS time_period
        FROM ck WHERE event_id % 50 <> 0""",
    ),
)
def time_features(spark, sf_dir):
    """Every fiftieth time is made unreadable and must drop out."""
    broken = F.when(F.col("event_id") % 50 == 0, F.lit("no time")).otherwise(F.col("local_time"))
    rows = features.time_features(checkins(spark, sf_dir).withColumn("local_time", broken))
    return rows.select(
        "event_id", F.col("hour").cast("long"), F.col("weekday").cast("long").alias("weekday"), "time_period"
    )


cte("voc", "SELECT POI_id AS value, row_number() OVER (ORDER BY POI_id) - 1 AS idx FROM (SELECT DISTINCT POI_id FROM tr)")


cte("wvoc", "SELECT POI_id AS value, row_number() OVER (ORDER BY POI_id) - 1 AS idx FROM (SELECT DISTINCT POI_id FROM ck)")


def vocabulary(spark, sf_dir):
    """The places of the training split, so that validation has unseen ones."""
    return features.build_vocab(training(spark, sf_dir), "POI_id")


@query("vocab_poi", sql("ck wvoc", "SELECT * FROM wvoc"))
def vocab_poi(spark, sf_dir):
    return features.build_vocab(checkins(spark, sf_dir), "POI_id")


@query(
    "poi_category_map",
    sql(
        "ck",
        """SELECT POI_id, arg_max(POI_catname, (ts, event_id)) AS POI_catname,
          arg_max(POI_category, (ts, event_id)) AS POI_category FROM ck GROUP BY POI_id""",
    ),
)
def poi_category_map(spark, sf_dir):
    return features.poi_categories(checkins(spark, sf_dir), ORDER)


cte(
    "place",
    """SELECT POI_id AS node, count(*) AS checkin_cnt,
      arg_min(POI_catid_code, (user_id, ts, event_id)) AS code,
      arg_min(latitude, (user_id, ts, event_id)) AS latitude,
      arg_min(longitude, (user_id, ts, event_id)) AS longitude FROM ck GROUP BY POI_id""",
)
cte("codes", "SELECT code, row_number() OVER (ORDER BY code) - 1 AS idx FROM (SELECT DISTINCT code FROM place)")


def places(spark, sf_dir):
    return flow.flow_nodes(checkins(spark, sf_dir), "POI_id", PLACE_COLUMNS, ORDER)


FEATURES_SQL = sql(
    "ck place codes",
    """SELECT node, CAST(0 AS BIGINT) AS feature, CAST(checkin_cnt AS DOUBLE) AS value FROM place
    UNION ALL SELECT node, 1 + idx, CAST(1 AS DOUBLE) FROM place JOIN codes USING (code)
    UNION ALL SELECT node, 1 + (SELECT count(*) FROM codes), latitude FROM place
    UNION ALL SELECT node, 2 + (SELECT count(*) FROM codes), longitude FROM place""",
)


@query("node_features", FEATURES_SQL)
def node_features(spark, sf_dir):
    return features.node_features(places(spark, sf_dir))


@query("node_vectors", FEATURES_SQL)
def node_vectors(spark, sf_dir):
    """The stored cells of the ML vectors, numbered like :func:`node_features`."""
    rows = features.node_vectors(places(spark, sf_dir))
    cells = rows.select("node", F.posexplode(vector_to_array("features")).alias("feature", "value"))
    return cells.filter(F.col("value") != 0).withColumn("feature", F.col("feature").cast("long"))


@query(
    "zscore_nodes",
    sql(
        "ck place",
        """SELECT node,
          round((checkin_cnt - avg(checkin_cnt) OVER ()) / nullif(stddev_pop(checkin_cnt) OVER (), 0), 6) AS checkin_cnt,
          round((latitude - avg(latitude) OVER ()) / nullif(stddev_pop(latitude) OVER (), 0), 6) AS latitude,
          round((longitude - avg(longitude) OVER ()) / nullif(stddev_pop(longitude) OVER (), 0), 6) AS longitude
        FROM place""",
    ),
)
def zscore_nodes(spark, sf_dir):
    columns = ["checkin_cnt", "latitude", "longitude"]
    scaled, _, _ = features.zscore(places(spark, sf_dir), columns)
    return scaled.select("node", *[F.round(c, 6).alias(c) for c in columns])


@query(
    "location_clusters",
    sql(
        "ck",
        """SELECT 'rows' AS fact, count(*) AS value FROM ck
        UNION ALL SELECT 'rows with a cluster', count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) FROM ck
        UNION ALL SELECT 'places', count(DISTINCT (latitude, longitude)) FROM ck
        UNION ALL SELECT 'places in several clusters', 0
        UNION ALL SELECT 'places not at their nearest centre', 0
        UNION ALL SELECT 'centres off their mean', 0""",
    ),
)
def location_clusters(spark, sf_dir):
    """What must hold of any k-means result, whichever optimum it finds."""
    rows = checkins(spark, sf_dir)
    centres = cut_lineage(features.cluster_centres(rows, k=12, iterations=200))
    found = features.assign_clusters(rows, centres)
    place = found.groupBy("latitude", "longitude").agg(
        F.count("*").alias("n"), F.count("location_cluster").alias("placed"),
        F.min("location_cluster").alias("c"), F.count_distinct("location_cluster").alias("kinds"),
    )
    named = centres.select(F.col("location_cluster").alias("i"), F.col("latitude").alias("y"), F.col("longitude").alias("x"))
    away = F.pow(F.col("y") - F.col("latitude"), 2) + F.pow(F.col("x") - F.col("longitude"), 2)
    # A row per place and centre: places x 12.
    far = named.agg(F.collect_list(F.struct("i", "y", "x")).alias("all")).withColumn("one", F.lit(1))
    spread = place.withColumn("one", F.lit(1)).join(far, "one").select("*", F.inline("all")).withColumn("d", away)
    nearest = spread.groupBy("latitude", "longitude", "c", "n").agg(
        F.min("d").alias("least"), F.min(F.when(F.col("i") == F.col("c"), F.col("d"))).alias("own")
    )
    means = place.groupBy("c").agg(
        (F.sum(F.col("n") * F.col("latitude")) / F.sum("n")).alias("my"),
        (F.sum(F.col("n") * F.col("longitude")) / F.sum("n")).alias("mx"),
    ).join(named, F.col("c") == F.col("i"))
    off = F.greatest(F.abs(F.col("my") - F.col("y")), F.abs(F.col("mx") - F.col("x")))
    facts = place.agg(
        F.sum("n").alias("rows"), F.sum("placed").alias("rows with a cluster"), F.count("*").alias("places"),
        F.count_if(F.col("kinds") > 1).alias("places in several clusters"),
    )
    wrong = nearest.agg(F.count_if(F.col("own") > F.col("least")).alias("places not at their nearest centre"))
    moved = means.agg(F.count_if(off > 1e-3).alias("centres off their mean"))

    def listed(df):
        return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("fact"), F.col(c).alias("value")) for c in df.columns])))

    return listed(facts).unionByName(listed(wrong)).unionByName(listed(moved))


SEQUENCE_COLUMNS = """trajectory_id, CAST(step AS INTEGER) AS step, CAST(n - 1 AS INTEGER) AS length,
  poi AS in_poi, t AS in_time, lat AS in_lat, lon AS in_lon, week AS in_week,
  next_poi AS label_poi, next_t AS label_time, next_lat AS label_lat, next_lon AS label_lon, week AS label_week"""


def _pairs_sql(source: str) -> str:
    return f"""SELECT trajectory_id, row_number() OVER w - 1 AS step, count(*) OVER (PARTITION BY trajectory_id) AS n,
      idx AS poi, norm_in_day_time AS t, latitude AS lat, longitude AS lon, day_of_week AS week,
      lead(idx) OVER w AS next_poi, lead(norm_in_day_time) OVER w AS next_t,
      lead(latitude) OVER w AS next_lat, lead(longitude) OVER w AS next_lon
    FROM {source} WINDOW w AS (PARTITION BY trajectory_id ORDER BY ts, event_id)"""


LONG_ENOUGH = "WHERE n - 1 >= 4 AND step < n - 1"
cte("trv", "SELECT tr.*, idx FROM tr JOIN voc ON value = POI_id")
cte("wv", "SELECT ck.*, idx FROM ck JOIN wvoc ON value = POI_id")
cte("wp", _pairs_sql("wv"))
cte("trs", f"SELECT {SEQUENCE_COLUMNS} FROM wp {LONG_ENOUGH}")
cte("usr", "SELECT DISTINCT user_id FROM tr")
cte(
    "vav",
    """SELECT va.*, idx FROM va LEFT JOIN voc ON value = POI_id
    WHERE split_part(trajectory_id, '_', 1) IN (SELECT user_id FROM usr)""",
)
cte("vak", "SELECT * FROM vav WHERE idx IS NOT NULL")
cte("vap", _pairs_sql("vak"))
cte("vas_aligned", f"SELECT {SEQUENCE_COLUMNS} FROM vap {LONG_ENOUGH}")
cte("vaf", _pairs_sql("vav"))
cte(
    "vax",
    """SELECT f.* EXCLUDE (poi, next_poi, n), p.poi, p.next_poi, p.n FROM vap p
    JOIN vaf f ON f.trajectory_id = p.trajectory_id AND f.step = p.step""",
)
cte("vas", f"SELECT {SEQUENCE_COLUMNS} FROM vax {LONG_ENOUGH}")
TRAIN = "ck wvoc wv wp trs"
VAL = "ck tr va voc usr vav vak vap vaf vax vas"


def all_steps(spark, sf_dir):
    """Training sequences of all check-ins."""
    rows = checkins(spark, sf_dir)
    return sequences.train_sequences(rows, features.build_vocab(rows, "POI_id"), order=ORDER)


def validation_steps(spark, sf_dir, align=False):
    seen = training(spark, sf_dir).select("user_id").distinct()
    return sequences.val_sequences(
        validation(spark, sf_dir), vocabulary(spark, sf_dir), seen, order=ORDER, align=align
    )


@query("train_sequences", sql(TRAIN, "SELECT * FROM trs"))
def train_sequences(spark, sf_dir):
    return all_steps(spark, sf_dir)


cte("vnm", "SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT POI_catname AS v FROM ck)")
cte("vty", "SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT POI_category AS v FROM ck)")
cte(
    "cix",
    """SELECT wvoc.idx AS poi, vnm.i AS cat, vty.i AS category FROM (
      SELECT POI_id, arg_max(POI_catname, (ts, event_id)) AS n, arg_max(POI_category, (ts, event_id)) AS t
      FROM ck GROUP BY POI_id) JOIN wvoc ON value = POI_id JOIN vnm ON vnm.v = n JOIN vty ON vty.v = t""",
)


@query(
    "step_categories",
    sql(
        TRAIN + " vnm vty cix",
        """SELECT trajectory_id, step, a.cat AS in_cat, a.category AS in_category,
          b.cat AS label_cat, b.category AS label_category
        FROM trs JOIN cix a ON a.poi = in_poi JOIN cix b ON b.poi = label_poi""",
    ),
)
def step_categories(spark, sf_dir):
    rows = checkins(spark, sf_dir)
    vocabularies = [features.build_vocab(rows, c) for c in ("POI_id", "POI_catname", "POI_category")]
    categories = features.category_index(rows, *vocabularies, order=ORDER)
    named = sequences.step_categories(all_steps(spark, sf_dir), categories)
    return named.select("trajectory_id", "step", "in_cat", "in_category", "label_cat", "label_category")


@query("train_sequences_packed", sql(TRAIN, "SELECT trajectory_id, step, in_poi, in_time, label_poi, label_week FROM trs"))
def train_sequences_packed(spark, sf_dir):
    """The array form, flattened again."""
    packed = sequences.pack(all_steps(spark, sf_dir))
    both = F.arrays_zip("input_seq", "label_seq")
    return packed.select("trajectory_id", F.posexplode(both).alias("step", "p")).select(
        "trajectory_id",
        "step",
        F.col("p.input_seq.poi_idx").alias("in_poi"),
        F.col("p.input_seq.time").alias("in_time"),
        F.col("p.label_seq.poi_idx").alias("label_poi"),
        F.col("p.label_seq.week").alias("label_week"),
    )


@query("val_sequences", sql(VAL, "SELECT * FROM vas"))
def val_sequences(spark, sf_dir):
    return validation_steps(spark, sf_dir)


@query("val_sequences_aligned", sql("ck tr va voc usr vav vak vap vas_aligned", "SELECT * FROM vas_aligned"))
def val_sequences_aligned(spark, sf_dir):
    return validation_steps(spark, sf_dir, align=True)


def _relative_sql(column: str, order: str) -> str:
    w = "OVER (PARTITION BY trajectory_id)"
    return (
        f"radians(({column} - arg_min({column}, {order}) {w}) * (CAST(1 AS DOUBLE)"
        f" / (max({column}) {w} - min({column}) {w} + CAST(0.000001 AS DOUBLE))))"
    )


LOCATIONS = ["in_lat", "in_lon", "label_lat", "label_lon"]


@query(
    "relative_location",
    sql(
        TRAIN,
        "SELECT trajectory_id, step, "
        + ", ".join(f"round({_relative_sql(c, 'step')}, 9) AS rel_{c}" for c in LOCATIONS)
        + " FROM trs",
    ),
)
def relative_location(spark, sf_dir):
    placed = sequences.relative_location(all_steps(spark, sf_dir), LOCATIONS)
    return placed.select("trajectory_id", "step", *[F.round(f"rel_{c}", 9).alias(f"rel_{c}") for c in LOCATIONS])


@query(
    "last_context",
    sql(
        TRAIN,
        f"""SELECT trajectory_id, last_time, round(lat, 9) AS last_lat, round(lon, 9) AS last_lon FROM (
          SELECT trajectory_id, step, length, label_time AS last_time, {_relative_sql('label_lat', 'step')} AS lat,
            {_relative_sql('label_lon', 'step')} AS lon FROM trs) WHERE step = length - 1""",
    ),
)
def last_context(spark, sf_dir):
    rows = sequences.last_context(all_steps(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 9) for c in ("last_lat", "last_lon")})


cte(
    "bat",
    """SELECT trajectory_id, length, CAST((row_number() OVER (ORDER BY trajectory_id) - 1) // 20 AS BIGINT) AS batch
    FROM (SELECT DISTINCT trajectory_id, length FROM trs)""",
)


def _padded(column: str, kind: str) -> str:
    return f"coalesce({column}, CAST(-1 AS {kind})) AS {column}"


@query(
    "padded_batches",
    sql(
        TRAIN + " bat",
        f"""SELECT batch, b.trajectory_id, CAST(pos AS INTEGER) AS pos, {_padded('in_poi', 'BIGINT')},
          {_padded('in_time', 'DOUBLE')}, {_padded('label_poi', 'BIGINT')}, {_padded('label_time', 'DOUBLE')}
        FROM (SELECT *, max(length) OVER (PARTITION BY batch) AS longest FROM bat) b,
          unnest(range(0, longest)) AS r(pos)
        LEFT JOIN trs s ON s.trajectory_id = b.trajectory_id AND s.step = pos""",
    ),
)
def padded_batches(spark, sf_dir):
    rows = sequences.padded_batches(all_steps(spark, sf_dir))
    return rows.select("batch", "trajectory_id", "pos", "in_poi", "in_time", "label_poi", "label_time")


cte(
    "tlag",
    """SELECT trajectory_id, idx AS dst, lag(idx) OVER w AS src, lag(trajectory_id) OVER w AS ptr
    FROM trv WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
cte("ted", "SELECT src, dst, count(*) AS weight FROM tlag WHERE src IS NOT NULL AND ptr = trajectory_id GROUP BY src, dst")
cte("shr", "SELECT src, dst AS item, CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY src) AS score FROM ted")
cte("sco", "SELECT trajectory_id AS traj_id, step, item, score FROM vas JOIN shr ON src = in_poi")
cte("lab", "SELECT trajectory_id AS traj_id, step, label_poi AS item FROM vas")
SCORES = VAL + " trv tlag ted shr sco lab"


def training_edges(spark, sf_dir):
    """The training flow map over vocabulary indices."""
    edges = flow.flow_edges(training(spark, sf_dir), order=ORDER)
    index = vocabulary(spark, sf_dir).withColumnRenamed("value", "node")
    return flow.indexed_edges(edges, index).withColumnsRenamed({"src_idx": "src", "dst_idx": "dst"})


def candidates(spark, sf_dir):
    """Scores and labels of all validation steps from the training flow map."""
    # Both are read by the scores and again by what uses them.
    name = uuid.uuid4().hex
    steps = kept(validation_steps(spark, sf_dir), f"steps-{name}")
    edges = kept(training_edges(spark, sf_dir), f"edges-{name}")
    scores = sequences.rank_next(steps, edges)
    labels = steps.select(
        F.col("trajectory_id").alias("traj_id"), "step", F.col("label_poi").alias("item")
    )
    return scores.withColumnRenamed("trajectory_id", "traj_id"), labels


RANKED = "SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, item) AS rk FROM shr"


@query(
    "rank_next",
    sql(
        SCORES,
        f"""SELECT trajectory_id, step, item, round(score, 9) AS score FROM vas
        JOIN ({RANKED}) ON src = in_poi WHERE rk <= 20""",
    ),
)
def rank_next(spark, sf_dir):
    ranked = sequences.rank_next(validation_steps(spark, sf_dir), training_edges(spark, sf_dir), 20)
    return ranked.withColumn("score", F.round("score", 9))


cte("pop", "SELECT idx AS item, count(*) AS c FROM trv GROUP BY idx ORDER BY c DESC, item LIMIT 120")
cte("top60", f"SELECT src, item, score FROM ({RANKED}) WHERE rk <= 60")
cte(
    "fil",
    """SELECT s AS src, item, -CAST(row_number() OVER (PARTITION BY s ORDER BY c DESC, item) AS DOUBLE) AS score
    FROM (SELECT DISTINCT in_poi AS s FROM vas) CROSS JOIN pop
    WHERE NOT EXISTS (SELECT 1 FROM top60 t WHERE t.src = s AND t.item = pop.item)""",
)


@query(
    "rank_next_filled",
    sql(
        SCORES + " pop top60 fil",
        """SELECT trajectory_id, step, item, round(score, 9) AS score FROM vas JOIN (
          SELECT * FROM top60 UNION ALL
          SELECT f.* FROM fil f LEFT JOIN (SELECT src, count(*) AS n FROM top60 GROUP BY src) t ON t.src = f.src
          WHERE -f.score <= 60 - coalesce(n, 0)) ON src = in_poi""",
    ),
)
def rank_next_filled(spark, sf_dir):
    """Sixty candidates per step, popular places filling short lists."""
    popular = flow.flow_nodes(training(spark, sf_dir), order=ORDER)
    index = vocabulary(spark, sf_dir).withColumnRenamed("value", "node")
    popular = popular.join(index, "node").select(F.col("idx").alias("node"), "checkin_cnt")
    ranked = sequences.rank_next(
        validation_steps(spark, sf_dir), training_edges(spark, sf_dir), 60, popular=popular
    )
    return ranked.withColumn("score", F.round("score", 9))


cte("pal", "SELECT idx AS item, count(*) AS c FROM trv GROUP BY idx")


@query(
    "rank_next_all",
    sql(
        SCORES + " pal",
        """SELECT trajectory_id, step, item, round(score, 9) AS score FROM (
          SELECT trajectory_id, step, item, score FROM vas JOIN shr ON src = in_poi
          UNION ALL
          SELECT trajectory_id, step, item, -CAST(r AS DOUBLE) FROM vas JOIN (
            SELECT s, item, row_number() OVER (PARTITION BY s ORDER BY c DESC, item) AS r
            FROM (SELECT DISTINCT in_poi AS s FROM vas) CROSS JOIN pal
            WHERE NOT EXISTS (SELECT 1 FROM shr WHERE src = s AND shr.item = pal.item)) ON s = in_poi)""",
    ),
)
def rank_next_all(spark, sf_dir):
    """Every known place as a candidate of every step; busy places are salted."""
    index = vocabulary(spark, sf_dir).withColumnRenamed("value", "node")
    popular = flow.flow_nodes(training(spark, sf_dir), order=ORDER).join(index, "node")
    popular = popular.select(F.col("idx").alias("node"), "checkin_cnt")
    ranked = sequences.rank_next(
        validation_steps(spark, sf_dir), training_edges(spark, sf_dir), popular=popular, hot_rows=20
    )
    return ranked.withColumn("score", F.round("score", 9))


def _persistence(batches):
    """A stand-in scorer: the visited place again, surer the smaller the time step."""
    for pdf in batches:
        gap = (pdf["label_time"] - pdf["in_time"]).abs()
        yield pdf[["trajectory_id", "step"]].assign(item=pdf["in_poi"], score=(1 / (1 + gap)).round(6))


@query(
    "score_sequences",
    sql(
        VAL,
        """SELECT trajectory_id, step, in_poi AS item,
          round(1 / (1 + abs(label_time - in_time)), 6) AS score FROM vas""",
    ),
)
def score_sequences(spark, sf_dir):
    schema = "trajectory_id string, step int, item long, score double"
    return sequences.score_sequences(validation_steps(spark, sf_dir), _persistence, schema)


@query("train_sequences_hot", sql(TRAIN, "SELECT * FROM trs"))
def train_sequences_hot(spark, sf_dir):
    """The same sequences with every trajectory of over 18 rows cut into ranges."""
    rows = checkins(spark, sf_dir)
    return sequences.train_sequences(rows, features.build_vocab(rows, "POI_id"), order=ORDER, hot_rows=18)


@query(
    "relative_location_hot",
    sql(
        TRAIN,
        "SELECT trajectory_id, step, "
        + ", ".join(f"round({_relative_sql(c, 'step')}, 9) AS rel_{c}" for c in LOCATIONS)
        + " FROM trs",
    ),
)
def relative_location_hot(spark, sf_dir):
    placed = sequences.relative_location(all_steps(spark, sf_dir), LOCATIONS, hot_rows=18)
    return placed.select("trajectory_id", "step", *[F.round(f"rel_{c}", 9).alias(f"rel_{c}") for c in LOCATIONS])
