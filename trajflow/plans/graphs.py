"""Queries over flow maps and graph matrices."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trajflow.operators import algebra, flow
from trajflow.plans.registry import cte, query, sql
from trajflow.plans.testdata import LINE_ORDER, ORDER, checkins, purchases
from trajflow.session import cut_lineage, kept
from trajflow.sources.schema import PLACE_ATTRIBUTES

ATTRIBUTES = ", ".join(f"arg_min({c}, (user_id, ts, event_id)) AS {c}" for c in PLACE_ATTRIBUTES)

for short, key in {"poi": "POI_id", "type": "POI_category", "name": "POI_catname"}.items():
    cte(
        f"lag_{short}",
        f"""SELECT user_id, {key} AS dst, trajectory_id, latitude, longitude,
             lag({key}) OVER w AS src, lag(trajectory_id) OVER w AS ptr,
             lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon
        FROM ck WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    )
    cte(f"st_{short}", f"SELECT * FROM lag_{short} WHERE src IS NOT NULL AND ptr = trajectory_id")
    cte(f"ed_{short}", f"SELECT src, dst, count(*) AS weight FROM st_{short} GROUP BY src, dst")
    cte(f"no_{short}", f"SELECT {key} AS node, count(*) AS checkin_cnt FROM ck GROUP BY {key}")

POI = "ck lag_poi st_poi ed_poi no_poi"
TYPE = "ck lag_type st_type ed_type no_type"
NAME = "ck lag_name st_name ed_name no_name"


def nodes(spark, sf_dir, key="POI_id"):
    return flow.flow_nodes(checkins(spark, sf_dir), key, order=ORDER)


def edges(spark, sf_dir, key="POI_id"):
    return flow.flow_edges(checkins(spark, sf_dir), key, order=ORDER)


@query(
    "flow_nodes_poi",
    sql("ck", f"SELECT POI_id AS node, count(*) AS checkin_cnt, {ATTRIBUTES} FROM ck GROUP BY POI_id"),
)
def flow_nodes_poi(spark, sf_dir):
    return flow.flow_nodes(checkins(spark, sf_dir), "POI_id", PLACE_ATTRIBUTES, ORDER)


@query("flow_edges_poi", sql(POI, "SELECT * FROM ed_poi"))
def flow_edges_poi(spark, sf_dir):
    return edges(spark, sf_dir)


@query("flow_edges_poi_hot", sql(POI, "SELECT * FROM ed_poi"))
def flow_edges_poi_hot(spark, sf_dir):
    """The same edges with every user of over 60 rows cut into ranges."""
    return flow.flow_edges(checkins(spark, sf_dir), order=ORDER, hot_rows=60)


def _geo_sql(a0: str, a1: str, b0: str, b1: str) -> str:
    return sql(
        POI,
        f"""SELECT src, dst, round(sum(CASE WHEN km < 1 THEN 1 ELSE CAST(0.76 AS DOUBLE) / tanh(km) END), 6)
              AS geo_weight
        FROM (SELECT src, dst, CAST(12742.786 AS DOUBLE) * asin(sqrt(least(CAST(1 AS DOUBLE),
                pow(sin(radians(({a1} - {a0}) / 2)), 2)
                + cos(radians({a0})) * cos(radians({a1})) * pow(sin(radians(({b1} - {b0}) / 2)), 2)))) AS km
              FROM st_poi) GROUP BY src, dst""",
    )


def _geo(spark, sf_dir, formula):
    out = flow.flow_edges(checkins(spark, sf_dir), weight="geo", order=ORDER, formula=formula)
    return out.withColumn("geo_weight", F.round("geo_weight", 6))


GEO = _geo_sql("plon", "longitude", "plat", "latitude")
cte("geo_poi", GEO)


@query("flow_edges_geo", GEO)
def flow_edges_geo(spark, sf_dir):
    return _geo(spark, sf_dir, "reference")


@query("flow_edges_geo_haversine", _geo_sql("plat", "latitude", "plon", "longitude"))
def flow_edges_geo_haversine(spark, sf_dir):
    return _geo(spark, sf_dir, "haversine")


@query("flow_nodes_type", sql(TYPE, "SELECT * FROM no_type"))
def flow_nodes_type(spark, sf_dir):
    return nodes(spark, sf_dir, "POI_category")


@query("flow_edges_type", sql(TYPE, "SELECT * FROM ed_type"))
def flow_edges_type(spark, sf_dir):
    return edges(spark, sf_dir, "POI_category")


@query(
    "flow_nodes_name",
    sql(
        "ck",
        """SELECT POI_catname AS node, count(*) AS checkin_cnt,
             arg_min(POI_category, (user_id, ts, event_id)) AS POI_category FROM ck GROUP BY POI_catname""",
    ),
)
def flow_nodes_name(spark, sf_dir):
    return flow.flow_nodes(checkins(spark, sf_dir), "POI_catname", ["POI_category"], ORDER)


@query("flow_edges_name", sql(NAME, "SELECT * FROM ed_name"))
def flow_edges_name(spark, sf_dir):
    return edges(spark, sf_dir, "POI_catname")


@query(
    "flow_edges_excluding_user",
    sql("ck lag_poi st_poi", "SELECT src, dst, count(*) AS weight FROM st_poi WHERE user_id <> '3' GROUP BY src, dst"),
)
def flow_edges_excluding_user(spark, sf_dir):
    return flow.flow_edges(checkins(spark, sf_dir), order=ORDER, exclude_user="3")


@query(
    "flow_edges_purchases",
    sql(
        "pur",
        """SELECT src, dst, count(*) AS weight FROM (
          SELECT POI_id AS dst, trajectory_id, lag(POI_id) OVER w AS src, lag(trajectory_id) OVER w AS ptr FROM pur
          WINDOW w AS (PARTITION BY user_id ORDER BY o_orderdate, o_orderkey, l_linenumber, l_suppkey, l_quantity,
            l_extendedprice, l_shipdate, l_partkey))
        WHERE src IS NOT NULL AND ptr = trajectory_id GROUP BY src, dst""",
    ),
)
def flow_edges_purchases(spark, sf_dir):
    """Part-to-part flow map of the customers' orders, the largest table at hand."""
    return flow.flow_edges(purchases(spark, sf_dir), order=(*LINE_ORDER, "l_partkey"))


cte("ix_poi", "SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM no_poi")
cte("ix_type", "SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM no_type")


@query(
    "flow_edge_list",
    sql(
        POI + " ix_poi",
        """SELECT s.idx AS src_idx, d.idx AS dst_idx, weight
        FROM ed_poi JOIN ix_poi s ON s.node = src JOIN ix_poi d ON d.node = dst""",
    ),
)
def flow_edge_list(spark, sf_dir):
    return flow.indexed_edges(edges(spark, sf_dir), flow.node_index(nodes(spark, sf_dir)))


cte(
    "deg_poi",
    """SELECT node, CAST(count(e.n) AS BIGINT) AS degree FROM no_poi
    LEFT JOIN (SELECT src AS n FROM ed_poi UNION ALL SELECT dst FROM ed_poi) e ON e.n = node GROUP BY node""",
)


def _spread_sql(column: str, table: str) -> str:
    parts = [f"SELECT 'mean' AS stat, avg(CAST({column} AS DOUBLE)) AS value FROM {table}"]
    for p in flow.PERCENTILES:
        parts.append(
            f"SELECT 'p{p}', quantile_cont(CAST({column} AS DOUBLE), CAST({p / 100} AS DOUBLE)) FROM {table}"
        )
    return "SELECT stat, round(value, 6) AS value FROM (" + " UNION ALL ".join(parts) + ")"


@query("graph_stats_degree", sql(POI + " deg_poi", _spread_sql("degree", "deg_poi")))
def graph_stats_degree(spark, sf_dir):
    out = flow.spread(flow.degrees(nodes(spark, sf_dir), edges(spark, sf_dir)), "degree")
    return out.withColumn("value", F.round("value", 6))


@query("graph_stats_weight", sql(POI, _spread_sql("weight", "ed_poi")))
def graph_stats_weight(spark, sf_dir):
    return flow.spread(edges(spark, sf_dir), "weight").withColumn("value", F.round("value", 6))


@query(
    "graph_stats",
    sql(
        POI + " deg_poi",
        f"""SELECT 'degree' AS measure, 'count' AS stat, CAST(count(*) AS DOUBLE) AS value FROM no_poi
        UNION ALL SELECT 'weight', 'count', CAST(count(*) AS DOUBLE) FROM ed_poi
        UNION ALL SELECT 'degree', * FROM ({_spread_sql("degree", "deg_poi")})
        UNION ALL SELECT 'weight', * FROM ({_spread_sql("weight", "ed_poi")})""",
    ),
)
def graph_stats(spark, sf_dir):
    out = flow.graph_stats(nodes(spark, sf_dir), edges(spark, sf_dir))
    return out.withColumn("value", F.round("value", 6))


@query(
    "dense_rows",
    sql(
        TYPE + " ix_type",
        """SELECT s.idx, s.node, d.idx AS col, CAST(coalesce(weight, 0) AS DOUBLE) AS weight
        FROM ix_type s CROSS JOIN ix_type d LEFT JOIN ed_type ON src = s.node AND dst = d.node""",
    ),
)
def dense_rows(spark, sf_dir):
    rows = flow.dense_rows(edges(spark, sf_dir, "POI_category"), nodes(spark, sf_dir, "POI_category"))
    out = rows.select("idx", "node", F.posexplode("row").alias("col", "weight"))
    return out.withColumn("col", F.col("col").cast("long"))


cte(
    "rs_poi",
    """SELECT node, CAST(coalesce(sum(weight), 0) AS DOUBLE) AS deg
    FROM no_poi LEFT JOIN ed_poi ON src = node GROUP BY node""",
)
cte(
    "hat_poi",
    """SELECT src, dst, sum(w) / (any_value(deg) + 1) AS value FROM (
      SELECT src, dst, CAST(weight AS DOUBLE) AS w FROM ed_poi UNION ALL SELECT node, node, 1 FROM no_poi)
    JOIN rs_poi ON node = src GROUP BY src, dst""",
)


def _laplacian(spark, sf_dir, kind):
    out = algebra.laplacian(edges(spark, sf_dir), nodes(spark, sf_dir), kind)
    return out.withColumn("value", F.round("value", 9))


@query("row_sums", sql(POI + " rs_poi", "SELECT * FROM rs_poi"))
def row_sums(spark, sf_dir):
    return algebra.row_sums(edges(spark, sf_dir), nodes(spark, sf_dir))


@query(
    "laplacian_com",
    sql(
        POI + " rs_poi",
        """SELECT src, dst, round(sum(w), 9) AS value FROM (
          SELECT src, dst, -CAST(weight AS DOUBLE) AS w FROM ed_poi
          UNION ALL SELECT node, node, deg FROM rs_poi) GROUP BY src, dst""",
    ),
)
def laplacian_com(spark, sf_dir):
    return _laplacian(spark, sf_dir, "com_lap_mat")


@query(
    "laplacian_hat",
    sql(POI + " rs_poi hat_poi", "SELECT src, dst, round(value, 9) AS value FROM hat_poi"),
)
def laplacian_hat(spark, sf_dir):
    return _laplacian(spark, sf_dir, "hat_rw_normd_lap_mat")


@query(
    "laplacian_wid",
    sql(
        POI + " rs_poi",
        """SELECT src, dst, round(sum(w), 9) AS value FROM (
          SELECT src, dst, -2 * CAST(weight AS DOUBLE) / deg AS w FROM ed_poi JOIN rs_poi ON node = src
          UNION ALL SELECT node, node, 1 FROM no_poi) GROUP BY src, dst""",
    ),
)
def laplacian_wid(spark, sf_dir):
    return _laplacian(spark, sf_dir, "wid_rw_normd_lap_mat")


cte(
    "vec_poi",
    """SELECT POI_id AS node, CAST(count(*) AS DOUBLE) / 100 AS x0,
      arg_min(latitude, (user_id, ts, event_id)) - 40 AS x1,
      arg_min(longitude, (user_id, ts, event_id)) + 74 AS x2 FROM ck GROUP BY POI_id""",
)


def _vectors(spark, sf_dir):
    """Three numbers per place: scaled count and shifted coordinates."""
    placed = flow.flow_nodes(checkins(spark, sf_dir), "POI_id", ["latitude", "longitude"], ORDER)
    return placed.select(
        "node",
        F.array(F.col("checkin_cnt") / 100, F.col("latitude") - 40, F.col("longitude") + 74).alias("vector"),
    )


def _long(vectors, digits=8):
    out = vectors.select("node", F.posexplode("vector").alias("dim", "value"))
    return out.withColumn("value", F.round("value", digits))


@query(
    "propagate",
    sql(
        POI + " rs_poi hat_poi vec_poi",
        """SELECT src AS node, CAST(dim AS INTEGER) AS dim, round(sum(value * x), 8) AS value FROM hat_poi
        JOIN (SELECT node, 0 AS dim, x0 AS x FROM vec_poi UNION ALL SELECT node, 1, x1 FROM vec_poi
              UNION ALL SELECT node, 2, x2 FROM vec_poi) v ON v.node = dst GROUP BY src, dim""",
    ),
)
def propagate(spark, sf_dir):
    hat = algebra.laplacian(edges(spark, sf_dir), nodes(spark, sf_dir), "hat_rw_normd_lap_mat")
    return _long(algebra.propagate(hat, _vectors(spark, sf_dir), 3))


# Fixed small weights.
LAYERS = [
    ([[0.5, -1.0], [0.25, 0.75], [-2.0, 0.5]], [0.1, -0.2]),
    ([[1.0, 0.5], [-0.5, 2.0]], [0.05, 0.0]),
]
ATTENTION_WEIGHTS = [[0.5, -1.0], [0.25, 0.75], [-2.0, 0.5]]
ATTENTION = [0.3, -0.4, 0.7, 0.2]


def _d(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def _gcn_sql() -> str:
    steps, source, width = [], "vec_poi", 3
    for depth, (weights, bias) in enumerate(LAYERS):
        sums = []
        for j, b in enumerate(bias):
            inner = " + ".join(f"v.x{i} * {_d(weights[i][j])}" for i in range(width))
            total = f"sum(value * ({inner})) + {_d(b)}"
            sums.append(f"{total} AS x{j}")
        table = f"SELECT src AS node, {', '.join(sums)} FROM hat_poi JOIN {source} v ON v.node = dst GROUP BY src"
        width = len(bias)
        if depth < len(LAYERS) - 1:
            kinked = ", ".join(
                f"CASE WHEN x{j} > 0 THEN x{j} ELSE x{j} * {_d(0.2)} END AS x{j}" for j in range(width)
            )
            table = f"SELECT node, {kinked} FROM ({table})"
        source = f"layer{depth}"
        cte(source, table)
        steps.append(source)
    rows = " UNION ALL ".join(
        f"SELECT node, CAST({j} AS INTEGER) AS dim, round(x{j}, 8) AS value FROM {source}" for j in range(width)
    )
    return sql(f"{POI} rs_poi hat_poi vec_poi {' '.join(steps)}", rows)


@query("gcn_forward", _gcn_sql())
def gcn_forward(spark, sf_dir):
    hat = algebra.laplacian(edges(spark, sf_dir), nodes(spark, sf_dir), "hat_rw_normd_lap_mat")
    return _long(algebra.gcn_forward(hat, _vectors(spark, sf_dir), LAYERS))


def _attention_sql() -> str:
    halves = []
    for half in (ATTENTION[:2], ATTENTION[2:]):
        terms = []
        for i, row in enumerate(ATTENTION_WEIGHTS):
            terms += [f"x{i} * {_d(w)} * {_d(a)}" for w, a in zip(row, half)]
        halves.append(" + ".join(terms))
    cte("att_poi", f"SELECT node, {halves[0]} AS s, {halves[1]} AS t FROM vec_poi")
    return sql(
        POI + " vec_poi att_poi",
        f"""SELECT src, dst, round((CASE WHEN e > 0 THEN e ELSE e * {_d(0.2)} END) * (weight + 1), 6) AS value
        FROM (SELECT src, dst, weight, a.s + b.t AS e FROM ed_poi
              JOIN att_poi a ON a.node = src JOIN att_poi b ON b.node = dst)""",
    )


@query("edge_attention", _attention_sql())
def edge_attention(spark, sf_dir):
    out = algebra.edge_attention(edges(spark, sf_dir), _vectors(spark, sf_dir), ATTENTION_WEIGHTS, ATTENTION)
    return out.withColumn("value", F.round("value", 6))


def _iterated(edges_sql: str, nodes_sql: str, steps: int) -> str:
    """Ten steps of the shifted walk matrix, from visit counts, as a recursive statement."""
    return f"""SELECT node, round(x / sqrt(sum(x * x) OVER ()), 9) AS x FROM (
      WITH RECURSIVE m AS (
        SELECT src, dst, sum(w) AS value FROM (
          SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) / 2 AS w
          FROM (SELECT src, dst, CAST(weight AS DOUBLE) AS weight FROM {edges_sql})
          UNION ALL SELECT node, node, CAST(0.5 AS DOUBLE) FROM {nodes_sql}) GROUP BY src, dst),
      it AS (SELECT 0 AS step, node, CAST(checkin_cnt AS DOUBLE) AS x FROM {nodes_sql}
        UNION ALL
        SELECT any_value(step) + 1, src, sum(value * x) FROM it JOIN m ON dst = node WHERE step < {steps} GROUP BY src)
      SELECT node, x FROM it WHERE step = {steps})"""


def _walked(nodes_df, edges_df, steps=10):
    # Places that nobody leaves have no row in the walk matrix.
    left = edges_df.select(F.col("src").alias("node")).distinct()
    kept = nodes_df.join(left, "node", "left_semi")
    inner = edges_df.join(kept.select(F.col("node").alias("dst")), "dst")
    cells = algebra.hashed_cells(algebra.walk_matrix(inner, kept, shift=1.0), kept)
    found = algebra.iterate(cells, kept.select("node", F.col("checkin_cnt").alias("x")), steps)
    return found.select("node", F.round("x", 9).alias("x"))


for short in ("poi", "pur"):
    # Nodes that are left, and edges between them.
    cte(f"out_{short}", f"SELECT * FROM no_{short} WHERE node IN (SELECT src FROM ed_{short})")
    cte(f"in_{short}", f"SELECT e.* FROM ed_{short} e JOIN out_{short} ON node = dst")


cte(
    "ed_pur",
    """SELECT src, dst, count(*) AS weight FROM (
      SELECT POI_id AS dst, trajectory_id, lag(POI_id) OVER w AS src, lag(trajectory_id) OVER w AS ptr FROM pur
      WINDOW w AS (PARTITION BY user_id ORDER BY o_orderdate, o_orderkey, l_linenumber, l_suppkey, l_quantity,
        l_extendedprice, l_shipdate, l_partkey))
    WHERE src IS NOT NULL AND ptr = trajectory_id GROUP BY src, dst""",
)
cte("no_pur", "SELECT POI_id AS node, count(*) AS checkin_cnt FROM pur GROUP BY POI_id")
PURCHASE_ORDER = (*LINE_ORDER, "l_partkey")


def purchase_graph(spark, sf_dir):
    """Nodes and edges, each written once, as they are read several times."""
    df = purchases(spark, sf_dir)
    nodes_df, edges_df = flow.flow_nodes(df, "POI_id", order=PURCHASE_ORDER), flow.flow_edges(df, order=PURCHASE_ORDER)
    return cut_lineage(nodes_df), cut_lineage(edges_df)


@query("walk_vector", sql(POI + " out_poi in_poi", _iterated("in_poi", "out_poi", 10)))
def walk_vector(spark, sf_dir):
    """The place graph's walk matrix applied ten times to the visit counts."""
    return _walked(nodes(spark, sf_dir), edges(spark, sf_dir))


@query("walk_vector_purchases", sql("pur ed_pur no_pur out_pur in_pur", _iterated("in_pur", "out_pur", 10)))
def walk_vector_purchases(spark, sf_dir):
    return _walked(*purchase_graph(spark, sf_dir))


# Signed weights whose rows sum to 2: an edge to an even place counts against, the diagonal makes up for it.
cte(
    "sgn",
    """SELECT src, dst, sum(w) AS weight FROM (
      SELECT src, dst, s * CAST(weight AS DOUBLE) / t AS w FROM (
        SELECT src, dst, weight, CASE WHEN CAST(dst AS BIGINT) % 2 = 0 THEN -1 ELSE 1 END AS s,
          sum(weight) OVER (PARTITION BY src) AS t FROM ed_poi)
      UNION ALL SELECT src, src, CAST(2 AS DOUBLE) - sum(CASE WHEN CAST(dst AS BIGINT) % 2 = 0 THEN -1 ELSE 1 END * CAST(weight AS DOUBLE))
        / sum(weight) FROM ed_poi GROUP BY src) GROUP BY src, dst""",
)


def signed_edges(spark, sf_dir):
    """Edges between places, some negative, whose rows sum to 2."""
    df = edges(spark, sf_dir)
    sign = F.when(F.col("dst").cast("long") % 2 == 0, -1.0).otherwise(1.0)
    total = df.groupBy("src").agg(
        F.sum(F.col("weight").cast("double")).alias("_t"), F.sum(sign * F.col("weight")).alias("_s")
    )
    shares = df.join(total, "src").select("src", "dst", (sign * F.col("weight") / F.col("_t")).alias("weight"))
    own = total.select("src", F.col("src").alias("dst"), (2 - F.col("_s") / F.col("_t")).alias("weight"))
    return shares.unionByName(own).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


STEPS = 30
cte("sgi", "SELECT s.* FROM sgn s JOIN out_poi ON node = dst")
cte("sgd", "SELECT src AS node, sum(weight) AS deg FROM sgi GROUP BY src")
cte(
    "sgm",
    """SELECT src, dst, sum(v) AS v FROM (SELECT src, dst, weight / deg / 2 AS v FROM sgi JOIN sgd ON node = src
      UNION ALL SELECT node, node, CAST(0.5 AS DOUBLE) FROM sgd) GROUP BY src, dst""",
)
cte(
    "lam",
    f"""SELECT 2 * sum(a.x * b.x) / sum(a.x * a.x) - 1 AS l FROM (
      WITH RECURSIVE it AS (
        SELECT 0 AS step, node, CAST(checkin_cnt AS DOUBLE) AS x FROM out_poi
        UNION ALL SELECT any_value(step) + 1, src, sum(v * x) FROM it JOIN sgm ON dst = node
        WHERE step <= {STEPS} GROUP BY src)
      SELECT * FROM it WHERE step = {STEPS}) a JOIN (
      WITH RECURSIVE it AS (
        SELECT 0 AS step, node, CAST(checkin_cnt AS DOUBLE) AS x FROM out_poi
        UNION ALL SELECT any_value(step) + 1, src, sum(v * x) FROM it JOIN sgm ON dst = node
        WHERE step <= {STEPS} GROUP BY src)
      SELECT * FROM it WHERE step = {STEPS} + 1) b USING (node)""",
)


def _signed(spark, sf_dir):
    """The signed graph, its nodes, and its vector after thirty steps."""
    signed = signed_edges(spark, sf_dir)
    left = signed.select(F.col("src").alias("node")).distinct()
    kept_nodes = nodes(spark, sf_dir).join(left, "node", "left_semi")
    inner = cut_lineage(signed.join(kept_nodes.select(F.col("node").alias("dst")), "dst"))
    cells = algebra.hashed_cells(algebra.walk_matrix(inner, kept_nodes, shift=1.0), kept_nodes)
    start = kept_nodes.select("node", F.col("checkin_cnt").alias("x"))
    return inner, kept_nodes, algebra.iterate(cells, start, STEPS)


@query("dominant_eigenvalue", sql(POI + " out_poi sgn sgi sgd sgm lam", "SELECT round(l, 6) AS value FROM lam"))
def dominant_eigenvalue(spark, sf_dir):
    """What thirty steps over a graph with negative weights say of its largest eigenvalue."""
    _, _, found = _signed(spark, sf_dir)
    return algebra.eigenpair(found, 1.0).select(F.round("value", 6).alias("value"))


@query(
    "laplacian_wid_signed",
    sql(
        POI + " out_poi sgn sgi sgd sgm lam",
        """SELECT src, dst, round(sum(w), 7) AS value FROM (
          SELECT src, dst, -2 * weight / deg / l AS w FROM sgi JOIN sgd ON node = src, lam
          UNION ALL SELECT node, node, 2 / l - 1 FROM sgd, lam) GROUP BY src, dst""",
    ),
)
def laplacian_wid_signed(spark, sf_dir):
    """The scaled matrix of a graph with negative weights, by the eigenvalue that thirty steps give."""
    inner, kept_nodes, found = _signed(spark, sf_dir)
    value = algebra.eigenpair(found, 1.0).first()["value"]
    out = algebra.laplacian(inner, kept_nodes, "wid_rw_normd_lap_mat", lambda_max=value)
    return out.withColumn("value", F.round("value", 7))


@query(
    "graph_stats_geo",
    sql(
        POI + " deg_poi geo_poi",
        f"""SELECT 'degree' AS measure, 'count' AS stat, CAST(count(*) AS DOUBLE) AS value FROM no_poi
        UNION ALL SELECT 'weight', 'count', CAST(count(*) AS DOUBLE) FROM geo_poi
        UNION ALL SELECT 'degree', * FROM ({_spread_sql("degree", "deg_poi")})
        UNION ALL SELECT 'weight', * FROM ({_spread_sql("geo_weight", "geo_poi")})""",
    ),
)
def graph_stats_geo(spark, sf_dir):
    """Statistics over distance weights, nearly all of which differ."""
    out = flow.graph_stats(nodes(spark, sf_dir), _geo(spark, sf_dir, "reference"), "geo_weight")
    return out.withColumn("value", F.round("value", 6))


WIDE = 160
cte("vec_pur", f"""SELECT POI_id AS node, CAST(i AS INTEGER) AS dim, CAST((l_partkey * (i + 1)) % 97 AS DOUBLE) / 97 AS x
  FROM (SELECT DISTINCT POI_id, l_partkey FROM pur), range({WIDE}) AS t(i)""")
cte("rs_pur", "SELECT node, CAST(coalesce(sum(weight), 0) AS DOUBLE) AS deg FROM no_pur LEFT JOIN ed_pur ON src = node GROUP BY node")
cte(
    "hat_pur",
    """SELECT src, dst, sum(w) / (any_value(deg) + 1) AS value FROM (
      SELECT src, dst, CAST(weight AS DOUBLE) AS w FROM ed_pur UNION ALL SELECT node, node, 1 FROM no_pur)
    JOIN rs_pur ON node = src GROUP BY src, dst""",
)
PURCHASE_MATRIX = "pur ed_pur no_pur rs_pur hat_pur vec_pur"


def _wide_vectors(nodes_df):
    """Vectors of ``WIDE`` numbers that follow from the part's key."""
    key = F.col("node").cast("long")
    values = F.transform(F.sequence(F.lit(1), F.lit(WIDE)), lambda i: ((key * i) % 97).cast("double") / 97)
    return nodes_df.select("node", values.alias("vector"))


@query(
    "propagate_wide",
    sql(
        PURCHASE_MATRIX,
        """SELECT src AS node, dim, round(sum(value * x), 8) AS value FROM hat_pur JOIN vec_pur ON node = dst
        GROUP BY src, dim""",
    ),
)
def propagate_wide(spark, sf_dir):
    """Vectors of 160 numbers over the purchase graph."""
    nodes_df, edges_df = purchase_graph(spark, sf_dir)
    hat = algebra.laplacian(edges_df, nodes_df, "hat_rw_normd_lap_mat")
    return _long(algebra.propagate(hat, _wide_vectors(nodes_df), WIDE, repeated=True))


HIDDEN = 128


def _wide_layer(rows: int, columns: int):
    """Weights and bias by a rule; the statement below follows it too."""
    weights = [[((7 * i + 13 * j) % 11 - 5) / 50 for j in range(columns)] for i in range(rows)]
    return weights, [(j % 5 - 2) / 10 for j in range(columns)]


def _wide_gcn_sql() -> str:
    source, rows, names = "vec_pur", WIDE, []
    for depth, columns in enumerate((HIDDEN, 8)):
        linear = f"""SELECT node, j, sum(x * CAST((7 * dim + 13 * j) % 11 - 5 AS DOUBLE) / 50) AS x
          FROM {source}, range({columns}) AS t(j) GROUP BY node, j"""
        bias = "CAST(j % 5 - 2 AS DOUBLE) / 10"
        moved = f"SELECT src AS node, CAST(j AS INTEGER) AS dim, sum(value * x) + {bias} AS x FROM hat_pur JOIN ({linear}) ON node = dst GROUP BY src, j"
        if depth == 0:
            moved = f"SELECT node, dim, CASE WHEN x > 0 THEN x ELSE x * CAST(0.2 AS DOUBLE) END AS x FROM ({moved})"
        source = cte(f"wide{depth}", moved)
        names.append(source)
    return sql(f"{PURCHASE_MATRIX} {' '.join(names)}", f"SELECT node, dim, round(x, 7) AS value FROM {source}")


@query("gcn_forward_wide", _wide_gcn_sql())
def gcn_forward_wide(spark, sf_dir):
    """Two layers, 160 to 128 to 8, over the purchase graph."""
    nodes_df, edges_df = purchase_graph(spark, sf_dir)
    hat = algebra.laplacian(edges_df, nodes_df, "hat_rw_normd_lap_mat")
    layers = [_wide_layer(WIDE, HIDDEN), _wide_layer(HIDDEN, 8)]
    return _long(algebra.gcn_forward(hat, _wide_vectors(nodes_df), layers, repeated=True), 7)


@query(
    "edges_there_and_back",
    sql(
        POI,
        """SELECT a.src, a.dst, a.weight, coalesce(b.weight, 0) AS back FROM ed_poi a
        LEFT JOIN ed_poi b ON b.src = a.dst AND b.dst = a.src""",
    ),
)
def edges_there_and_back(spark, sf_dir):
    """A flow map written once and read twice."""
    table = kept(edges(spark, sf_dir), f"edges-{uuid.uuid4().hex}")
    turned = table.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("back"))
    return table.join(turned, ["src", "dst"], "left").fillna(0, ["back"])
