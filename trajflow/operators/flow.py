"""Trajectory flow maps: weighted directed graphs of "visited A, then B"."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajflow.functions.expressions import arc_km, distance_reward
from trajflow.operators.ordered import dense_index, hot_keys, ordered, quantiles
from trajflow.session import cut_lineage

ROW_ORDER = ("row_pos",)
PERCENTILES = (0, 20, 40, 60, 80, 100)


def without_user(df: DataFrame, user_id: str | None, column: str = "user_id") -> DataFrame:
    """Drop one user's rows; rows without a user belong to nobody and go as well."""
    df = df.filter(F.col(column).isNotNull())
    return df if user_id is None else df.filter(F.col(column) != F.lit(user_id))


def flow_nodes(
    df: DataFrame,
    key: str = "POI_id",
    attributes: Sequence[str] = (),
    order: Sequence[str] = ROW_ORDER,
    exclude_user: str | None = None,
) -> DataFrame:
    """``node, checkin_cnt`` and the attributes of the node's first check-in.

    First is the smallest ``(user_id, *order)``.
    """
    rows = without_user(df, exclude_user).filter(F.col(key).isNotNull())
    count = F.count("*").alias("checkin_cnt")
    if not attributes:
        return rows.groupBy(F.col(key).alias("node")).agg(count)
    first = F.min_by(F.struct(*attributes), F.struct("user_id", *order)).alias("_first")
    nodes = rows.groupBy(F.col(key).alias("node")).agg(count, first)
    return nodes.select("node", "checkin_cnt", *[F.col("_first")[a].alias(a) for a in attributes])


def transitions(
    df: DataFrame,
    key: str = "POI_id",
    order: Sequence[str] = ROW_ORDER,
    exclude_user: str | None = None,
    formula: str | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """One row ``src, dst`` per step of a user within one trajectory.

    The step starts at the user's previous row, whichever trajectory that row
    belongs to, and counts only if both rows share the trajectory. With a
    distance ``formula`` each row carries its distance reward.
    """
    rows = without_user(df, exclude_user)
    places = ["latitude", "longitude"] if formula else []
    columns = ["user_id", key, "trajectory_id", *places, *order]
    rows = rows.select(*dict.fromkeys(columns))
    before = {"_src": key, "_trajectory": "trajectory_id"}
    if formula:
        before |= {"_lat": "latitude", "_lon": "longitude"}
    hot = hot_keys(rows, ["user_id"], hot_rows)
    steps = ordered(rows, ["user_id"], order, previous=before, hot=hot).filter(
        (F.col("_trajectory") == F.col("trajectory_id"))
        & F.col("_src").isNotNull()
        & F.col(key).isNotNull()
    )
    ends = [F.col("_src").alias("src"), F.col(key).alias("dst")]
    if not formula:
        return steps.select(*ends)
    km = arc_km(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude"), formula)
    return steps.select(*ends, distance_reward(km).alias("reward"))


def flow_edges(
    df: DataFrame,
    key: str = "POI_id",
    weight: str = "count",
    order: Sequence[str] = ROW_ORDER,
    exclude_user: str | None = None,
    formula: str = "reference",
    hot_rows: int | None = None,
) -> DataFrame:
    """``src, dst`` with ``weight`` (steps), ``geo_weight`` (rewards) or ``both``.

    One missing coordinate makes the whole ``geo_weight`` of its edge null.
    """
    if weight not in ("count", "geo", "both"):
        raise ValueError(f"unknown edge weight: {weight}")
    steps = transitions(
        df, key, order, exclude_user, None if weight == "count" else formula, hot_rows
    )
    measures = []
    if weight != "geo":
        measures.append(F.count("*").alias("weight"))
    if weight != "count":
        complete = F.count("*") == F.count("reward")
        measures.append(F.when(complete, F.sum("reward")).alias("geo_weight"))
    return steps.groupBy("src", "dst").agg(*measures)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, degree``: edges in plus edges out, a self-loop counting twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    counted = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.select("node").join(counted, "node", "left").fillna(0, ["degree"])


def _stat_rows(total: Column | None = None) -> Column:
    rows = [F.struct(F.lit("mean").alias("stat"), F.col("mean").alias("value"))]
    rows += [F.struct(F.lit(f"p{p}").alias("stat"), F.col(f"p{p}").alias("value")) for p in PERCENTILES]
    if total is not None:
        rows.append(F.struct(F.lit("count").alias("stat"), total.alias("value")))
    return F.inline(F.array(*rows))


def _summaries(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, total and percentiles of values ``v`` that occur ``n`` times, per key."""
    known = F.when(F.col("v").isNotNull(), F.col("n"))
    means = counted.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("v") * F.col("n")), F.sum(known)).alias("mean"), F.sum("n").alias("total")
    )
    picked = quantiles(counted, keys, [p / 100 for p in PERCENTILES]).groupBy(*keys).agg(
        *[F.max(F.when(F.col("share") == p / 100, F.col("value"))).alias(f"p{p}") for p in PERCENTILES]
    )
    return means.join(picked, keys, "left")


def spread(df: DataFrame, value: str) -> DataFrame:
    """``stat, value``: mean and linearly interpolated percentiles of a column.

    Equal values are counted first; :func:`quantiles` selects among the counts.
    """
    counted = cut_lineage(df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")))
    one = df.sparkSession.range(1).select(F.lit(0).alias("_all"))
    return one.join(_summaries(counted.withColumn("_all", F.lit(0)), ["_all"]), "_all", "left").select(_stat_rows())


def graph_stats(nodes: DataFrame, edges: DataFrame, weight: str = "weight") -> DataFrame:
    """``measure, stat, value``: count, mean and percentiles of degrees and edge weights.

    The two counts are the numbers of nodes and edges. Degrees and weights are
    taken in one pass over the edges.
    """
    no_node, no_weight = F.lit(None).cast(nodes.schema["node"].dataType), F.lit(None).cast("double")

    def part(node: Column, value: Column, ends: int) -> Column:
        return F.struct(node.alias("node"), value.alias("w"), F.lit(ends).cast("long").alias("ends"))

    weighed = part(no_node, F.col(weight).cast("double"), 1)
    of_edges = edges.select(
        F.inline(F.array(part(F.col("src"), no_weight, 1), part(F.col("dst"), no_weight, 1), weighed))
    )
    of_nodes = nodes.select(part(F.col("node"), no_weight, 0).alias("r")).select("r.*")
    counted = of_edges.unionByName(of_nodes).groupBy("node", "w").agg(F.sum("ends").alias("ends"))
    is_node = F.col("node").isNotNull()
    values = counted.select(
        F.when(is_node, F.lit("degree")).otherwise(F.lit("weight")).alias("measure"),
        F.when(is_node, F.col("ends").cast("double")).otherwise(F.col("w")).alias("v"),
        F.when(is_node, F.lit(1)).otherwise(F.col("ends")).alias("n"),
    )
    shared = cut_lineage(values.groupBy("measure", "v").agg(F.sum("n").cast("long").alias("n")))
    measures = F.explode(F.array(F.lit("degree"), F.lit("weight"))).alias("measure")
    named = edges.sparkSession.range(1).select(measures).join(_summaries(shared, ["measure"]), "measure", "left")
    return named.select("measure", _stat_rows(F.coalesce(F.col("total").cast("double"), F.lit(0.0))))


def node_index(nodes: DataFrame, node: str = "node", buckets: int | None = None) -> DataFrame:
    """``node, idx`` with indices in node order, the row and column order of exports."""
    return dense_index(nodes.select(F.col(node).alias("node")).distinct(), ["node"], "idx", buckets)


def indexed_edges(edges: DataFrame, index: DataFrame, weight: str = "weight") -> DataFrame:
    """``src_idx, dst_idx, weight``: the edge list over node indices."""
    src = index.select(F.col("node").alias("src"), F.col("idx").alias("src_idx"))
    dst = index.select(F.col("node").alias("dst"), F.col("idx").alias("dst_idx"))
    return edges.join(src, "src").join(dst, "dst").select("src_idx", "dst_idx", F.col(weight).alias("weight"))


def dense_rows(
    edges: DataFrame, nodes: DataFrame, weight: str = "weight"
) -> DataFrame:
    """``idx, node, row``: one array of weights per node, rows and columns in node order.

    A dense matrix grows with the square of the nodes; one row of it has to fit
    into memory. Rows are put together from sorted cells and the gaps between them.
    """
    n = nodes.select("node").distinct().count()
    index = node_index(nodes)
    listed = indexed_edges(edges, index, weight).select(
        "src_idx", "dst_idx", F.col("weight").cast("double").alias("weight")
    )
    ordered = F.sort_array(F.collect_list(F.struct("dst_idx", "weight")))
    cells = listed.groupBy(F.col("src_idx").alias("idx")).agg(ordered.alias("_cells"))

    def zeros(first, end):
        return F.array_repeat(F.lit(0.0), (end - first).cast("int"))

    def before(i):
        return F.coalesce(F.get("_cells", i - 1)["dst_idx"] + 1, F.lit(0))

    filled = F.flatten(
        F.transform("_cells", lambda x, i: F.concat(zeros(before(i), x["dst_idx"]), F.array(x["weight"])))
    )
    row = F.coalesce(
        F.concat(filled, zeros(before(F.size("_cells")), F.lit(n))), F.array_repeat(F.lit(0.0), n)
    )
    return index.join(cells, "idx", "left").select("idx", "node", row.alias("row"))
