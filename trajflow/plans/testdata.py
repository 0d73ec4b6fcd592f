"""The event tables seen as check-ins, as a DataFrame and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajflow.session import over_all_cores

# Event tables carry no row position; a user's events never share a timestamp.
ORDER = ("ts", "event_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts")
    week = F.floor((F.dayofmonth(ts) - 1) / 7)
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    events = over_all_cores(table(spark, sf_dir, "events"))
    events = events.select("event_id", "ts", "user_id", k.alias("k"))
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("user_id"),
        F.col("k").cast("string").alias("POI_id"),
        F.concat(F.lit("cid"), (F.col("k") % 20).cast("string")).alias("POI_catid"),
        (F.col("k") % 20).alias("POI_catid_code"),
        F.concat(F.lit("name_"), (F.col("k") % 20).cast("string")).alias("POI_catname"),
        F.concat(F.lit("type_"), (F.col("k") % 4).cast("string")).alias("POI_category"),
        (F.lit(40.70) + (F.col("k") % 10) * F.lit(0.004)).alias("latitude"),
        (F.lit(-74.00) + F.floor(F.col("k") / 10) * F.lit(0.004)).alias("longitude"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("UTC_time"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("local_time"),
        F.weekday(ts).alias("day_of_week"),
        (seconds / 86400).alias("norm_in_day_time"),
        F.concat_ws("_", F.col("user_id").cast("string"), week.cast("string")).alias("trajectory_id"),
        week.cast("int").alias("week"),
        "k",
    )


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks 0 to 2 of nine users in ten, without the places 90 to 99."""
    return checkins(spark, sf_dir).filter(
        (F.col("week") <= 2) & (F.col("user_id").cast("long") % 10 != 9) & (F.col("k") < 90)
    )


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks 3 and 4 of all users and places."""
    return checkins(spark, sf_dir).filter(F.col("week") >= 3)


LINE_ORDER = ("at", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as visits: the customer visits the part, an order is a trajectory.

    Line numbers repeat, so the order columns include the item's other values;
    rows equal in all of them are interchangeable.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", *LINE_ORDER[1:])
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    customer, part = F.col("o_custkey").cast("string"), F.col("l_partkey").cast("string")
    return both.select(
        customer.alias("user_id"),
        part.alias("POI_id"),
        F.concat_ws("_", customer, F.col("o_orderkey").cast("string")).alias("trajectory_id"),
        F.struct("o_orderdate", "o_orderkey").alias("at"),
        *LINE_ORDER[1:],
        "l_partkey",
    )


PURCHASES_SQL = """
pur AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS POI_id,
    o_custkey || '_' || o_orderkey AS trajectory_id, o_orderdate, o_orderkey,
    l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
CHECKINS_SQL = """
ck AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id, CAST(k AS VARCHAR) AS POI_id,
         'cid' || (k % 20) AS POI_catid, k % 20 AS POI_catid_code,
         'name_' || (k % 20) AS POI_catname, 'type_' || (k % 4) AS POI_category,
         CAST(40.70 AS DOUBLE) + (k % 10) * CAST(0.004 AS DOUBLE) AS latitude,
         CAST(-74.00 AS DOUBLE) + (k // 10) * CAST(0.004 AS DOUBLE) AS longitude,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS UTC_time,
         strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS local_time,
         CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
         CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE)
           / CAST(86400 AS DOUBLE) AS norm_in_day_time,
         CAST(user_id AS VARCHAR) || '_' || ((day(ts) - 1) // 7) AS trajectory_id,
         CAST((day(ts) - 1) // 7 AS INTEGER) AS week, k
  FROM (SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""
TRAINING_SQL = (
    "tr AS (SELECT * FROM ck WHERE week <= 2 AND CAST(user_id AS BIGINT) % 10 <> 9 AND k < 90)"
)
VALIDATION_SQL = "va AS (SELECT * FROM ck WHERE week >= 3)"
