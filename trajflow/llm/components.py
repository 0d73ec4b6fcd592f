"""Connected components by alternating large-star and small-star steps.

Every step is two shuffles keyed by node: a minimum with partial sums and a join back,
so a hub's neighbours never meet in one task. Steps are written to the shared folder,
which cuts their lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajflow.session import remove_at_exit, scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder.

    Spark drops a finished query's shuffle files once the driver's garbage is collected,
    which a driver with little to do would put off, so it is asked to.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(schema).parquet(path)
    table.written_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, once all that was read from them is written itself."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _starred(links: DataFrame, least: DataFrame) -> DataFrame:
    """Each neighbour ``v`` of ``u`` beside the smallest one of ``u``."""
    return links.join(least.withColumnRenamed("u", "at"), F.col("u") == F.col("at")).drop("at")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of all linked nodes.

    ``links`` has columns ``u`` and ``v``, in any direction, repeated or looped at
    will. Links with a null end are left out. No links give an empty table.
    """
    edges = links.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _starred(both, least).where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).where(F.col("u") != F.col("v"))
        # All ends are now ordered: u > v.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _starred(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        ).where(F.col("u") != F.col("v")).distinct()
        edges = written(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        tops.select("node", F.col("node").alias("component"))
    )
