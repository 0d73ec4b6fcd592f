"""Vocabularies, node features and per-row features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajflow.functions.expressions import time_period
from trajflow.operators.flow import ROW_ORDER
from trajflow.operators.ordered import dense_index
from trajflow.session import cut_lineage


def build_vocab(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """``value, idx``: the distinct values of a column numbered in sorted order."""
    values = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    return dense_index(values, ["value"], "idx", buckets)


def encode(df: DataFrame, vocab: DataFrame, column: str, name: str | None = None, how: str = "left") -> DataFrame:
    """Append the vocabulary index of ``column`` as ``name`` (``<column>_idx``)."""
    keyed = vocab.select(F.col("value").alias(column), F.col("idx").alias(name or f"{column}_idx"))
    return df.join(keyed, column, how)


def poi_categories(df: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """``POI_id, POI_catname, POI_category`` of each place's last row."""
    last = F.max_by(F.struct("POI_catname", "POI_category"), F.struct(*order)).alias("_last")
    rows = df.filter(F.col("POI_id").isNotNull()).groupBy("POI_id").agg(last)
    return rows.select("POI_id", "_last.POI_catname", "_last.POI_category")


def category_index(
    df: DataFrame, places: DataFrame, names: DataFrame, types: DataFrame, order: Sequence[str] = ROW_ORDER
) -> DataFrame:
    """``poi, cat, category``: each place's name and type as vocabulary indices."""
    mapped = encode(poi_categories(df, order), places, "POI_id", "poi", "inner")
    mapped = encode(mapped, names, "POI_catname", "cat")
    return encode(mapped, types, "POI_category", "category").select("poi", "cat", "category")


def time_features(df: DataFrame, column: str = "local_time") -> DataFrame:
    """Append ``hour, weekday`` (Monday 0) and ``time_period``; unreadable times drop out."""
    timed = df.withColumn(column, F.try_to_timestamp(column)).dropna(subset=[column])
    hour = F.hour(column)
    return timed.withColumns(
        {"hour": hour, "weekday": F.weekday(column), "time_period": time_period(hour)}
    )


def cluster_centres(df: DataFrame, k: int = 60, seed: int = 42, iterations: int = 20) -> DataFrame:
    """``location_cluster, latitude, longitude``: centres of a weighted k-means over the places of ``df``.

    Equal coordinates are one point that weighs as many rows, and the points
    are kept in the shared folder: the fit passes over them, not over the rows
    and what they were made from. No complete coordinates give no centres.
    """
    place = df.dropna(subset=["latitude", "longitude"]).groupBy("latitude", "longitude").agg(F.count("*").alias("n"))
    place = cut_lineage(place.withColumn("n", F.col("n").cast("double")))
    schema = "location_cluster int, latitude double, longitude double"
    if place.isEmpty():
        return df.sparkSession.createDataFrame([], schema)
    assembler = VectorAssembler(inputCols=["latitude", "longitude"], outputCol="_point")
    means = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="_point", weightCol="n")
    centres = means.fit(assembler.transform(place)).clusterCenters()
    rows = [(i, float(c[0]), float(c[1])) for i, c in enumerate(centres)]
    return df.sparkSession.createDataFrame(rows, schema)


def assign_clusters(df: DataFrame, centres: DataFrame) -> DataFrame:
    """Append ``location_cluster``, the nearest of at most some hundred ``centres`` (ties to the smaller number).

    Every row stays, with a null cluster where a coordinate is missing. The
    nearest centre is found once for every distinct place.
    """
    listed = centres.select(F.lit(0).alias("_all"), F.struct("location_cluster", "latitude", "longitude").alias("c"))
    listed = listed.groupBy("_all").agg(F.collect_list("c").alias("_c"))
    place = df.dropna(subset=["latitude", "longitude"]).select("latitude", "longitude").distinct()

    def away(c):
        return F.pow(c["latitude"] - F.col("latitude"), 2) + F.pow(c["longitude"] - F.col("longitude"), 2)

    ranked = F.transform("_c", lambda c: F.struct(away(c).alias("d"), c["location_cluster"].alias("i")))
    known = place.withColumn("_all", F.lit(0)).join(listed, "_all")
    known = known.select("latitude", "longitude", F.array_min(ranked)["i"].alias("location_cluster"))
    return df.join(known, ["latitude", "longitude"], "left").select(*df.columns, "location_cluster")


def location_clusters(df: DataFrame, k: int = 60, seed: int = 42) -> DataFrame:
    """Append ``location_cluster`` from k-means over latitude and longitude; see :func:`assign_clusters`."""
    return assign_clusters(df, cluster_centres(df, k, seed))


def node_features(nodes: DataFrame, category: str = "POI_catid_code") -> DataFrame:
    """``node, feature, value``: the stored cells of ``[count, one-hot category, lat, lon]``.

    ``feature`` is the column number. Category columns follow the sorted codes.
    """
    vocab = build_vocab(nodes, category)
    coded = encode(nodes, vocab, category, "_cat")
    width = vocab.count()
    cells = F.array(
        F.struct(F.lit(0).cast("long").alias("feature"), F.col("checkin_cnt").cast("double").alias("value")),
        F.struct((F.col("_cat") + 1).alias("feature"), F.lit(1.0).alias("value")),
        F.struct(F.lit(width + 1).cast("long").alias("feature"), F.col("latitude").alias("value")),
        F.struct(F.lit(width + 2).cast("long").alias("feature"), F.col("longitude").alias("value")),
    )
    return coded.select("node", F.inline(F.filter(cells, lambda c: c["feature"].isNotNull())))


def node_vectors(nodes: DataFrame, category: str = "POI_catid_code") -> DataFrame:
    """``node, features``: the same matrix as sparse ML vectors.

    A node without category has no one-hot cell, a missing coordinate is NaN.
    """
    vocab = build_vocab(nodes, category)
    # The encoder learns the number of categories from the vocabulary; the one behind the last stands for none.
    encoder = OneHotEncoder(inputCols=["_cat"], outputCols=["_onehot"], dropLast=True, handleInvalid="keep")
    model = encoder.fit(vocab.select(F.col("idx").cast("double").alias("_cat")))
    none = F.lit(float(model.categorySizes[0]))
    coded = encode(nodes, vocab, category, "_cat").withColumn("_cat", F.coalesce(F.col("_cat").cast("double"), none))
    assembler = VectorAssembler(
        inputCols=["checkin_cnt", "_onehot", "latitude", "longitude"], outputCol="features", handleInvalid="keep"
    )
    return assembler.transform(model.transform(coded)).select("node", "features")


def zscore(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[float], list[float]]:
    """``df`` with standardised columns, and their means and population deviations.

    A constant column becomes null.
    """
    row = df.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    means, deviations = list(row[: len(columns)]), list(row[len(columns) :])
    scaled = {
        c: F.try_divide(F.col(c).cast("double") - F.lit(m), F.lit(s))
        for c, m, s in zip(columns, means, deviations)
    }
    return df.withColumns(scaled), means, deviations
