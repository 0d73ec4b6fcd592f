"""Graph matrices and feature propagation over sparse edges.

A matrix is a table ``src, dst, value`` of its stored cells, a vector table is
``node, vector`` with an array column.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajflow.functions.expressions import dot, leaky_relu
from trajflow.session import cut_lineage, hashed, remove_at_exit, scratch_path

# The names of the matrix kinds.
KINDS = ("com_lap_mat", "wid_rw_normd_lap_mat", "hat_rw_normd_lap_mat")


def row_sums(edges: DataFrame, nodes: DataFrame, weight: str = "weight") -> DataFrame:
    """``node, deg``: total outgoing weight, 0 for nodes without outgoing edges."""
    sums = edges.groupBy(F.col("src").alias("node")).agg(F.sum(F.col(weight).cast("double")).alias("deg"))
    return nodes.select("node").join(sums, "node", "left").fillna(0.0, ["deg"])


def _nonzero(deg: Column, node: Column) -> Column:
    """``deg``, failing with the node's name where it is 0."""
    message = F.concat(F.lit("node without outgoing weight: "), node.cast("string"))
    return F.when(deg != 0, deg).otherwise(F.raise_error(message).cast("double"))


def laplacian(
    edges: DataFrame,
    nodes: DataFrame,
    kind: str,
    weight: str = "weight",
    lambda_max: float = 1.0,
) -> DataFrame:
    """``src, dst, value`` of the chosen matrix; every node has its diagonal cell.

    ``com_lap_mat`` is ``D - A``, ``hat_rw_normd_lap_mat`` ``(D+I)^-1 (A+I)`` and
    ``wid_rw_normd_lap_mat`` ``2 (I - D^-1 A) / lambda - I``. ``D^-1 A`` has rows
    that sum to 1, so its largest eigenvalue is 1 as long as weights are not
    negative; for other graphs pass :func:`dominant_eigenvalue` as ``lambda_max``.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown matrix kind: {kind}")
    # Every node adds an empty diagonal cell. Row sums are partial sums joined back, so a hub's cells never meet.
    diagonal = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("w"))
    stored = edges.select("src", "dst", F.col(weight).cast("double").alias("w"))
    cells = stored.unionByName(diagonal).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    summed = cells.join(cells.groupBy("src").agg(F.sum("w").alias("d")), "src")
    on_diagonal, w, d = F.col("src") == F.col("dst"), F.col("w"), F.col("d")
    if kind == "com_lap_mat":
        value = F.when(on_diagonal, d).otherwise(0.0) - w
    elif kind == "hat_rw_normd_lap_mat":
        value = (w + F.when(on_diagonal, 1.0).otherwise(0.0)) / (d + 1)
    else:
        scale = 2.0 / lambda_max
        value = F.when(on_diagonal, scale - 1).otherwise(0.0) - w * scale / _nonzero(d, F.col("src"))
    return summed.select("src", "dst", value.alias("value"))


def walk_matrix(edges: DataFrame, nodes: DataFrame, weight: str = "weight", shift: float = 0.0) -> DataFrame:
    """``src, dst, value`` of ``(D^-1 A + shift I) / (1 + shift)``; the eigenvectors are those of ``D^-1 A``."""
    deg = row_sums(edges, nodes, weight).withColumnRenamed("node", "src")
    share = F.col(weight).cast("double") / _nonzero(F.col("deg"), F.col("src")) / (1 + shift)
    cells = edges.join(deg, "src").select("src", "dst", share.alias("value"))
    if not shift:
        return cells
    own = nodes.select(
        F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(shift / (1 + shift)).alias("value")
    )
    return cells.unionByName(own)


def hashed_cells(matrix: DataFrame, nodes: DataFrame, partitions: int | None = None) -> DataFrame:
    """The matrix as a table bucketed by ``dst``, with an empty diagonal cell for every node.

    Joins by ``dst`` read the buckets where they lie. The table is temporary:
    its files go with the session, its name with :func:`drop_cells`.
    """
    spark = matrix.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    empty = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("value"))
    cells = matrix.select("src", "dst", "value").unionByName(empty).repartition(n, "dst")
    name = f"cells_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    cells.write.bucketBy(n, "dst").sortBy("dst").format("parquet").option("path", path).saveAsTable(name)
    remove_at_exit(spark, path)
    table = spark.table(name)
    table.cells_name = name
    return table


def drop_cells(cells: DataFrame) -> None:
    """Take the name of :func:`hashed_cells` out of the catalog."""
    cells.sparkSession.sql(f"DROP TABLE IF EXISTS {cells.cells_name}")


def _step(cells: DataFrame, vector: DataFrame) -> DataFrame:
    moved = cells.join(vector.select(F.col("node").alias("dst"), "x"), "dst")
    return moved.groupBy(F.col("src").alias("node")).agg(F.sum(F.col("value") * F.col("x")).alias("x"))


def iterate(cells: DataFrame, start: DataFrame, steps: int, per_checkpoint: int = 5) -> DataFrame:
    """``node, x, y``: ``start`` (``node, x``) multiplied ``steps`` times, at length 1, and its image ``y``.

    ``cells`` are :func:`hashed_cells`: a step joins the vector where the matrix
    lies and moves partial sums by ``src`` only, which is where the next step
    needs them. ``per_checkpoint`` steps are one job, whose result is written
    to the shared folder; only its length reaches the driver.
    """
    vector = start.select("node", F.col("x").cast("double").alias("x"))
    done = 0
    while done < steps:
        todo = min(per_checkpoint, steps - done)
        for _ in range(todo):
            vector = _step(cells, vector)
        vector, done = cut_lineage(vector), done + todo
        length = vector.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
        if not length:
            break
        vector = vector.select("node", (F.col("x") / length).alias("x"))
    return cut_lineage(vector.join(_step(cells, vector).withColumnRenamed("x", "y"), "node"))


def eigenpair(found: DataFrame, shift: float = 0.0) -> DataFrame:
    """``value, residual`` of :func:`iterate` over a matrix with ``shift``: the Rayleigh quotient and its error."""
    x, y = F.col("x"), F.col("y")
    unit = found.agg(F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"))
    share = F.try_divide(F.col("xy"), F.col("xx"))
    rest = F.try_divide(F.col("yy"), F.col("xx")) - share * share
    return unit.select(
        (share * (1 + shift) - shift).alias("value"),
        (F.sqrt(F.greatest(F.lit(0.0), rest)) * (1 + shift)).alias("residual"),
    )


def dominant_eigenvalue(
    edges: DataFrame,
    nodes: DataFrame,
    weight: str = "weight",
    iterations: int = 100,
    tolerance: float = 1e-6,
    per_checkpoint: int = 5,
) -> float:
    """Largest eigenvalue of ``D^-1 A``, for ``laplacian(..., lambda_max=...)``.

    The matrix is shifted by 1, so its vector settles on periodic graphs too.
    Blocks of ``per_checkpoint`` steps go on until the residual is under
    ``tolerance``; more than ``iterations`` steps are an error.
    """
    cells = hashed_cells(walk_matrix(edges, nodes, weight, 1.0), nodes)
    # A start vector with different entries, so that no symmetry hides the answer.
    vector = nodes.select("node", (1 + F.pmod(F.xxhash64("node"), F.lit(1000)) / 1000.0).alias("x"))
    done, value, residual = 0, None, None
    while done < iterations:
        found = iterate(cells, vector, min(per_checkpoint, iterations - done), per_checkpoint)
        value, residual = eigenpair(found, 1.0).first()
        if value is None or residual < tolerance:
            drop_cells(cells)
            return value or 0.0
        vector, done = found.select("node", F.col("y").alias("x")), done + per_checkpoint
    raise ArithmeticError(f"no eigenvalue after {iterations} steps: {value}, residual {residual}")


def repeated_vectors(matrix: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A matrix whose cells point to distinct vectors, hashed by ``src``, and the distinct vectors.

    A row's cells that point to equal vectors are added up while they are
    narrow, and its wide sums are made where the row lies. Vectors go by a hash;
    should two different ones share it, both inputs come back as they were.
    """
    spark = features.sparkSession
    named = features.withColumn("_class", F.xxhash64("vector"))
    path = scratch_path(spark, "vectors")
    named.select(F.col("_class").alias("node"), "vector").distinct().write.parquet(path)
    remove_at_exit(spark, path)
    distinct = spark.read.parquet(path)
    if not distinct.groupBy("node").count().filter(F.col("count") > 1).isEmpty():
        return matrix, features
    kinds = named.select(F.col("node").alias("dst"), "_class")
    cells = hashed(matrix.join(kinds, "dst").select("src", F.col("_class").alias("dst"), "value"), "src")
    return cells.groupBy("src", "dst").agg(F.sum("value").alias("value")), distinct


def propagate(
    matrix: DataFrame, features: DataFrame, dim: int, block: int = 32, repeated: bool = False
) -> DataFrame:
    """``node, vector``: each node's weighted sum of the vectors its cells point to.

    A vector is cut into rows of ``block`` dimensions, so a step has as many
    sums at any width; the blocks of a node are put together at the end. With
    ``repeated``, for features that many nodes have in common, equal vectors
    are taken together first (:func:`repeated_vectors`).
    """
    if repeated:
        matrix, features = repeated_vectors(matrix, features)
    width = min(block, dim)
    columns = [f"_x{i}" for i in range(width)]
    count = -(-dim // width)
    cuts = F.array(*[F.struct(F.lit(b).alias("_b"), F.slice("vector", b * width + 1, width).alias("_v")) for b in range(count)])
    parts = features.select(F.col("node").alias("dst"), F.inline(cuts)).select(
        "dst", "_b", *[F.get("_v", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)]
    )
    sums = [F.sum(F.col("value") * F.col(c)).alias(c) for c in columns]
    summed = matrix.join(parts, "dst").groupBy(F.col("src").alias("node"), "_b").agg(*sums)
    if count == 1:
        return summed.select("node", F.array(*columns).alias("vector"))
    blocks = F.sort_array(F.collect_list(F.struct("_b", F.array(*columns).alias("_v"))))
    joined = summed.groupBy("node").agg(blocks.alias("_l"))
    return joined.select("node", F.slice(F.flatten(F.col("_l._v")), 1, dim).alias("vector"))


def linear(features: DataFrame, weights: Sequence[Sequence[float]]) -> DataFrame:
    """``node, vector`` multiplied by a small weight matrix, on Arrow batches."""
    matrix = np.asarray(weights, dtype=float)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def times(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(vectors.to_list()) @ matrix))

    return features.select("node", times("vector").alias("vector"))


def gcn_forward(
    matrix: DataFrame,
    features: DataFrame,
    layers: Sequence[tuple[Sequence[Sequence[float]], Sequence[float]]],
    slope: float = 0.2,
    repeated: bool = False,
) -> DataFrame:
    """Graph convolution with given ``(weights, bias)`` layers.

    Leaky ReLU follows every layer but the last. ``repeated`` is that of
    :func:`propagate`, for the first layer.
    """
    cells = matrix
    if repeated:
        cells, features = repeated_vectors(matrix, features)
    for depth, (weights, bias) in enumerate(layers):
        summed = propagate(matrix if depth else cells, linear(features, weights), len(bias))
        shifted = F.zip_with("vector", F.array(*[F.lit(float(b)) for b in bias]), lambda x, b: x + b)
        if depth < len(layers) - 1:
            shifted = F.transform(shifted, lambda x: leaky_relu(x, slope))
        features = summed.select("node", shifted.alias("vector"))
    return features


def edge_attention(
    edges: DataFrame,
    features: DataFrame,
    weights: Sequence[Sequence[float]],
    attention: Sequence[float],
    weight: str = "weight",
    slope: float = 0.2,
) -> DataFrame:
    """``src, dst, value`` = leaky ReLU of both ends' scores, times weight + 1.

    ``attention`` holds the source half, then the target half. Cells without an
    edge are masked and therefore not stored.
    """
    w = np.asarray(weights, dtype=float)
    a = np.asarray(attention, dtype=float)
    hidden = w.shape[1]
    as_source, as_target = w @ a[:hidden], w @ a[hidden:]
    scores = features.select(
        "node", dot(F.col("vector"), as_source).alias("s"), dot(F.col("vector"), as_target).alias("t")
    )
    ends = (
        edges.filter(F.col(weight) > 0)
        .join(scores.select(F.col("node").alias("src"), "s"), "src")
        .join(scores.select(F.col("node").alias("dst"), "t"), "dst")
    )
    value = leaky_relu(F.col("s") + F.col("t"), slope) * (F.col(weight) + 1)
    return ends.select("src", "dst", value.alias("value"))
