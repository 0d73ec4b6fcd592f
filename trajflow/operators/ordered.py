"""Neighbours, positions, group totals, numbers and quantiles of ordered rows, safe for hot keys.

A window sends every row of a key to one task. The rows of a key that holds a
large share of the table are therefore ranged along key and order by the
engine's own range partitioning; each range of a key runs as an ordinary
window, and a summary of one row per range (first row, last row, row count)
stitches them together. The result is the same as that of the plain window,
wherever the ranges end, since rows equal in all order columns share one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajflow.session import cut_lineage, estimated_bytes

#: Rows of a key that one task orders comfortably; the default of ``hot_rows``.
HOT_ROWS = 5_000_000
#: Tables under this size are taken to have no such key, and are numbered by one task; a default too.
SMALL_BYTES = 256 << 20


def is_small(df: DataFrame, limit: int = SMALL_BYTES) -> bool:
    size = estimated_bytes(df)
    return size is not None and size < limit


def hot_keys(
    df: DataFrame, keys: Sequence[str], hot_rows: int | None = None, small_bytes: int = SMALL_BYTES
) -> DataFrame | None:
    """``keys`` with more than ``hot_rows`` rows, their ``_rows`` and ``_parts`` of ``hot_rows``; ``None`` if there are none.

    Without ``hot_rows``, tables of less than ``small_bytes`` are not counted.
    There are fewer such keys than rows / ``hot_rows``.
    """
    if hot_rows is None:
        if is_small(df, small_bytes):
            return None
        hot_rows = HOT_ROWS
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot_rows)
    hot = cut_lineage(counts.select(*keys, F.ceil(F.col("_rows") / hot_rows).alias("_parts"), "_rows"))
    return None if hot.isEmpty() else hot


def range_parts(df: DataFrame, order: Sequence[str], parts: int, name: str = "_part") -> DataFrame:
    """``df`` in ranges of ``order``, sorted within each, and the range's number.

    The engine samples where to cut. The rows are checkpointed with their
    numbers, so that every use and every recovery sees the same ranges.
    """
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut_lineage(ranged.withColumn(name, F.spark_partition_id()))


def _ranges(hot: DataFrame, spark) -> int:
    """Ranges for the rows of all ``hot`` keys together.

    A range may hold several keys, so that many keys a little over ``hot_rows``
    rows are no flood of tiny tasks: there are no more ranges than the session
    has shuffle partitions, unless a range would have over ``HOT_ROWS`` rows.
    """
    parts, rows = hot.agg(F.sum("_parts"), F.sum("_rows")).first()
    return int(min(parts, max(_parts_of_session(spark), -(-rows // HOT_ROWS))))


def _parts_of_session(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _whole(expressions: Mapping[str, Column], window) -> list[Column]:
    return [value.over(window).alias(name) for name, value in expressions.items()]


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    position: str | None = None,
    size: str | None = None,
    totals: Mapping[str, Column] | None = None,
    running: Mapping[str, str] | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Append per-key ordered values to ``df``.

    ``previous``/``following`` map a new column to the column read from the row
    before/after, ``position`` counts from 0, ``size`` is the number of rows of
    the key, ``totals`` are aggregates over the key and ``running`` maps a new
    column to the column summed up to and including the row. ``hot`` comes
    from :func:`hot_keys` over the same keys.
    """
    previous, following = dict(previous or {}), dict(following or {})
    totals, running = dict(totals or {}), dict(running or {})
    if size:
        totals[size] = F.count(F.lit(1))
    if hot is None:
        whole = Window.partitionBy(*keys)
        along = whole.orderBy(*order)
        upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            "*",
            *[F.lag(source).over(along).alias(name) for name, source in previous.items()],
            *[F.lead(source).over(along).alias(name) for name, source in following.items()],
            *([(F.row_number().over(along) - 1).alias(position)] if position else []),
            *[F.sum(source).over(upto).alias(name) for name, source in running.items()],
            *_whole(totals, whole),
        )

    kept = [F.col(c) for c in df.columns]
    named = hot.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_parts")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    marked = df.join(named, same, "left")
    rest = ordered(
        marked.filter(F.col("_parts").isNull()).select(*kept), keys, order, previous=previous, following=following,
        position=position, totals=totals, running=running,
    )
    split = range_parts(
        marked.filter(F.col("_parts").isNotNull()).select(*kept), [*keys, *order], _ranges(hot, df.sparkSession)
    )
    # A struct, as keys may be null.
    split = split.withColumn("_key", F.struct(*keys))
    inner = Window.partitionBy("_key", "_part")
    along = inner.orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    before = F.struct(*[F.col(c) for c in dict.fromkeys(previous.values())], F.lit(1).alias("_set"))
    after = F.struct(*[F.col(c) for c in dict.fromkeys(following.values())], F.lit(1).alias("_set"))
    rank = F.struct(*[F.col(c) for c in order])
    summary = split.groupBy("_key", "_part").agg(
        F.count("*").alias("_n"),
        F.min_by(after, rank).alias("_first"),
        F.max_by(before, rank).alias("_last"),
        *[F.sum(source).alias(f"_sum_{name}") for name, source in running.items()],
    )
    across = Window.partitionBy("_key").orderBy("_part")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    stitched = summary.select(
        "_key",
        "_part",
        F.lag("_last").over(across).alias("_before"),
        F.lead("_first").over(across).alias("_after"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        *[F.sum(f"_sum_{name}").over(earlier).alias(f"_sum_{name}") for name in running],
    )
    if totals:
        # Two tables of a row per range and per key meet here, so the totals reach the rows by range.
        group = split.groupBy("_key").agg(*[v.alias(f"_all_{n}") for n, v in totals.items()])
        stitched = stitched.join(group, "_key")
    local = split.select(
        "*",
        F.lag(before).over(along).alias("_prev"),
        F.lead(after).over(along).alias("_next"),
        F.row_number().over(along).alias("_rn"),
        *[F.sum(source).over(upto).alias(f"_run_{name}") for name, source in running.items()],
    )
    joined = local.join(stitched, ["_key", "_part"])
    prev, nxt = F.coalesce("_prev", "_before"), F.coalesce("_next", "_after")
    sums = {
        name: reduce(
            lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
            [F.col(f"_sum_{name}"), F.col(f"_run_{name}")],
        )
        for name in running
    }
    solved = joined.select(
        *kept,
        *[prev[source].alias(name) for name, source in previous.items()],
        *[nxt[source].alias(name) for name, source in following.items()],
        *([(F.col("_rn") - 1 + F.col("_offset")).cast("int").alias(position)] if position else []),
        *[value.alias(name) for name, value in sums.items()],
        *[F.col(f"_all_{n}").alias(n) for n in totals],
    )
    return rest.unionByName(solved)


def _parts_of(df: DataFrame, parts: int | None) -> int:
    return parts or _parts_of_session(df.sparkSession)


def dense_index(
    df: DataFrame, order: Sequence[str], name: str = "idx", buckets: int | None = None, small_bytes: int = SMALL_BYTES
) -> DataFrame:
    """Number the rows of ``df`` from 0 in ``order``, which must be unique.

    A table is sorted as the engine sorts any other: in ranges, as many as the
    session's shuffle partitions unless ``buckets`` says. Rows are numbered
    within their range and shifted by the rows of the ranges before it. Without
    ``buckets`` a table of less than ``small_bytes`` is one range.
    """
    if buckets is None and is_small(df, small_bytes):
        buckets = 1
    if buckets == 1:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    # A sorted range's row numbers are the lower 33 bits of these ids, its number the bits above.
    ranged = df.repartitionByRange(_parts_of(df, buckets), *order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    placed = placed.select(*[F.col(c) for c in df.columns], part.alias("_part"), row.alias("_row"))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return placed.join(offsets, "_part").select(
        *[F.col(c) for c in df.columns], (F.col("_row") + F.col("_offset")).alias(name)
    )


def quantiles(
    counted: DataFrame, keys: Sequence[str], shares: Sequence[float], parts: int | None = None
) -> DataFrame:
    """``keys, share, value``: exact, linearly interpolated quantiles of values ``v`` that occur ``n`` times.

    A selection rather than a sort of everything in one place: values are
    ranged, the sums of the ranges before say in which range each wanted rank
    lies, and only there are running counts taken. Null values don't count; keys
    without other values have no row.
    """
    keys = list(keys)
    known = counted.filter(F.col("v").isNotNull())
    placed = range_parts(known, [*keys, "v"], _parts_of(counted, parts))
    sums = placed.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"))
    whole = Window.partitionBy(*keys)
    running = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bounds = sums.select(*keys, "_part", (running - F.col("_n")).alias("_from"), running.alias("_to"),
                         F.sum("_n").over(whole).alias("_total"))
    place = F.col("share") * (F.col("_total") - 1)
    ranks = bounds.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    ranks = ranks.select("*", F.explode(F.array(F.floor(place), F.ceil(place))).alias("_rank"), place.alias("_place"))
    wanted = ranks.filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).distinct()
    chosen = wanted.select(*keys, "_part", "_from").distinct()
    inside = Window.partitionBy(*keys, "_part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = placed.join(chosen, [*keys, "_part"]).select(
        *keys, "_part", "v", "n", (F.col("_from") + F.sum("n").over(inside)).alias("_until")
    )
    found = wanted.drop("_from", "_to").join(counts, [*keys, "_part"]).filter(
        (F.col("_rank") < F.col("_until")) & (F.col("_rank") >= F.col("_until") - F.col("n"))
    )
    low, high = F.min("v"), F.max("v")
    return found.groupBy(*keys, "share", "_place").agg(
        (low + (high - low) * (F.col("_place") - F.floor("_place"))).alias("value")
    ).drop("_place")
