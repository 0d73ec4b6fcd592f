"""Training and validation sequences, batches and next-place candidates.

A sequence is stored as its steps, one row each, so that its length bounds
nothing; ``pack`` turns steps into arrays for consumers that want them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajflow.functions.expressions import owner
from trajflow.operators.features import encode
from trajflow.operators.flow import ROW_ORDER
from trajflow.operators.ordered import dense_index, hot_keys, ordered
from trajflow.session import hashed

SHORT_TRAJECTORY = 4
BATCH = 20
FIELDS = ("poi", "time", "lat", "lon", "week")
PAD = -1


def _points(df: DataFrame, time_feature: str, order: Sequence[str]) -> DataFrame:
    return df.filter(F.col("trajectory_id").isNotNull()).select(
        "trajectory_id",
        "POI_id",
        F.col(time_feature).cast("double").alias("time"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.col("day_of_week").alias("week"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
    )


def _steps(pairs: DataFrame, shift_week: bool) -> DataFrame:
    """Input and label columns; the label keeps the input's week unless shifted."""
    label_week = "next_week" if shift_week else "week"
    return pairs.select(
        "trajectory_id",
        F.col("step").cast("int").alias("step"),
        (F.col("n") - 1).cast("int").alias("length"),
        *[F.col(c).alias(f"in_{c}") for c in FIELDS],
        *[F.col(f"next_{c}").alias(f"label_{c}") for c in FIELDS[:-1]],
        F.col(label_week).alias("label_week"),
    )


def _consecutive(points: DataFrame, order: Sequence[str], hot: DataFrame | None) -> DataFrame:
    return ordered(
        points,
        ["trajectory_id"],
        order,
        following={f"next_{c}": c for c in FIELDS},
        position="step",
        size="n",
        hot=hot,
    )


def train_sequences(
    df: DataFrame,
    vocab: DataFrame,
    thres: int = SHORT_TRAJECTORY,
    time_feature: str = "norm_in_day_time",
    order: Sequence[str] = ROW_ORDER,
    shift_week: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Steps ``(point i, point i+1)`` of trajectories with at least ``thres`` steps."""
    points = _points(df, time_feature, order)
    along = [f"_o{i}" for i in range(len(order))]
    hot = hot_keys(points, ["trajectory_id"], hot_rows)
    coded = encode(points, vocab, "POI_id", "poi")
    pairs = _consecutive(coded, along, hot)
    full = (F.col("n") - 1 >= thres) & (F.col("step") < F.col("n") - 1)
    return _steps(pairs.filter(full), shift_week)


def val_sequences(
    df: DataFrame,
    vocab: DataFrame,
    users: DataFrame,
    thres: int = SHORT_TRAJECTORY,
    time_feature: str = "norm_in_day_time",
    order: Sequence[str] = ROW_ORDER,
    align: bool = False,
    shift_week: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Steps of trajectories whose user is in ``users``, over places in ``vocab``.

    Places outside the vocabulary leave the list of places. ``align`` removes
    their time and location as well; by default those stay, so the i-th known
    place is paired with the features of the i-th row.
    """
    points = _points(df, time_feature, order)
    along = [f"_o{i}" for i in range(len(order))]
    hot = hot_keys(points, ["trajectory_id"], hot_rows)
    seen = users.select(F.col("user_id").alias("_user"))
    points = points.join(seen, owner(F.col("trajectory_id")) == F.col("_user"), "left_semi")
    coded = encode(points, vocab, "POI_id", "poi")
    known = F.col("poi").isNotNull()
    if align:
        pairs = _consecutive(coded.filter(known), along, hot)
    else:
        features = ordered(
            coded.drop("POI_id", "poi"),
            ["trajectory_id"],
            along,
            following={f"next_{c}": c for c in FIELDS[1:]},
            position="step",
            hot=hot,
        )
        places = ordered(
            coded.filter(known).select("trajectory_id", "poi", *along),
            ["trajectory_id"],
            along,
            following={"next_poi": "poi"},
            position="step",
            size="n",
            hot=hot,
        ).drop(*along)
        pairs = places.join(features, ["trajectory_id", "step"])
    full = (F.col("n") - 1 >= thres) & (F.col("step") < F.col("n") - 1)
    return _steps(pairs.filter(full), shift_week)


def step_categories(
    steps: DataFrame, categories: DataFrame, places: Sequence[str] = ("in_poi", "label_poi")
) -> DataFrame:
    """Append name and type index (``in_cat``, ``in_category``, …) of both places of a step."""
    for place in places:
        side = place.removesuffix("poi")
        named = categories.select(
            F.col("poi").alias(place),
            F.col("cat").alias(f"{side}cat"),
            F.col("category").alias(f"{side}category"),
        )
        steps = steps.join(named, place, "left")
    return steps


def pack(steps: DataFrame) -> DataFrame:
    """``trajectory_id, input_seq, label_seq``: one row of arrays per sequence.

    The row holds the whole sequence, which is what a batch loader reads.
    """

    def point(side: str) -> Column:
        named = [F.col(f"{side}_{c}").alias("poi_idx" if c == "poi" else c) for c in FIELDS]
        return F.struct(*named).alias(side)

    listed = F.array_sort(F.collect_list(F.struct("step", point("in"), point("label"))))
    return (
        steps.groupBy("trajectory_id")
        .agg(listed.alias("_s"))
        .select(
            "trajectory_id",
            F.transform("_s", lambda s: s["in"]).alias("input_seq"),
            F.transform("_s", lambda s: s["label"]).alias("label_seq"),
        )
    )


def relative_location(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("trajectory_id",),
    order: Sequence[str] = ("step",),
    prefix: str = "rel_",
    hot_rows: int | None = None,
) -> DataFrame:
    """Append ``radians((x - first) / (max - min + 1e-6))`` per sequence."""
    keys, order = list(keys), list(order)
    hot = hot_keys(df.select(*keys, *order), keys, hot_rows)
    totals = {}
    for c in columns:
        totals |= {
            f"_first_{c}": F.min_by(c, F.struct(*order)),
            f"_max_{c}": F.max(c),
            f"_min_{c}": F.min(c),
        }
    spread = ordered(df, keys, order, totals=totals, hot=hot)

    def relative(c: str) -> Column:
        scale = F.lit(1.0) / (F.col(f"_max_{c}") - F.col(f"_min_{c}") + F.lit(1e-6))
        return F.radians((F.col(c) - F.col(f"_first_{c}")) * scale)

    return spread.select(*df.columns, *[relative(c).alias(prefix + c) for c in columns])


def last_context(steps: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``trajectory_id, last_time, last_lat, last_lon`` of each sequence's last label.

    Latitude and longitude are relative within the label sequence. These columns
    tell where the target is, hence a table of their own.
    """
    labels = steps.select("trajectory_id", "step", "length", "label_time", "label_lat", "label_lon")
    placed = relative_location(labels, ["label_lat", "label_lon"], hot_rows=hot_rows)
    return placed.filter(F.col("step") == F.col("length") - 1).select(
        "trajectory_id",
        F.col("label_time").alias("last_time"),
        F.col("rel_label_lat").alias("last_lat"),
        F.col("rel_label_lon").alias("last_lon"),
    )


def assign_batches(steps: DataFrame, batch: int = BATCH, seed: int | None = None) -> DataFrame:
    """``trajectory_id, length, batch``: sequences in id order, or shuffled by ``seed``."""
    ids = steps.filter(F.col("step") == 0).select("trajectory_id", "length")
    if seed is None:
        indexed = dense_index(ids, ["trajectory_id"], "_i")
    else:
        shuffled = ids.withColumn("_h", F.xxhash64(F.lit(seed), "trajectory_id"))
        indexed = dense_index(shuffled, ["_h", "trajectory_id"], "_i").drop("_h")
    return indexed.select(
        "trajectory_id", "length", F.floor(F.col("_i") / batch).cast("long").alias("batch")
    )


def padded_batches(steps: DataFrame, batch: int = BATCH, seed: int | None = None) -> DataFrame:
    """``batch, trajectory_id, pos`` and the step's columns, -1 beyond the sequence.

    All sequences of a batch have as many rows as its longest one.
    """
    batches = assign_batches(steps, batch, seed)
    longest = batches.groupBy("batch").agg(F.max("length").alias("_max"))
    values = [c for c in steps.columns if c not in ("trajectory_id", "step", "length")]
    kinds = {f.name: f.dataType for f in steps.schema.fields}
    real = steps.join(batches.select("trajectory_id", "batch"), "trajectory_id").select(
        "batch", "trajectory_id", F.col("step").alias("pos"), *values
    )
    short = batches.join(longest, "batch").filter(F.col("length") < F.col("_max"))
    pads = short.select(
        "batch",
        "trajectory_id",
        F.explode(F.sequence("length", F.col("_max") - 1)).alias("pos"),
        *[F.lit(PAD).cast(kinds[c]).alias(c) for c in values],
    )
    return real.unionByName(pads)


def flow_shares(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """``src, item, score``: the share of a place's outgoing weight that goes to an item."""
    out = edges.groupBy("src").agg(F.sum(F.col(weight).cast("double")).alias("_out"))
    share = F.try_divide(F.col(weight).cast("double"), F.col("_out"))
    return edges.join(out, "src").select("src", F.col("dst").alias("item"), share.alias("score"))


#: Ranks that one row stands for before it is spelled out.
RANKS_AT_ONCE = 1 << 16


def _of_place(steps: DataFrame, lists: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Every step with the rows of ``lists`` for its place; places in ``hot`` are salted by step."""
    if hot is None:
        return steps.join(lists, "src")
    parts, hot = F.coalesce(F.col("_parts"), F.lit(1)), hot.select("src", "_parts")
    dealt = steps.join(hot, "src", "left").withColumn(
        "_salt", F.pmod(F.xxhash64("trajectory_id", "step"), parts).cast("int")
    )
    copied = lists.join(hot, "src", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))
    )
    return dealt.drop("_parts").join(copied.drop("_parts"), ["src", "_salt"]).drop("_salt")


def _unlisted(steps: DataFrame, listed: DataFrame, popular: DataFrame, hot: DataFrame | None) -> DataFrame:
    """All places that a step's list lacks, by popularity, at scores -1, -2 and so on.

    Places are numbered by popularity. What a list lacks are the ranges between
    the numbers it has, and within a range the score follows from the number,
    so steps meet ranges and only then spell them out.
    """
    ordered_ = popular.select(F.col("node").alias("item"), (-F.col("checkin_cnt")).alias("_less"))
    index = dense_index(ordered_, ["_less", "item"], "_r").select("item", "_r")
    before = steps.select("src").distinct().withColumn("_r", F.lit(-1).cast("long"))
    held = listed.join(index, "item").select("src", "_r").unionByName(before)
    along = Window.partitionBy("src").orderBy("_r")
    end = index.count()
    gaps = held.select(
        "src", (F.col("_r") + 1).alias("_lo"), F.lead("_r").over(along).alias("_next"),
        (F.row_number().over(along) - 1).alias("_held"),
    )
    gaps = gaps.withColumn("_hi", F.coalesce("_next", F.lit(end)) - 1).filter(F.col("_lo") <= F.col("_hi"))
    cuts = gaps.select("src", "_held", "_hi", F.explode(F.sequence("_lo", "_hi", F.lit(RANKS_AT_ONCE))).alias("_lo"))
    cuts = cuts.withColumn("_hi", F.least("_hi", F.col("_lo") + RANKS_AT_ONCE - 1))
    rows = _of_place(steps, cuts, hot).select(
        "trajectory_id", "step", "_held", F.explode(F.sequence("_lo", "_hi")).alias("_r")
    )
    score = (F.col("_held") - F.col("_r") - 1).cast("double")
    return rows.join(index, "_r").select("trajectory_id", "step", "item", score.alias("score"))


def rank_next(
    steps: DataFrame,
    edges: DataFrame,
    k: int | None = None,
    place: str = "in_poi",
    weight: str = "weight",
    popular: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """``trajectory_id, step, item, score`` candidates after the step's place.

    With ``k`` only the best ``k`` per step, ties to the smaller item; they are
    chosen once per place, before the steps are looked up. With ``popular``
    (``node, checkin_cnt``) lists are filled up with the most visited other
    places, at negative scores below all flow candidates: to ``k``, or without
    it to the full list of places. Places in more than ``hot_rows`` steps are
    salted (see :func:`hot_keys`).
    """
    shares = flow_shares(edges, weight)
    if k is None:
        listed = shares
    else:
        best = Window.partitionBy("src").orderBy(F.desc("score"), "item")
        listed = shares.withColumn("_rk", F.row_number().over(best)).filter(F.col("_rk") <= k).drop("_rk")
    # Hashed before the fan-out, so that the candidates of a step stay together
    # and need no move of their own where the lists are broadcast.
    lookup = hashed(
        steps.select("trajectory_id", "step", F.col(place).alias("src")), "trajectory_id", "step"
    )
    if k is not None and popular is not None:
        # 2k places suffice: at most k of them are in a list already.
        top = popular.orderBy(F.desc("checkin_cnt"), "node").limit(2 * k)
        fill = [row["node"] for row in top.select("node").collect()]
        item_type = shares.schema["item"].dataType
        fallback = F.array(*[F.lit(item) for item in fill]).cast(T.ArrayType(item_type))
        lists = listed.groupBy("src").agg(F.collect_list(F.struct("item", "score")).alias("_l"))
        filled = lookup.join(lists, "src", "left").withColumn(
            "_l", F.coalesce("_l", F.array().cast(lists.schema["_l"].dataType))
        )
        have = F.transform("_l", lambda x: x["item"])
        more = F.slice(F.array_except(fallback, have), F.lit(1), F.lit(k) - F.size("_l"))
        scored = F.transform(
            more, lambda x, i: F.struct(x.alias("item"), (-(i + 1)).cast("double").alias("score"))
        )
        return filled.select("trajectory_id", "step", F.inline(F.concat("_l", scored)))
    hot = hot_keys(lookup, ["src"], hot_rows)
    found = _of_place(lookup, listed, hot).select("trajectory_id", "step", "item", "score")
    if popular is None:
        return found
    return found.unionByName(_unlisted(lookup, listed, popular, hot))


def score_sequences(
    df: DataFrame, scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema
) -> DataFrame:
    """Run a caller's scorer over Arrow batches of sequences."""
    return df.mapInPandas(scorer, schema)
