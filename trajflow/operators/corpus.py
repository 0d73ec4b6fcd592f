"""Prompt and completion corpora from trajectories, and their scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajflow.functions.text import parse_prediction, two_decimals, two_decimals_each
from trajflow.operators.flow import ROW_ORDER
from trajflow.operators.ordered import dense_index, hot_keys, ordered

SAMPLE_KEYS = ["user_id", "trajectory_id"]
SHORTEST = 2


def allow_lists(df: DataFrame) -> DataFrame:
    """Distinct ``kind, value`` of place names and place types."""
    kinds = F.array(
        F.struct(F.lit("place_name").alias("kind"), F.col("POI_catname").alias("value")),
        F.struct(F.lit("place_type").alias("kind"), F.col("POI_category").alias("value")),
    )
    return df.select(F.inline(kinds)).filter(F.col("value").isNotNull()).distinct()


def _rows(df: DataFrame, allow: DataFrame | None) -> DataFrame:
    """Check-ins of complete keys with a flag for allowed name and type."""
    df = df.filter(F.col("user_id").isNotNull() & F.col("trajectory_id").isNotNull())
    named = F.col("POI_catname").isNotNull() & F.col("POI_category").isNotNull()
    if allow is None:
        return df.withColumn("_kept", named)

    def listed(kind: str, column: str, flag: str) -> DataFrame:
        values = allow.filter(F.col("kind") == kind).select(F.col("value").alias(column)).distinct()
        return values.withColumn(flag, F.lit(True))

    flagged = df.join(listed("place_name", "POI_catname", "_name"), "POI_catname", "left").join(
        listed("place_type", "POI_category", "_type"), "POI_category", "left"
    )
    return flagged.withColumn("_kept", F.col("_name").isNotNull() & F.col("_type").isNotNull())


def corpus_points(
    df: DataFrame,
    allow: DataFrame | None = None,
    order: Sequence[str] = ROW_ORDER,
    hot_rows: int | None = None,
) -> DataFrame:
    """The points of every sample: history at ``pos < n - 1``, the target at ``n - 1``.

    Points follow ``UTC_time``. Rows outside the allow-lists are no points, but
    the context day and time come from the trajectory's last row, kept or not.
    Trajectories with fewer than two points give no sample.
    """
    along = list(dict.fromkeys(["UTC_time", *order]))
    rows = _rows(df, allow).select(
        *SAMPLE_KEYS,
        *along,
        "longitude",
        "latitude",
        F.col("POI_catname").alias("place_name"),
        F.col("POI_category").alias("place_type"),
        "day_of_week",
        F.col("norm_in_day_time").alias("time_of_day"),
        "_kept",
    )
    hot = hot_keys(df.select(*SAMPLE_KEYS, *along), SAMPLE_KEYS, hot_rows)
    context = {"_context": F.max_by(F.struct("day_of_week", "time_of_day"), F.struct(*along))}
    kept = ordered(rows, SAMPLE_KEYS, along, totals=context, hot=hot).filter("_kept")
    numbered = ordered(kept, SAMPLE_KEYS, along, position="pos", size="n", hot=hot)
    return numbered.filter(F.col("n") >= SHORTEST).select(
        *SAMPLE_KEYS,
        "pos",
        "n",
        F.col("UTC_time").alias("timestamp"),
        "longitude",
        "latitude",
        "place_name",
        "place_type",
        "day_of_week",
        "time_of_day",
        F.col("_context.day_of_week").alias("context_day"),
        F.col("_context.time_of_day").alias("context_time"),
    )


def _visit() -> Column:
    return F.struct(
        "timestamp", "longitude", "latitude", "place_name", "place_type", "day_of_week", "time_of_day"
    )


def corpus_samples(points: DataFrame) -> DataFrame:
    """Nested ``input, output`` samples, one row per trajectory.

    A sample carries its whole history, so the row is as long as the trajectory.
    """
    gathered = points.groupBy(*SAMPLE_KEYS).agg(
        F.array_sort(F.collect_list(F.struct("pos", _visit().alias("v")))).alias("_p"),
        F.any_value(F.struct("context_day", "context_time")).alias("_c"),
    )
    visits = F.transform("_p", lambda p: p["v"])
    last = F.element_at("_v", -1)
    date = F.substring_index(last["timestamp"], "T", 1)
    return gathered.withColumn("_v", visits).select(
        F.struct(
            "user_id",
            "trajectory_id",
            F.slice("_v", F.lit(1), F.size("_v") - 1).alias("history"),
            F.struct(
                F.col("_c.context_day").alias("day_of_week"),
                F.col("_c.context_time").alias("time_of_day"),
                date.alias("date"),
            ).alias("context"),
        ).alias("input"),
        F.struct(
            F.struct(last["place_name"].alias("place_name"), last["place_type"].alias("place_type")).alias(
                "next_location"
            )
        ).alias("output"),
    )


def _quoted(text: Column) -> Column:
    """JSON text of a string."""
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def render_prompts(samples: DataFrame) -> DataFrame:
    """``user_id, trajectory_id, prompt, completion`` of nested samples."""
    history, context = F.col("input.history"), F.col("input.context")
    times = two_decimals_each(F.transform(history, lambda v: v["time_of_day"]))
    timed = samples.withColumn("_times", times).withColumn("_time", two_decimals(context["time_of_day"]))

    def line(visit: Column, i: Column) -> Column:
        return F.concat(
            F.lit("- Time: "),
            visit["timestamp"],
            F.lit(", Location: "),
            visit["place_name"],
            F.lit(" ("),
            visit["place_type"],
            F.lit("), Weekday: "),
            visit["day_of_week"].cast("string"),
            F.lit(", Time of day: "),
            F.get("_times", i),
        )

    # The wording of a prompt.
    prompt = F.concat(
        F.lit("User ID: "),
        F.col("input.user_id"),
        F.lit("\nTrajectory ID: "),
        F.col("input.trajectory_id"),
        F.lit("\n\nHistorical visits: \n"),
        F.array_join(F.transform(history, line), "\n"),
        F.lit("\n\nCurrent context:\n- Date: "),
        context["date"],
        F.lit("\n- Weekday: "),
        context["day_of_week"].cast("string"),
        F.lit("\n- Time of day: "),
        F.col("_time"),
        F.lit("\n\nPlease predict the user's next visit location."),
    )
    target = F.col("output.next_location")
    completion = F.concat(
        F.lit('{"place_name": '),
        _quoted(target["place_name"]),
        F.lit(', "place_type": '),
        _quoted(target["place_type"]),
        F.lit("}"),
    )
    return timed.select(
        F.col("input.user_id").alias("user_id"),
        F.col("input.trajectory_id").alias("trajectory_id"),
        prompt.alias("prompt"),
        completion.alias("completion"),
    )


def sample_count(df: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """One row ``total_samples``: trajectories with at least two points."""
    sizes = _rows(df, allow).filter("_kept").groupBy(*SAMPLE_KEYS).agg(F.count("*").alias("n"))
    return sizes.agg(F.count_if(F.col("n") >= SHORTEST).alias("total_samples"))


def corpus_totals(df: DataFrame) -> DataFrame:
    """``total, value`` rows for samples, users and trajectories."""
    counts = df.agg(
        F.count_distinct("user_id").alias("total_users"),
        F.count_distinct("trajectory_id").alias("total_trajectories"),
    )
    wide = [
        (sample_count(df), ["total_samples"]),
        (counts, ["total_users", "total_trajectories"]),
    ]
    rows = [
        row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("total"), F.col(c).alias("value")) for c in names])))
        for row, names in wide
    ]
    return rows[0].unionByName(rows[1])


#: Allow-list entries in one row of the metadata.
CHUNK = 1_000
TOTALS = ("total_samples", "total_users", "total_trajectories")


def corpus_metadata(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The metadata document in parts: ``kind, chunk, values, total``.

    The sorted allow-lists come in numbered rows of at most ``chunk`` values,
    the totals in one row each; only ``write_metadata`` joins them.
    """
    listed = dense_index(allow_lists(df), ["kind", "value"], "_i")
    first = listed.groupBy("kind").agg(F.min("_i").alias("_first"))
    placed = listed.join(first, "kind").withColumn("chunk", F.floor((F.col("_i") - F.col("_first")) / chunk).cast("int"))
    parts = placed.groupBy("kind", "chunk").agg(F.sort_array(F.collect_list("value")).alias("values"))
    none = F.lit(None)
    lists = parts.select("kind", "chunk", "values", none.cast("long").alias("total"))
    totals = corpus_totals(df).select(
        F.col("total").alias("kind"), F.lit(0).alias("chunk"), none.cast("array<string>").alias("values"),
        F.col("value").alias("total"),
    )
    return lists.unionByName(totals)


def metadata_allow_lists(metadata: DataFrame) -> DataFrame:
    """``kind, value`` rows of the metadata."""
    return metadata.select("kind", F.explode("values").alias("value"))


def allow_list_texts(metadata: DataFrame) -> DataFrame:
    """The two allow-lists as JSON text for a prompt; one text each is the result."""

    def text(kind: str) -> Column:
        inner = F.regexp_extract(F.to_json("values"), r"(?s)^\[(.*)\]$", 1)
        mine = F.when(F.col("kind") == kind, F.struct("chunk", inner.alias("text")))
        ordered_ = F.transform(F.array_sort(F.collect_list(mine)), lambda c: c["text"])
        return F.concat(F.lit("["), F.array_join(ordered_, ","), F.lit("]"))

    return metadata.filter(F.col("values").isNotNull()).agg(
        text("place_name").alias("place_names"), text("place_type").alias("place_types")
    )


def sample_rows(df: DataFrame, n: int, seed: int = 0, keys: Sequence[str] = SAMPLE_KEYS) -> DataFrame:
    """``n`` rows without replacement (all, if fewer), the same for the same seed."""
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.orderBy(drawn, *keys).limit(n)


def score_predictions(
    expected: DataFrame, predictions: DataFrame, keys: Sequence[str] = SAMPLE_KEYS
) -> DataFrame:
    """Readable predictions with the expected place and ``correct``.

    ``expected`` has the keys with ``place_name, place_type``, ``predictions`` the
    keys with ``raw``. Text that is not one JSON object takes no part.
    """
    read = predictions.withColumn("_p", parse_prediction("raw")).filter(F.col("_p.parsed"))
    both = expected.join(
        read.select(
            *keys,
            "raw",
            F.col("_p.place_name").alias("predicted_name"),
            F.col("_p.place_type").alias("predicted_type"),
        ),
        list(keys),
    )
    correct = F.col("predicted_name").eqNullSafe(F.col("place_name")) & F.col("predicted_type").eqNullSafe(
        F.col("place_type")
    )
    return both.withColumn("correct", correct)


def accuracy(scored: DataFrame) -> DataFrame:
    """One row ``total, correct, accuracy``; the accuracy of nothing is 0."""
    counts = scored.agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
    ratio = F.try_divide(F.col("correct").cast("double"), F.col("total").cast("double"))
    return counts.withColumn("accuracy", F.coalesce(ratio, F.lit(0.0)))


def failures(scored: DataFrame, prompts: DataFrame, keys: Sequence[str] = SAMPLE_KEYS) -> DataFrame:
    """Wrong answers of :func:`score_predictions` with the ``prompt`` and expected ``completion`` of their sample."""
    return scored.filter(~F.col("correct")).join(prompts.select(*keys, "prompt", "completion"), list(keys), "left")
