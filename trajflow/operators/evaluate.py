"""Ranking metrics, losses and model selection.

``scores`` is ``traj_id, step, item, score`` with one row per candidate,
``labels`` is ``traj_id, step, item``. Ranks order by score, then by smaller item.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajflow.operators.ordered import hot_keys, ordered

CUTOFFS = (1, 5, 10, 20)
LIST_LENGTH = 20
IGNORED = -1
TIME_WEIGHT = 10
# Fixed values of the monitoring score.
MONITOR_WEIGHTS = {"top1": 0.3, "top5": 0.2, "mrr": 0.2, "ndcg20": 0.2, "recall20": 0.1}


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best items of every step with their rank ``rk``."""
    if k < 1:
        raise ValueError("k must be at least 1")
    best = Window.partitionBy("traj_id", "step").orderBy(F.desc("score"), "item")
    return scores.withColumn("rk", F.row_number().over(best)).filter(F.col("rk") <= k)


def argmax_decode(scores: DataFrame) -> DataFrame:
    """``traj_id, step, item``: the best item of every step."""
    return top_k(scores, 1).select("traj_id", "step", "item")


def label_stats(
    scores: DataFrame, labels: DataFrame, loss: bool = False, salts: int | None = None
) -> DataFrame:
    """Per labelled step the label's score, its rank and, with ``loss``, log-sum-exp.

    The rank is one more than the number of better candidates, so nothing is
    sorted. A step has one row per item at most and its candidates meet in one
    task, moved once. Where item lists are too long for that, ``salts`` spreads
    a step over so many tasks, at the price of moving the scores twice.
    A label without a score has no rank.
    """
    spread = _spread_candidates(scores, labels, loss, salts) if salts else _candidates(scores, labels, loss)
    ahead = (F.col("score") > F.col("label_score")) | (
        (F.col("score") == F.col("label_score")) & (F.col("item") < F.col("label"))
    )
    part = ["_salt"] if salts else []
    keys = ["traj_id", "step", "label", "label_score", *(["_top"] if loss else [])]
    measures = {"_ahead": F.count_if(ahead), "candidates": F.count("item")}
    if loss:
        measures["_exp"] = F.sum(F.exp(F.col("score") - F.col("_top")))
    counted = spread.groupBy(*keys, *part).agg(*[m.alias(c) for c, m in measures.items()])
    if salts:
        counted = counted.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measures])
    rank = F.when(F.col("label_score").isNotNull(), F.col("_ahead") + 1)
    out = ["traj_id", "step", "label", "label_score", rank.alias("rank"), "candidates"]
    if loss:
        out.append((F.col("_top") + F.ln("_exp")).alias("logsumexp"))
    return counted.select(*out)


def _candidates(scores: DataFrame, labels: DataFrame, loss: bool) -> DataFrame:
    """Every label with all candidates of its step; one move of the scores."""
    step = Window.partitionBy("traj_id", "step", "label")
    both = labels.withColumnRenamed("item", "label").join(scores, ["traj_id", "step"], "left")
    found = F.max(F.when(F.col("item") == F.col("label"), F.col("score"))).over(step)
    extra = [F.max("score").over(step).alias("_top")] if loss else []
    return both.select("*", found.alias("label_score"), *extra)


def _spread_candidates(scores: DataFrame, labels: DataFrame, loss: bool, salts: int) -> DataFrame:
    """The same rows with a step's candidates in ``salts`` parts."""
    keys = ["traj_id", "step"]
    own = scores.select(*keys, "item", F.col("score").alias("label_score"))
    known = labels.join(own, [*keys, "item"], "left").withColumnRenamed("item", "label")
    if loss:
        known = known.join(scores.groupBy(*keys).agg(F.max("score").alias("_top")), keys, "left")
    copies = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = scores.withColumn("_salt", F.pmod(F.xxhash64("item"), F.lit(salts)).cast("int"))
    return copies.join(salted, [*keys, "_salt"], "left")


def _within(k: int) -> Column:
    return F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))


def _reciprocal() -> Column:
    return F.coalesce(1.0 / F.col("rank"), F.lit(0.0))


def metrics_all_steps(
    scores: DataFrame, labels: DataFrame, cutoffs: Sequence[int] = CUTOFFS, k: int = LIST_LENGTH
) -> DataFrame:
    """One row: top-k accuracies, ``map<k>`` and ``mrr`` averaged over all steps.

    ``missing`` counts labels that no candidate matches; they score 0.
    """
    if min(*cutoffs, k) < 1:
        raise ValueError("k must be at least 1")
    stats = label_stats(scores, labels)
    return stats.agg(
        *[F.avg(_within(c)).alias(f"top{c}") for c in cutoffs],
        F.avg(_within(k) * _reciprocal()).alias(f"map{k}"),
        F.avg(_reciprocal()).alias("mrr"),
        F.count_if(F.col("rank").isNull()).alias("missing"),
    )


def metrics_last_step(
    scores: DataFrame, labels: DataFrame, cutoffs: Sequence[int] = CUTOFFS, k: int = LIST_LENGTH
) -> DataFrame:
    """Per trajectory the metrics of its last step.

    NDCG and recall compare the last step's best ``k`` items with all distinct
    labels of the trajectory.
    """
    if min(*cutoffs, k) < 1:
        raise ValueError("k must be at least 1")
    last = labels.groupBy("traj_id").agg(F.max("step").alias("step"), F.max_by("item", "step").alias("item"))
    stats = label_stats(scores, last).select("traj_id", "rank")
    # Only k rows of a trajectory leave the tasks that hold its candidates.
    listed = top_k(scores.join(last.select("traj_id", "step"), ["traj_id", "step"], "left_semi"), k)
    relevant = labels.select("traj_id", "item", F.lit(True).alias("_relevant")).distinct()
    gain = 1.0 / F.log2(F.col("rk") + 1)
    found = (
        listed.join(relevant, ["traj_id", "item"])
        .groupBy("traj_id")
        .agg(F.sum(gain).alias("_dcg"), F.count("*").alias("_hits"))
    )
    sizes = relevant.groupBy("traj_id").agg(F.count("*").alias("_size"))
    joined = sizes.join(stats, "traj_id", "left").join(found, "traj_id", "left").fillna(0, ["_dcg", "_hits"])
    ideal, total = [], 0.0
    for r in range(1, k + 1):
        total += 1.0 / math.log2(r + 1)
        ideal.append(F.lit(total))
    best_gain = F.element_at(F.array(*ideal), F.least(F.col("_size"), F.lit(k)).cast("int"))
    return joined.select(
        "traj_id",
        *[_within(c).alias(f"top{c}") for c in cutoffs],
        (_within(k) * _reciprocal()).alias(f"map{k}"),
        _reciprocal().alias("mrr"),
        (F.col("_dcg") / best_gain).alias(f"ndcg{k}"),
        (F.col("_hits") / F.col("_size")).alias(f"recall{k}"),
    )


def cross_entropy(scores: DataFrame, labels: DataFrame, ignored=IGNORED) -> DataFrame:
    """One row ``loss, steps``; labels equal to ``ignored`` take no part."""
    kept = labels.filter(F.col("item") != F.lit(ignored).cast(labels.schema["item"].dataType))
    stats = label_stats(scores, kept, loss=True)
    return stats.agg(
        F.avg(F.col("logsumexp") - F.col("label_score")).alias("loss"), F.count("label_score").alias("steps")
    )


def masked_mse(df: DataFrame, prediction: str, target: str, mask: float = IGNORED) -> DataFrame:
    """One row ``loss``: mean squared error where the target is not ``mask``."""
    error = F.col(prediction) - F.col(target)
    return df.filter(F.col(target) != mask).agg(F.avg(error * error).alias("loss"))


def total_loss(time_weight: float = TIME_WEIGHT) -> Column:
    """Sum of the six losses, the time loss weighted."""
    return (
        F.col("poi_loss")
        + F.col("time_loss") * time_weight
        + F.col("cat_loss")
        + F.col("lat_loss")
        + F.col("lon_loss")
        + F.col("category_loss")
    )


def epoch_metrics(
    samples: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("epoch", "split"),
    batch: str = "batch",
    per_sample: bool = False,
) -> DataFrame:
    """Mean over the batches of each epoch, every batch counting the same.

    ``per_sample`` weighs samples the same instead.
    """
    if not per_sample:
        samples = samples.groupBy(*keys, batch).agg(*[F.avg(c).alias(c) for c in columns])
    return samples.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def running_metrics(
    batches: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("epoch", "split"),
    batch: str = "batch",
    hot_rows: int | None = None,
) -> DataFrame:
    """Per batch the mean of all batches of the epoch so far."""
    hot = hot_keys(batches.select(*keys, batch), list(keys), hot_rows)
    sums = ordered(
        batches.select(*keys, batch, *columns),
        list(keys),
        [batch],
        position="_at",
        running={f"_sum_{c}": c for c in columns},
        hot=hot,
    )
    means = [(F.col(f"_sum_{c}") / (F.col("_at") + 1)).alias(c) for c in columns]
    return sums.select(*keys, batch, *means)


def loss_balance(poi: Column, time: Column, name: Column) -> Column:
    """1 for equal losses, less the more their shares differ from a third each."""
    whole = poi + time + name
    off = [F.abs(F.try_divide(x, whole) - 1.0 / 3.0) for x in (poi, time, name)]
    return F.coalesce(F.greatest(F.lit(0.0), 1 - (off[0] + off[1] + off[2]) / 2), F.lit(0.0))


def monitor_scores(batches: DataFrame) -> DataFrame:
    """``epoch, base_score, stability, loss_balance, monitor_score`` from validation batches."""
    names = [*MONITOR_WEIGHTS, "poi_loss", "time_loss", "cat_loss"]
    epochs = batches.groupBy("epoch").agg(
        *[F.avg(c).alias(c) for c in names],
        *[F.stddev_pop(c).alias(f"_dev_{c}") for c in ("top1", "top5", "mrr")],
    )
    base = F.lit(0.0)
    for c, w in MONITOR_WEIGHTS.items():
        base = base + F.col(c) * w
    deviation = F.col("_dev_top1") + F.col("_dev_top5") + F.col("_dev_mrr")
    stability = F.greatest(F.lit(0.0), 1 - deviation / 3)
    balance = loss_balance(F.col("poi_loss"), F.col("time_loss"), F.col("cat_loss"))
    scored = epochs.select(
        "epoch", base.alias("base_score"), stability.alias("stability"), balance.alias("loss_balance")
    )
    score = F.col("base_score") * (1 + F.col("stability")) * (1 + F.col("loss_balance"))
    return scored.withColumn("monitor_score", score)


def best_epoch(scored: DataFrame, score: str = "monitor_score") -> DataFrame:
    """The row of the highest score; equal scores go to the later epoch."""
    valid = scored.filter(F.col(score).isNotNull() & ~F.isnan(score))
    best = F.max_by(F.struct(*scored.columns), F.struct(score, "epoch")).alias("b")
    return valid.agg(best).filter(F.col("b").isNotNull()).select("b.*")


def best_record(scored: DataFrame, epochs: DataFrame) -> DataFrame:
    """The best epoch's own metrics of both splits, one row per split."""
    return epochs.join(best_epoch(scored).select("epoch"), "epoch", "left_semi")


def metric_series(epochs: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """``split, metric, values``: one value per epoch, in epoch order.

    Values are rounded half to even.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns])
    rows = epochs.select("epoch", "split", F.inline(pairs))
    listed = F.array_sort(F.collect_list(F.struct("epoch", F.bround("value", digits).alias("value"))))
    return rows.groupBy("split", "metric").agg(F.transform(listed, lambda x: x["value"]).alias("values"))
