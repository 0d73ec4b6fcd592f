"""Queries over ranking metrics, losses and model selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajflow.operators import evaluate, sequences
from trajflow.plans.registry import cte, query, sql
from trajflow.plans.steps import SCORES, TRAIN, all_steps, candidates
from trajflow.plans.testdata import table

cte("rnk", "SELECT *, row_number() OVER (PARTITION BY traj_id, step ORDER BY score DESC, item) AS rk FROM sco")
cte(
    "lrk",
    """SELECT l.traj_id, l.step, l.item, r.rk, r.score FROM lab l
    LEFT JOIN rnk r ON r.traj_id = l.traj_id AND r.step = l.step AND r.item = l.item""",
)
RANKS = SCORES + " rnk lrk"


def _hit(k: int) -> str:
    return f"CASE WHEN rk <= {k} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


MAP20 = "CASE WHEN rk <= 20 THEN CAST(1 AS DOUBLE) / rk ELSE CAST(0 AS DOUBLE) END"
MRR = "coalesce(CAST(1 AS DOUBLE) / rk, CAST(0 AS DOUBLE))"


def _rounded(df, columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("argmax_decode", sql(RANKS, "SELECT traj_id, step, item FROM rnk WHERE rk = 1"))
def argmax_decode(spark, sf_dir):
    scores, _ = candidates(spark, sf_dir)
    return evaluate.argmax_decode(scores)


@query(
    "label_ranks",
    sql(RANKS, "SELECT traj_id, step, item AS label, round(score, 9) AS label_score, CAST(rk AS DOUBLE) AS rank FROM lrk"),
)
def label_ranks(spark, sf_dir):
    stats = evaluate.label_stats(*candidates(spark, sf_dir))
    return stats.select(
        "traj_id", "step", "label", F.round("label_score", 9).alias("label_score"), F.col("rank").cast("double").alias("rank")
    )


@query(
    "metrics_all_steps",
    sql(
        RANKS,
        "SELECT "
        + ", ".join(f"round(avg({_hit(k)}), 9) AS top{k}" for k in evaluate.CUTOFFS)
        + f", round(avg({MAP20}), 9) AS map20, round(avg({MRR}), 9) AS mrr,"
        + " count(*) FILTER (rk IS NULL) AS missing FROM lrk",
    ),
)
def metrics_all_steps(spark, sf_dir):
    row = evaluate.metrics_all_steps(*candidates(spark, sf_dir))
    return _rounded(row, [c for c in row.columns if c != "missing"])


cte("lst", "SELECT traj_id, max(step) AS step FROM lab GROUP BY traj_id")
cte("rel", "SELECT DISTINCT traj_id, item FROM lab")
cte("rct", "SELECT traj_id, count(*) AS c FROM rel GROUP BY traj_id")
cte(
    "hit",
    """SELECT r.traj_id, sum(CAST(1 AS DOUBLE) / log2(rk + 1)) AS dcg, count(*) AS hits
    FROM rnk r JOIN lst USING (traj_id, step) JOIN rel e ON e.traj_id = r.traj_id AND e.item = r.item
    WHERE rk <= 20 GROUP BY r.traj_id""",
)
cte(
    "lsm",
    "SELECT l.traj_id, "
    + ", ".join(f"{_hit(k)} AS top{k}" for k in evaluate.CUTOFFS)
    + f""", {MAP20} AS map20, {MRR} AS mrr,
      coalesce(dcg, 0) / (SELECT sum(CAST(1 AS DOUBLE) / log2(i + 1)) FROM range(1, 21) t(i) WHERE i <= c) AS ndcg20,
      CAST(coalesce(hits, 0) AS DOUBLE) / c AS recall20
    FROM lrk l JOIN lst USING (traj_id, step) JOIN rct ON rct.traj_id = l.traj_id
    LEFT JOIN hit ON hit.traj_id = l.traj_id""",
)
LAST = RANKS + " lst rel rct hit lsm"
LAST_COLUMNS = [f"top{k}" for k in evaluate.CUTOFFS] + ["map20", "mrr", "ndcg20", "recall20"]


@query(
    "metrics_last_step",
    sql(LAST, "SELECT traj_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in LAST_COLUMNS) + " FROM lsm"),
)
def metrics_last_step(spark, sf_dir):
    return _rounded(evaluate.metrics_last_step(*candidates(spark, sf_dir)), LAST_COLUMNS)


@query(
    "cross_entropy",
    sql(
        RANKS,
        """SELECT round(avg(top + ln(e) - score), 8) AS loss, count(score) AS steps FROM (
          SELECT traj_id, step, any_value(top) AS top, sum(exp(score - top)) AS e FROM (
            SELECT *, max(score) OVER (PARTITION BY traj_id, step) AS top FROM sco) GROUP BY traj_id, step)
        JOIN lrk USING (traj_id, step) WHERE item <> -1""",
    ),
)
def cross_entropy(spark, sf_dir):
    return _rounded(evaluate.cross_entropy(*candidates(spark, sf_dir)), ["loss"], 8)


@query(
    "masked_mse",
    sql(TRAIN, "SELECT round(avg((in_time - label_time) * (in_time - label_time)), 9) AS loss FROM trs"),
)
def masked_mse(spark, sf_dir):
    """Over padded batches; the padding must not count."""
    padded = sequences.padded_batches(all_steps(spark, sf_dir))
    return _rounded(evaluate.masked_mse(padded, "in_time", "label_time"), ["loss"])


LOSSES = ["poi_loss", "time_loss", "cat_loss", "lat_loss", "lon_loss", "category_loss"]
RATES = ["top1", "top5", "top10", "top20", "map20", "mrr", "ndcg20", "recall20"]
MEASURES = {
    "top1": "l_discount * 5",
    "top5": "l_discount * 7",
    "top10": "l_discount * 8",
    "top20": "l_discount * 9",
    "map20": "l_tax * 6",
    "mrr": "l_tax * 7",
    "ndcg20": "l_tax * 8",
    "recall20": "l_tax * 9",
    "poi_loss": "l_quantity / 10",
    "time_loss": "l_tax * 2",
    "cat_loss": "l_quantity / 20",
    "lat_loss": "l_discount / 2",
    "lon_loss": "l_discount / 3",
    "category_loss": "l_quantity / 40",
}


def training_log(spark, sf_dir):
    """Sample-level measures taken from line items: month as epoch, supplier as batch."""
    return table(spark, sf_dir, "lineitem").select(
        F.month("l_shipdate").alias("epoch"),
        (F.col("l_suppkey") % 97).alias("batch"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("val")).otherwise(F.lit("train")).alias("split"),
        *[F.expr(e).alias(c) for c, e in MEASURES.items()],
    )


cte(
    "log",
    """SELECT CAST(month(l_shipdate) AS INTEGER) AS epoch, l_suppkey % 97 AS batch,
      CASE WHEN l_linenumber % 2 = 0 THEN 'val' ELSE 'train' END AS split, """
    + ", ".join(f"{e} AS {c}" for c, e in MEASURES.items())
    + " FROM lineitem",
)
MEANS = ", ".join(f"avg({c}) AS {c}" for c in MEASURES)
cte("btc", f"SELECT epoch, split, batch, {MEANS} FROM log GROUP BY epoch, split, batch")
cte("epo", f"SELECT epoch, split, {MEANS} FROM btc GROUP BY epoch, split")
TOTAL = "poi_loss + time_loss * 10 + cat_loss + lat_loss + lon_loss + category_loss"


def batch_log(spark, sf_dir):
    return training_log(spark, sf_dir).groupBy("epoch", "split", "batch").agg(*[F.avg(c).alias(c) for c in MEASURES])


def epoch_log(spark, sf_dir):
    return evaluate.epoch_metrics(training_log(spark, sf_dir), list(MEASURES))


def _rounds(columns, digits=8) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


@query(
    "epoch_metrics",
    sql("log btc epo", f"SELECT epoch, split, {_rounds(MEASURES)}, round({TOTAL}, 8) AS loss FROM epo"),
)
def epoch_metrics(spark, sf_dir):
    rows = epoch_log(spark, sf_dir).withColumn("loss", evaluate.total_loss())
    return _rounded(rows, [*MEASURES, "loss"], 8)


@query(
    "epoch_metrics_per_sample",
    sql("log", f"SELECT epoch, split, {', '.join(f'round(avg({c}), 8) AS {c}' for c in MEASURES)} FROM log GROUP BY epoch, split"),
)
def epoch_metrics_per_sample(spark, sf_dir):
    return _rounded(
        evaluate.epoch_metrics(training_log(spark, sf_dir), list(MEASURES), per_sample=True), MEASURES, 8
    )


@query(
    "running_metrics",
    sql(
        "log btc",
        """SELECT epoch, split, batch, round(avg(top1) OVER w, 8) AS top1, round(avg(mrr) OVER w, 8) AS mrr,
          round(avg(poi_loss) OVER w, 8) AS poi_loss FROM btc
        WINDOW w AS (PARTITION BY epoch, split ORDER BY batch ROWS UNBOUNDED PRECEDING)""",
    ),
)
def running_metrics(spark, sf_dir):
    columns = ["top1", "mrr", "poi_loss"]
    return _rounded(evaluate.running_metrics(batch_log(spark, sf_dir), columns), columns, 8)


@query(
    "running_metrics_hot",
    sql(
        "log btc",
        """SELECT epoch, split, batch, round(avg(top1) OVER w, 8) AS top1 FROM btc
        WINDOW w AS (PARTITION BY epoch, split ORDER BY batch ROWS UNBOUNDED PRECEDING)""",
    ),
)
def running_metrics_hot(spark, sf_dir):
    """The same means with every epoch of over 60 batches cut into ranges."""
    return _rounded(evaluate.running_metrics(batch_log(spark, sf_dir), ["top1"], hot_rows=60), ["top1"], 8)


_SHARE = "abs({c} / nullif(poi_loss + time_loss + cat_loss, 0) - CAST(1 AS DOUBLE) / 3)"
cte(
    "mon",
    f"""SELECT epoch, base AS base_score, stability, balance AS loss_balance,
      base * (1 + stability) * (1 + balance) AS monitor_score FROM (
        SELECT epoch, stability,
          {' + '.join(f'{c} * CAST({w} AS DOUBLE)' for c, w in evaluate.MONITOR_WEIGHTS.items())} AS base,
          coalesce(greatest(CAST(0 AS DOUBLE), 1 - ({' + '.join(_SHARE.format(c=c) for c in ('poi_loss', 'time_loss', 'cat_loss'))}) / 2), 0) AS balance
        FROM (SELECT epoch, {MEANS},
            greatest(CAST(0 AS DOUBLE), 1 - (stddev_pop(top1) + stddev_pop(top5) + stddev_pop(mrr)) / 3) AS stability
          FROM btc WHERE split = 'val' GROUP BY epoch))""",
)
MONITOR = ["base_score", "stability", "loss_balance", "monitor_score"]


def monitored(spark, sf_dir):
    return evaluate.monitor_scores(batch_log(spark, sf_dir).filter(F.col("split") == "val"))


@query("monitor_scores", sql("log btc mon", f"SELECT epoch, {_rounds(MONITOR)} FROM mon"))
def monitor_scores(spark, sf_dir):
    return _rounded(monitored(spark, sf_dir), MONITOR, 8)


@query(
    "best_epoch",
    sql("log btc mon", f"SELECT epoch, {_rounds(MONITOR)} FROM mon ORDER BY monitor_score DESC, epoch DESC LIMIT 1"),
)
def best_epoch(spark, sf_dir):
    return _rounded(evaluate.best_epoch(monitored(spark, sf_dir)), MONITOR, 8)


@query(
    "best_record",
    sql(
        "log btc epo mon",
        f"""SELECT epoch, split, {_rounds(MEASURES)} FROM epo
        WHERE epoch = (SELECT epoch FROM mon ORDER BY monitor_score DESC, epoch DESC LIMIT 1)""",
    ),
)
def best_record(spark, sf_dir):
    return _rounded(evaluate.best_record(monitored(spark, sf_dir), epoch_log(spark, sf_dir)), MEASURES, 8)


@query(
    "metric_series",
    sql(
        "log btc epo",
        " UNION ALL ".join(
            f"SELECT split, '{c}' AS metric, CAST(row_number() OVER (PARTITION BY split ORDER BY epoch) - 1 AS INTEGER) AS pos,"
            f" round_even({c}, 4) AS value FROM epo"
            for c in ["top1", "mrr", "poi_loss", "time_loss"]
        ),
    ),
)
def metric_series(spark, sf_dir):
    series = evaluate.metric_series(epoch_log(spark, sf_dir), ["top1", "mrr", "poi_loss", "time_loss"])
    return series.select("split", "metric", F.posexplode("values").alias("pos", "value"))
