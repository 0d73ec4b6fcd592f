"""How filters of documents interact, over every order of applying them.

A document's failed filters are a mask of bits. Documents are counted by part and mask
once; those cells are all that the orders need. A recursive query then extends each
prefix of filters by every unused letter, joins the part's cells and carries the bits
applied so far, and each level emits the metrics of its step. Prefixes are shared by all
orders that begin with them, and what a level handles depends on the parts only.

Null text counts as empty. A null part is the empty one. A document is a copy if a
document with a smaller id has the same text (by SHA-256); rows with one id are not
copies of each other, and a null id is larger than any other. A label that is repeated
for an id counts as 1 if any of them is; ids without a label, or with null, count as 0.
Only the named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajflow.llm.components import written

#: ASCII white space between words.
SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text on its own; of equal texts all fail or none."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def _bits(filters: dict[str, Column]) -> Column:
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    return mask.cast("int")


def cells(docs: DataFrame, labels: DataFrame, filters=text_filters, part_col: str = "source", copies: str = "E"):
    """``part, mask, n, good, toxic`` as a table, and the filters' letters; the last marks copies of a smaller id's text."""
    text = F.coalesce("text", F.lit(""))
    letters = "".join(filters(text)) + copies
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), _bits(filters(text)).alias("mask"),
    )
    known = rows.join(flags, "doc_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")}
    )
    known = written(known, "masks")
    kind = ["part", "mask", "good", "toxic"]
    every = known.groupBy(*kind).agg(F.count("*").alias("n"))
    # Of equal texts those with the smallest id are no copies; equal texts fail the other filters alike.
    first = known.groupBy("digest").agg(F.min("doc_id").alias("least"))
    same = known.groupBy("digest", "doc_id", *kind).agg(F.count("*").alias("n")).withColumnRenamed("digest", "own")
    kept = same.join(first, (F.col("own") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("least")))
    kept = kept.groupBy(*kind).agg(F.sum("n").alias("n"))
    bit = 1 << (len(letters) - 1)
    copied = kept.select(*kind, (-F.col("n")).alias("n")).unionByName(every).withColumn("mask", F.col("mask") + bit)
    counted = (
        kept.unionByName(copied).groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
        )
        .where("n > 0")
    )
    return counted, letters


def _levels(spark, view: str, letters: str) -> DataFrame:
    """``part, prefix, applied, step`` and the step's metrics for every prefix of every order."""

    def total(value: str, condition: str) -> str:
        return f"aggregate(c.cells, 0L, (s, x) -> s + if({condition}, x.{value}, 0L))"

    before, fails = "(x.mask & l.applied) = 0", "(x.mask & l.bit) != 0"
    metrics = {
        "kept": total("n", "(x.mask & (l.applied | l.bit)) = 0"),
        "removed": total("n", f"{before} AND {fails}"),
        "redundant": total("n", f"NOT ({before}) AND {fails}"),
        "unique_fails": total("n", "x.mask = l.bit"),
        "good_lost": total("good", f"{before} AND {fails}"),
        "toxic_lost": total("toxic", f"{before} AND {fails}"),
    }
    bits = ", ".join(f"struct('{c}' AS letter, {1 << i} AS bit)" for i, c in enumerate(letters))
    unused = f"inline(filter(array({bits}), x -> (x.bit & applied) = 0)) AS (letter, bit)"
    return spark.sql(f"""
WITH RECURSIVE prefixes AS (
  SELECT part, '' AS prefix, 0 AS applied, 0 AS step, {", ".join(f"0L AS {m}" for m in metrics)} FROM {view}
  UNION ALL
  SELECT l.part, concat(l.prefix, l.letter), l.applied | l.bit, l.step + 1, {", ".join(metrics.values())}
  FROM (SELECT part, prefix, applied, step, {unused} FROM prefixes) AS l JOIN {view} AS c ON l.part = c.part
)
SELECT * FROM prefixes WHERE step > 0""")


def audit(docs: DataFrame, labels: DataFrame, filters=text_filters, part_col: str = "source", copies: str = "E") -> DataFrame:
    """One row per part, order of the filters and step, with that step's metrics."""
    spark = docs.sparkSession
    counted, letters = cells(docs, labels, filters, part_col, copies)
    packed = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    packed = written(packed, "cells")
    view, name = f"_filter_cells_{uuid.uuid4().hex}", "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    packed.createOrReplaceTempView(view)
    # What recursion returns grows with the parts, so no fixed number of rows may end it.
    spark.conf.set(name, "-1")
    try:
        levels = written(_levels(spark, view, letters), "prefixes")
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
        spark.catalog.dropTempView(view)

    whole = levels.where(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"))
    steps = whole.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    steps = steps.withColumn("prefix", F.substring("filter_order", F.lit(1), F.col("step")))
    rows = steps.join(levels.drop("applied", "step"), ["part", "prefix"])
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    rows = rows.withColumn("letter", letter)
    shapley = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
