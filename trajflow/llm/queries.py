"""The operators as named queries over the tables of a folder, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajflow.llm import (
    alignment, exact, fingerprints, interactions, language, minhash, mixing, packing, quality, secrets, substring,
    suffixes, tokenize,
)

SEQUENCE = 2048
END_ID = 0
LEAST_QUALITY = 0.3


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def fold(parts: int) -> Column:
    """A document's fold by the CRC-32 of its id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def quality_weights(spark: SparkSession, folder: str, docs: DataFrame):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality.fit(quality.training_rows(docs, labels, "quality", fold(5) != 0))


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, folder))


def op2_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(documents(spark, folder))


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.scores(documents(spark, folder), fold(5) != 1)


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tokenize.sequences(documents(spark, folder), END_ID, SEQUENCE), SEQUENCE)


def op5_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint(documents(spark, folder))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, folder))


def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, folder), size=3, percent=85, bands=30)


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = language.identify(docs, language.train(docs.where(fold(4) != 2)), spans=False)
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    scored = quality.score(docs, quality_weights(spark, folder, docs))
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    predicted = (F.col("score") >= LEAST_QUALITY).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.digests(documents(spark, folder))


def op11_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.remove_repeats(documents(spark, folder))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select(
        "doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_filter_interaction_audit(spark: SparkSession, folder: str) -> DataFrame:
    return interactions.audit(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op13_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(documents(spark, folder), digest=True).withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_secret_scans, op3_lm_scoring, op4_best_fit_packing, op5_document_fingerprints,
        op6_substring_dedup, op7_minhash_near_dedup, op8_language_id, op9_quality_classifier, op10_bpe,
        op11_suffix_array_dedup, op12_filter_interaction_audit, op13_cross_tokenizer_alignment,
    )
}

SQL = {
    "op1_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)""",
    "op12_filter_interaction_audit": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
lab AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]+', '', 'g')) > 5 * length(w.t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id IS DISTINCT FROM least THEN 16 ELSE 0 END AS mask
  FROM w JOIN first USING (t) LEFT JOIN lab ON lab.doc_id = w.doc_id),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM m GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
orders AS (SELECT '' AS o, 0 AS applied UNION ALL SELECT o || letter, applied | bit FROM orders, letters WHERE applied & bit = 0),
steps AS (SELECT o AS filter_order, CAST(s AS INTEGER) AS step, letter, bit,
    (SELECT CAST(coalesce(sum(p.bit), 0) AS INTEGER) FROM letters p WHERE strpos(o, p.letter) < s) AS before
  FROM orders, range(1, 6) AS r(s), letters WHERE length(o) = 5 AND letter = o[s]),
res AS (SELECT part, filter_order, step, letter,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM res""",
}
