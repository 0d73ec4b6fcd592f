"""From raw documents to packed training sequences, in five stages over all documents.

Each stage is one operator of ``trajflow.llm`` applied to everything its predecessor
kept; its result is written to the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajflow.llm import exact, minhash, packing, quality, queries, secrets, tokenize
from trajflow.llm.components import written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, queries.quality_weights(spark, sf_dir, docs), queries.LEAST_QUALITY)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the smallest id stays."""
    return minhash.deduplicated(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span is replaced; all documents stay, and ``n_chars`` follows the text."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.pack(tokenize.sequences(docs, queries.END_ID, queries.SEQUENCE), queries.SEQUENCE)


STAGES = [
    ("quality", quality_filter),
    ("exact", exact_dedup),
    ("near", near_dedup),
    ("secrets", secret_redaction),
    ("packing", packed_sequences),
]

#: The classifier, compression novelty and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
