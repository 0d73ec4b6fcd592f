"""Exact deduplication by a streaming state of digests.

A stateful stream groups rows by the SHA-256 of the text. Its state, kept on disk and
never expired, holds for each digest the largest document id so far, where that
document's content is (file and row) and the number of rows. Every row that meets an
existing digest is a hit, whose bytes are then compared with those of the row that
stays; texts that differ in spite of equal digests are grouped by their bytes.

Null counts as the empty text. Equal ids with equal texts are told apart by their
place, and one of them stays; a null id is smaller than any other. Only the named
columns are read, so others may have any names. An empty table gives no rows.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajflow.llm.components import written
from trajflow.session import scratch_path

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Each partition's store would otherwise reserve megabytes of disk ahead of its few rows.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _disk_backed(spark):
    """Streams started inside keep their state in RocksDB."""
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """All columns and each row's file and row, and the names these have. Data without files are written first."""
    names, taken = ["file", "row"], {c.lower() for c in docs.columns}
    while taken & set(names):
        names = [f"_{n}" for n in names]
    place = [F.col(f"_metadata.{c}").alias(n) for c, n in zip(("file_path", "row_index"), names)]
    try:
        return docs.select("*", *place), names
    except AnalysisException:
        path = scratch_path(docs.sparkSession, "located")
        docs.write.parquet(path)
        return docs.sparkSession.read.schema(docs.schema).parquet(path).select("*", *place), names


def update_state(spark, arrivals: str, schema: str, state: str, files_per_batch: int = 1000) -> DataFrame:
    """Let the stream take in the files of ``arrivals`` that it hasn't seen; returns the state.

    Calling it again with more files under ``arrivals`` goes on from the state. Per
    ``digest``: ``doc_id``, ``file``, ``row`` of the row that stays, and ``rows``.
    """
    with _disk_backed(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)
        grouped = stream.groupBy("digest").agg(
            F.max(F.struct("doc_id", "file", "row")).alias("top"), F.count("*").alias("rows")
        )
        query = (
            grouped.writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        held = spark.read.format("statestore").load(state)
    # The reader shows the aggregates in their order, under names of the engine's own.
    top, rows = (f"value.`{f.name}`" for f in held.schema["value"].dataType.fields)
    return held.select(
        "key.digest", F.col(f"{top}.doc_id").alias("keep_id"), F.col(f"{top}.file").alias("keep_file"),
        F.col(f"{top}.row").alias("keep_row"), F.col(rows).alias("rows"),
    )


def _decisions(rows: DataFrame, digest) -> DataFrame:
    """Result columns and place of each of ``rows`` (doc_id, text, file, row)."""
    spark = rows.sparkSession
    arrivals, state = scratch_path(spark, "arrivals"), scratch_path(spark, "state")
    schema = "digest binary, text_sha256 binary, doc_id long, file string, row long"
    both = [digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("text_sha256")]
    rows.select(*both, "doc_id", "file", "row").write.parquet(arrivals)
    seen = spark.read.schema(schema).parquet(arrivals)
    if seen.isEmpty():
        return _result(seen.withColumns({"keep_id": F.col("doc_id"), "rows": F.lit(1), "kept": F.lit(True)}))
    held = written(update_state(spark, arrivals, schema, state), "held")
    stays = (F.col("row") == F.col("keep_row")) & (F.col("file") == F.col("keep_file"))

    # Hits: the rows of digests seen more than once, whose bytes must be those of the row that stays.
    again = held.where("rows > 1")
    texts = written(rows.select(both[0], "doc_id", "text", "file", "row").join(again, "digest"), "hits")
    hits = texts.where(~stays).select("digest", "doc_id", "text", "file", "row")
    first = texts.where(stays).select("digest", F.col("text").alias("keep_text"))
    differ = written(hits.join(first, "digest").where("text != keep_text").drop("keep_text"), "differ")

    known = seen.join(held, "digest").withColumn("kept", stays)
    if differ.isEmpty():
        return _result(known)
    fewer = differ.groupBy("digest").agg(F.count("*").alias("others"))
    alike = known.join(differ.select("file", "row"), ["file", "row"], "left_anti").join(fewer, "digest", "left")
    alike = alike.withColumn("rows", F.col("rows") - F.coalesce("others", F.lit(0)))
    groups = differ.groupBy("digest", "text").agg(
        F.max(F.struct("doc_id", "file", "row")).alias("top"), F.count("*").alias("rows")
    )
    other = differ.join(groups, ["digest", "text"]).select(
        sha256(F.col("text")).alias("text_sha256"), "doc_id", F.col("top.doc_id").alias("keep_id"), "rows",
        ((F.col("row") == F.col("top.row")) & (F.col("file") == F.col("top.file"))).alias("kept"), "file", "row",
    )
    return _result(alike).unionByName(_result(other))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "keep_id", F.col("rows").cast("long").alias("group_size"), "kept",
        F.lower(F.hex("text_sha256")).alias("text_sha256"), "file", "row",
    )


def _narrow(placed: DataFrame, names: list[str], id_col: str, text_col: str) -> DataFrame:
    return placed.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.col(names[0]).alias("file"), F.col(names[1]).alias("row"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    placed, names = located(docs.select(id_col, text_col))
    return _decisions(_narrow(placed, names, id_col, text_col), digest).drop("file", "row")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    placed, names = located(docs)
    stay = _decisions(_narrow(placed, names, id_col, text_col), digest).where("kept").select("file", "row").toDF(*names)
    return placed.join(stay, names, "left_semi").select(*docs.columns)
