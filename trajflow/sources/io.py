"""Readers and writers for check-ins, graphs, corpora and metric records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajflow.operators.flow import dense_rows, indexed_edges, node_index
from trajflow.operators.corpus import CHUNK, TOTALS
from trajflow.operators.ordered import dense_index
from trajflow.sources.schema import (
    CHECKIN,
    CHECKIN_POSITIONED,
    METADATA,
    NODE,
    SAMPLE,
    TRAINING_LINE,
    require_columns,
)


def read_checkins(
    spark: SparkSession, path: str, fmt: str = "csv", order: Sequence[str] = ("row_pos",)
) -> DataFrame:
    """Check-ins with the declared types.

    Without a ``row_pos`` column the position is the place in the file, which
    only one file can give: for several files name order columns that exist.
    """
    if fmt == "parquet":
        return require_columns(spark.read.parquet(path), *CHECKIN.names, *order)
    if fmt != "csv":
        raise ValueError(f"unknown check-in format: {fmt}")
    header = spark.read.option("header", True).csv(path).columns
    positioned = "row_pos" in header
    known = {f.name: f for f in CHECKIN_POSITIONED.fields}
    missing = [c for c in CHECKIN.names if c not in header and c != "POI_category"]
    if missing:
        raise ValueError(f"columns missing from {path}: {', '.join(missing)}")
    ddl = ", ".join(
        f"`{c}` {known[c].dataType.simpleString() if c in known else 'string'}" for c in header
    )
    df = spark.read.option("header", True).option("mode", "FAILFAST").schema(ddl).csv(path)
    if "POI_category" not in header:
        df = df.withColumn("POI_category", F.lit(None).cast("string"))
    if not positioned and "row_pos" in order:
        if len(df.inputFiles()) > 1 or df.rdd.getNumPartitions() > 1:
            raise ValueError("several files or splits have no common row order: give order columns")
        df = df.withColumn("row_pos", F.monotonically_increasing_id())
    return require_columns(df, *order)


def write_checkins(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown check-in format: {fmt}")


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Quoted CSV with a header, so names may contain commas."""
    nodes.write.option("header", True).option("quoteAll", True).csv(path)


def read_nodes(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Node table columns of any of the flow maps, typed by name."""
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f.dataType.simpleString() for f in NODE.fields}
    ddl = ", ".join(f"`{c}` {known.get(c, 'string')}" for c in header)
    df = spark.read.option("header", True).option("mode", "FAILFAST").schema(ddl).csv(path)
    return df if columns is None else require_columns(df, *columns).select(*columns)


def read_node_variant(
    spark: SparkSession, path: str, variant: int, features: Sequence[str]
) -> DataFrame:
    """The first three, one or two of ``features`` for variant 1, 2 or any other."""
    width = {1: 3, 2: 1}.get(variant, 2)
    return read_nodes(spark, path, features[:width])


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_adjacency(
    edges: DataFrame, nodes: DataFrame, path: str, weight: str = "weight"
) -> None:
    """Dense comma-separated rows in node order, without a header."""
    rows = dense_rows(edges, nodes, weight).orderBy("idx")
    rows.select(F.array_join(F.transform("row", lambda x: x.cast("string")), ",")).write.text(path)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """``src_idx, dst_idx, weight`` of the non-zero cells of a dense matrix.

    Rows are numbered by file name, place of the block in the file and line.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        "value",
    )
    rows = dense_index(lines, ["_file", "_block", "_line"], "src_idx")
    cells = rows.select("src_idx", F.posexplode(F.split("value", ",")).alias("dst_idx", "_w"))
    return cells.select(
        "src_idx", F.col("dst_idx").cast("long").alias("dst_idx"), F.col("_w").cast("double").alias("weight")
    ).filter(F.col("weight") != 0)


def write_edge_list(edges: DataFrame, nodes: DataFrame, path: str, weight: str = "weight") -> None:
    """``index`` (node, idx) and ``edges`` (src_idx dst_idx weight, blank separated)."""
    index = node_index(nodes)
    index.write.option("quoteAll", True).csv(f"{path}/index")
    indexed_edges(edges, index, weight).write.option("sep", " ").csv(f"{path}/edges")


def read_edge_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    index = spark.read.schema("node string, idx long").csv(f"{path}/index")
    edges = spark.read.option("sep", " ").schema("src_idx long, dst_idx long, weight double")
    return index, edges.csv(f"{path}/edges")


def write_samples(samples: DataFrame, path: str) -> None:
    samples.write.option("ignoreNullFields", False).json(path)


def read_samples(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Samples as JSON lines, or as one JSON array per file with ``multiline``."""
    return spark.read.schema(SAMPLE).option("mode", "FAILFAST").option("multiLine", multiline).json(path)


def write_metadata(metadata: DataFrame, path: str) -> None:
    """The parts of ``corpus_metadata`` as one JSON object in one file, a line for each part."""
    inner = F.regexp_extract(F.to_json("values"), r"(?s)^\[(.*)\]$", 1)
    place = {kind: i for i, kind in enumerate(("place_name", "place_type", *TOTALS))}
    section = F.coalesce(*[F.when(F.col("kind") == k, F.lit(2 * i + 1)) for k, i in place.items()])
    listed = F.col("values").isNotNull()
    line = F.when(listed, F.concat(F.when(F.col("chunk") > 0, F.lit(",")).otherwise(F.lit("")), inner)).otherwise(
        F.concat(
            F.when(F.col("kind") == TOTALS[0], F.lit("")).otherwise(F.lit(",")), F.lit('"'), "kind", F.lit('":'),
            F.col("total").cast("string"),
        )
    )
    lines = metadata.select(section.alias("section"), "chunk", line.alias("value"))
    frame = [(0, '{"valid_place_names":['), (2, '],"valid_place_types":['), (4, "],"), (2 * len(place), "}")]
    fixed = metadata.sparkSession.createDataFrame([(s, 0, v) for s, v in frame], "section int, chunk int, value string")
    lines.unionByName(fixed).orderBy("section", "chunk").coalesce(1).select("value").write.text(path)


def read_metadata(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """The document as the parts it was written from."""
    document = spark.read.schema(METADATA).option("multiLine", True).json(path)

    def parts(kind: str, column: str) -> DataFrame:
        count = F.ceil(F.size(column) / chunk).cast("int")
        cut = F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.struct(
                F.lit(kind).alias("kind"), i.alias("chunk"), F.slice(column, i * chunk + 1, F.lit(chunk)).alias("values"),
                F.lit(None).cast("long").alias("total"),
            ),
        )
        return document.filter(F.size(column) > 0).select(F.inline(cut))

    none = F.lit(None).cast("array<string>").alias("values")
    totals = F.array(
        *[F.struct(F.lit(c).alias("kind"), F.lit(0).alias("chunk"), none, F.col(c).alias("total")) for c in TOTALS]
    )
    lists = parts("place_name", "valid_place_names").unionByName(parts("place_type", "valid_place_types"))
    return lists.unionByName(document.select(F.inline(totals)))


def write_training_lines(prompts: DataFrame, path: str) -> None:
    prompts.select("prompt", "completion").write.json(path)


def read_training_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAINING_LINE).option("mode", "FAILFAST").json(path)


def write_records(records: DataFrame, path: str) -> None:
    """Best-epoch records and metric series as JSON lines."""
    records.write.json(path)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write a derived table where the caller says and read it back for reuse."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
