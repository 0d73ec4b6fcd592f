"""Session settings and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster use the cluster's own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trajflow")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="trajflow-")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session or its context names it.

    Only a local session that names none (a test) gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not context.master.startswith("local["):
        raise ValueError("a cluster's session has to name a shared folder in spark.checkpoint.dir")
    return named or _local_folder(context.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tables that callers keep, by application and name.
_KEPT: dict[tuple[str, str], str] = {}


def _folder(spark: SparkSession, path: str):
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(context._jsc.hadoopConfiguration()), folder


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Let the written ``path`` go when the session's JVM ends."""
    system, folder = _folder(spark, path)
    system.deleteOnExit(folder)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder under the caller's ``name``, and read from there.

    While the name is held, a further call returns the same table, whatever its
    ``df``; :func:`release` gives it up. The end of the session does so too.
    """
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, name)
    if key not in _KEPT:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        remove_at_exit(spark, path)
        _KEPT[key] = path
    return spark.read.schema(df.schema).parquet(_KEPT[key])


def release(spark: SparkSession, *names: str) -> None:
    """Remove kept tables (all of the session's without names) and their files."""
    application = spark.sparkContext.applicationId
    for key in [k for k in _KEPT if k[0] == application and (not names or k[1] in names)]:
        system, folder = _folder(spark, _KEPT.pop(key))
        system.delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so lost executors cost nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size of the tables ``df`` reads; ``None`` where the client has none.

    The estimate of a join itself is the product of its sides and says little.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    except AttributeError:
        return None
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def hashed(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """``df`` hashed on ``keys`` over the session's full number of partitions.

    For inputs that the next step multiplies: their own size says little about
    the work, so adaptive coalescing must not merge them.
    """
    n = max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def over_all_cores(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """A table too small to be split by its files, dealt out to all cores.

    Anything larger already comes in many splits and stays as it is.
    """
    size = estimated_bytes(df)
    if size is None or size > limit:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
