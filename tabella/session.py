"""Session settings, the shared work folder, and size checks.

Everything that depends on where the job runs is read from the session, so the
same operator works in a local test and on a cluster.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# A range of an ordered table, and a group that one task buffers, has about this many rows at most. Rows are counted, not
# estimated. Override with the session setting ``tabella.singleTaskRows`` (0 forces many ranges).
SINGLE_TASK_ROWS = 1_000_000
# Stages whose plan is estimated below this are cached instead of written; results don't depend on it.
CACHE_BYTES = 64 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "tabella", **conf) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("TABELLA_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = configure(builder.config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan; no job runs."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def few_rows(df: DataFrame) -> bool:
    """True when one task can hold all rows; counted."""
    limit = int(df.sparkSession.conf.get("tabella.singleTaskRows", str(SINGLE_TASK_ROWS)))
    return limit > 0 and df.count() <= limit


def split_count(df: DataFrame) -> int:
    """How many order ranges to cut a table into, from its counted rows."""
    conf = df.sparkSession.conf.get("tabella.splits", "")
    if conf:
        return int(conf)
    limit = int(df.sparkSession.conf.get("tabella.singleTaskRows", str(SINGLE_TASK_ROWS)))
    return max(1, math.ceil(df.count() / limit)) if limit > 0 else 8


def cheap_to_cache(df: DataFrame) -> bool:
    """Whether a stage is cached or written; no job runs."""
    return estimated_bytes(df) <= CACHE_BYTES


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is only ever used by a local session that names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
    folder = os.path.join(tempfile.mkdtemp(prefix="tabella-"), "work")
    spark.sparkContext.setCheckpointDir("file:" + folder)
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    return f"{_stages(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def _stages(spark: SparkSession) -> str:
    return f"{work_dir(spark).rstrip('/')}/tabella/{spark.sparkContext.applicationId}"


def free_stages(spark: SparkSession) -> None:
    """Delete every stage that this application has written; call it once all results have been written or collected."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stages(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a table below the shared folder and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spool(df: DataFrame, label: str = "stage", small: bool | None = None) -> DataFrame:
    """Write a stage that several passes read, and read it back.

    The written table survives lost executors, cuts the lineage, and lets later
    passes prune columns. A small table is only cached.
    ``small`` passes on a decision made before joins blurred the estimate.
    """
    if cheap_to_cache(df) if small is None else small:
        return spread(df).persist()
    return stage(df, label)


def sized(df: DataFrame, label: str, parts: int) -> DataFrame:
    """A table with a row per group that a large one is joined with, written first so that its real size is known.

    Estimated through joins, a handful of rows looks as large as their input, and the large table would be shuffled and sorted.
    """
    return stage(df, label) if parts > 1 else df


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores; one small file would otherwise be one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def widen(df: DataFrame) -> DataFrame:
    """``spread`` for a small table; a large one already has its many partitions."""
    return spread(df) if cheap_to_cache(df) else df


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Read one Parquet table of a data folder."""
    configure(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")
