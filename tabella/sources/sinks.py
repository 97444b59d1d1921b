"""Writers and storage layout."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tabella.functions.scalar import c
from tabella.operators.profile import long_columns
from tabella.operators.wrangle import escape_formulas, safe_columns
from tabella.session import new_path

CODECS = ["snappy", "gzip", "lz4", "zstd", "none"]


def folder_bytes(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, data files) below a path, asked from the file system itself."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(p, True)
    size = count = 0
    while files.hasNext():
        f = files.next()
        name = f.getPath().getName()
        if not name.startswith(("_", ".")):
            size, count = size + f.getLen(), count + 1
    return size, count


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "error") -> str:
    """CSV with a header, safe to open in a spreadsheet."""
    escape_formulas(df).write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "error") -> str:
    df.write.mode(mode).json(path)
    return path


def write_orc(df: DataFrame, path: str, mode: str = "error") -> str:
    df.write.mode(mode).orc(path)
    return path


def write_counted(df: DataFrame, path: str) -> int:
    """Write Parquet and say how many rows went by; nothing is read again to count them."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return int(seen.get["rows"])


def write_parquet(df: DataFrame, path: str, codec: str = "snappy", mode: str = "error") -> str:
    df.write.mode(mode).option("compression", codec).parquet(path)
    return path


def write_partitioned(df: DataFrame, cols: list[str], path: str, codec: str = "snappy", mode: str = "error") -> str:
    """Folders per value (year=2026/month=01). The rebalance hint keeps one file
    set per value and lets Spark split a value that holds much of the table."""
    df = safe_columns(df)
    df.hint("rebalance", *[c(x) for x in cols]).write.mode(mode).option("compression", codec).partitionBy(*cols).parquet(path)
    return path


def codec_sizes(df: DataFrame) -> DataFrame:
    """CSV against Parquet codecs: size, write time, share of the CSV size."""
    spark = df.sparkSession
    df = safe_columns(df)
    rows = []
    for fmt, codec in [("CSV", "none"), *[("Parquet", x) for x in CODECS]]:
        path = new_path(spark, f"codec-{codec}")
        t0 = time.time()
        if fmt == "CSV":
            df.write.option("header", True).csv(path)
        else:
            df.write.option("compression", codec).parquet(path)
        took = time.time() - t0
        rows.append((fmt, codec, round(folder_bytes(spark, path)[0] / 1024, 1), round(took, 3)))
    out = [(*r, round(100 * r[2] / rows[0][2], 1) if rows[0][2] else None) for r in rows]
    return spark.createDataFrame(out, "format string, codec string, size_kb double, write_seconds double, pct_of_csv double")


def partition_advice(df: DataFrame, cols: list[str]) -> DataFrame:
    """Is a column worth a folder per value? One of four verdicts per column."""
    n = F.count("*")
    out = long_columns(df, {x: {"distinct_values": F.count_distinct(c(x)), "_n": n} for x in cols})
    k, per = F.col("distinct_values"), F.col("_n") / F.nullif(F.col("distinct_values"), F.lit(0))
    verdict = F.when(k <= 1, "one value").when(k > 500, "too many values").when(per < 100, "few rows per folder").otherwise("good")
    folders = df.select(*[c(x) for x in cols]).distinct().count()
    return out.select(
        "column_name",
        "distinct_values",
        F.round(F.coalesce(per, F.lit(0.0)), 1).alias("rows_per_value"),
        verdict.alias("advice"),
        F.lit(folders).cast("long").alias("folders_of_combination"),
    )


def partition_pruning(spark: SparkSession, path: str, col: str, value) -> DataFrame:
    """Rows and files of a full read against a read of one partition value."""
    def facts(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"rows_{tag}"), F.count_distinct("_metadata.file_path").alias(f"files_{tag}"))

    whole = spark.read.parquet(path)
    parts = []
    for tag, df in (("all", whole), ("part", whole.where(c(col) == F.lit(value)))):
        t0 = time.time()
        row = facts(df, tag).first()
        parts.append((tag, row[0], row[1], round(time.time() - t0, 4)))
    return spark.createDataFrame(parts, "read string, rows long, files long, seconds double")
