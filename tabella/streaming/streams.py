"""Structured Streaming: cleaned layers, period KPIs and duplicates over new files."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabella.functions.scalar import c
from tabella.operators.clean import normalise_missing
from tabella.operators.quality import gate_status, mask_pii, quality_gates
from tabella.operators.wrangle import converted
from tabella.session import configure
from tabella.sources.sinks import write_counted
from tabella.streaming.gold import Gold, advance


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int = 100) -> DataFrame:
    """New files of a folder as a stream; zone-less timestamps become timestamps."""
    configure(spark)
    df = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)
    ntz = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({x: c(x).cast("timestamp") for x in ntz}) if ntz else df


def apply_profile(df: DataFrame, profile: dict[str, str], fills: dict[str, object]) -> DataFrame:
    """Row-wise cleaning with decisions made earlier: kinds, fills, dropped identifiers."""
    df = normalise_missing(df)
    keep = [x for x in df.columns if profile.get(x, "identifier") != "identifier"]
    df = df.select(*[converted(df, x, profile[x]).alias(x) for x in keep])
    return df.fillna({x: v for x, v in fills.items() if x in keep and v is not None})


def stream_layers(
    stream: DataFrame, profile: dict[str, str], fills: dict[str, object], out_dir: str, checkpoint: str,
    pii: list[str] = (), schema: dict | None = None, salt: str = "", gold: Gold | None = None,
) -> None:
    """Each batch of new files is gated, cleaned with the frozen profile, masked, appended, and merged into the gold table.

    A batch that fails its gate is kept apart and leaves gold as it is. Every batch writes its layer, its checks and one row
    of the run log into folders of its own with overwrite, and merges into the state before it, so a batch repeated after a
    failure does not count twice. Rows are counted while they are written.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        if df.isEmpty():
            return
        checks = quality_gates(df, profile, schema)
        status = gate_status(checks).first()["status"]
        layer = "rejected" if status == "FAIL" else "silver"
        out = df if status == "FAIL" else mask_pii(apply_profile(df, profile, fills), list(pii), "hash", salt)
        started = datetime.now(timezone.utc).isoformat(timespec="seconds")
        path = f"{out_dir}/{layer}/batch={batch_id}"
        rows = write_counted(out, path)
        checks.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/quality_checks/batch={batch_id}")
        if gold is not None and layer == "silver":
            advance(df.sparkSession.read.parquet(path), batch_id, f"{out_dir}/gold_state", gold)
        log = df.sparkSession.createDataFrame([(started, status, layer, rows)], "started string, gate string, layer string, rows long")
        log.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/run_log/batch={batch_id}")

    run_to_end(lambda: stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_kpi_trend(stream: DataFrame, date_col: str, value_col: str, by: list[str], period: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sum, mean and count per period; rows later than ``late`` are left out."""
    return (
        stream.withWatermark(date_col, late)
        .groupBy(F.window(c(date_col), period), *[c(k) for k in by])
        .agg(F.sum(c(value_col)).alias("total"), F.avg(c(value_col)).alias("mean"), F.count("*").alias("rows"))
        .select(F.col("window.start").alias("period"), *[c(k) for k in by], "total", "mean", "rows")
    )


def stream_dedupe(stream: DataFrame, date_col: str, key: str, late: str = "1 day") -> DataFrame:
    """The first row per key within the watermark."""
    return stream.withWatermark(date_col, late).dropDuplicatesWithinWatermark([key])


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream to Parquet until the files at hand are used up."""
    run_to_end(
        lambda: stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def run_to_end(start: Callable) -> None:
    q = start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
