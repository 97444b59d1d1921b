"""Gold over a stream: mergeable state per group, carried from batch to batch, each batch counted once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabella.functions.scalar import c, dtype, is_number, number
from tabella.operators.grouping import round_numbers, with_period

#: Functions whose value follows from what two halves of a group have each.
MERGEABLE = ("sum", "mean", "count", "min", "max")


@dataclass(frozen=True)
class Gold:
    """What a gold table groups by and measures, as in a run's configuration."""

    by: list[str]
    values: list[str] = field(default_factory=list)
    funcs: list[str] = field(default_factory=list)
    date_col: str | None = None
    period: str | None = None
    digits: int = 3

    def __post_init__(self):
        other = [f for f in self.funcs if f not in MERGEABLE]
        if other:
            raise ValueError(f"A stream's gold table can't carry {', '.join(other)}: only {', '.join(MERGEABLE)} merge.")
        if not self.by and not (self.date_col and self.period):
            raise ValueError("Pick at least one column to group by.")

    @property
    def keys(self) -> list[str]:
        made = [f"{self.date_col}_{self.period.lower()}"] if self.date_col and self.period else []
        return made + [k for k in self.by if not made or k != self.date_col]


def _paths(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def states(spark: SparkSession, folder: str) -> list[int]:
    """The batches whose state is complete, oldest first."""
    fs, path = _paths(spark, folder)
    if not fs.exists(path):
        return []
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=") and fs.exists(Path(f"{folder}/{n}/_SUCCESS")))


def measured(df: DataFrame, gold: Gold) -> DataFrame:
    """The state of one batch: rows, and sum, count, least and greatest of every value, per group."""
    if gold.date_col and gold.period:
        df, _ = with_period(df, gold.date_col, gold.period)
    parts = []
    for i, v in enumerate(gold.values):
        n = c(v) if is_number(dtype(df, v)) else number(df, v)
        parts += [F.sum(n).alias(f"_s{i}"), F.count(n).alias(f"_n{i}"), F.min(n).alias(f"_l{i}"), F.max(n).alias(f"_g{i}")]
    return df.groupBy(*[c(k) for k in gold.keys]).agg(F.count(F.lit(1)).alias("_rows"), *parts)


def merged(one: DataFrame, two: DataFrame, gold: Gold) -> DataFrame:
    """The state of both together; groups of either are kept."""
    how = {"_s": F.sum, "_n": F.sum, "_l": F.min, "_g": F.max}
    parts = [f(c(f"{p}{i}")).alias(f"{p}{i}") for i in range(len(gold.values)) for p, f in how.items()]
    return one.unionByName(two).groupBy(*[c(k) for k in gold.keys]).agg(F.sum("_rows").alias("_rows"), *parts)


def advance(df: DataFrame, batch_id: int, folder: str, gold: Gold) -> None:
    """Merge a batch into the newest state of an earlier batch and write the sum as its own.

    A batch that is repeated starts from the same earlier state and overwrites what it wrote, so it counts once. States
    before the one merged from are deleted.
    """
    spark = df.sparkSession
    before = [b for b in states(spark, folder) if b < batch_id]
    state = measured(df, gold)
    if before:
        state = merged(spark.read.parquet(f"{folder}/batch={before[-1]}"), state, gold)
    state.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    for old in before[:-1]:
        fs, path = _paths(spark, f"{folder}/batch={old}")
        fs.delete(path, True)


def gold_table(spark: SparkSession, folder: str, gold: Gold) -> DataFrame | None:
    """The gold table after the newest batch, in the form that ``group_summary`` gives; None before the first."""
    done = states(spark, folder)
    if not done:
        return None
    state = spark.read.parquet(f"{folder}/batch={done[-1]}")
    made = {
        "sum": lambda i: c(f"_s{i}"), "mean": lambda i: F.try_divide(c(f"_s{i}"), c(f"_n{i}")), "count": lambda i: c(f"_n{i}"), "min": lambda i: c(f"_l{i}"), "max": lambda i: c(f"_g{i}"),
    }
    out = state.select(*[c(k) for k in gold.keys], c("_rows").alias("rows_in_group"), *[made[f](i).alias(f"{v}_{f}") for i, v in enumerate(gold.values) for f in gold.funcs])
    return round_numbers(out, gold.digits, gold.keys)
