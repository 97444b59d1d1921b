"""Contract-award records: API pages to a table, date checks, samples, a generator."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tabella.functions.scalar import c, whole_days
from tabella.operators.clean import stringify_nested
from tabella.operators.profile import wide_agg

# Field names of the award records.
FIELDS = {
    "Award ID": "award_id",
    "Recipient Name": "recipient_name",
    "Start Date": "start_date",
    "End Date": "end_date",
    "Award Amount": "award_amount",
    "Total Outlays": "total_outlays",
    "Awarding Agency": "awarding_agency",
    "Awarding Sub Agency": "awarding_sub_agency",
    "Contract Award Type": "contract_award_type",
    "NAICS": "naics",
    "PSC": "psc",
    "Place of Performance State Code": "place_of_performance_state",
    "Description": "description",
}
NO_STATE = "Other"
MAX_SLICES = 12


def _code_and_text(df: DataFrame, field: str) -> tuple[Column, Column]:
    """(code, description) of a value that is plain text or an object with both."""
    value = c(field)
    if isinstance(df.schema[field].dataType, T.StructType):
        return value.getField("code").cast("string"), value.getField("description").cast("string")
    text = value.cast("string")
    is_object = F.ltrim(text).startswith("{")
    return (
        F.when(is_object, F.get_json_object(text, "$.code")).otherwise(text),
        F.when(is_object, F.get_json_object(text, "$.description")),
    )


def flatten_awards(pages: DataFrame) -> DataFrame:
    """API pages (a ``results`` list per row) to one typed row per award."""
    rows = pages.select(F.inline("results"))
    for field in FIELDS:
        if field not in rows.columns:
            rows = rows.withColumn(field, F.lit(None).cast("string"))
    cols = []
    for field, name in FIELDS.items():
        if name in ("naics", "psc"):
            code, text = _code_and_text(rows, field)
            cols += [code.alias(f"{name}_code"), text.alias(f"{name}_description")]
        elif name in ("start_date", "end_date"):
            cols.append(F.try_to_timestamp(c(field).cast("string"), F.lit("yyyy-MM-dd")).alias(name))
        elif name in ("award_amount", "total_outlays"):
            cols.append(c(field).try_cast("double").alias(name))
        elif name == "place_of_performance_state":
            cols.append(F.coalesce(c(field), F.lit(NO_STATE)).alias(name))
        else:
            cols.append(c(field).alias(name))
    out = stringify_nested(rows.select(*cols))
    out = out.withColumn("duration_days", whole_days(F.col("start_date"), F.col("end_date")))
    have = wide_agg(out, {x: F.count(c(x)) for x in out.columns})
    return out.select(*[c(x) for x in out.columns if have[x]])


def check_date_problems(df: DataFrame, today: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Blank impossible durations; count end before start, future starts, same-day awards."""
    now = F.lit(today).cast("timestamp") if today else F.current_date().cast("timestamp")
    counts = df.agg(
        F.count_if(F.col("duration_days") < 0).alias("end_before_start"),
        F.count_if(F.col("start_date") > now).alias("future_start"),
        F.count_if(F.col("duration_days") == 0).alias("same_day"),
    )
    days = F.col("duration_days").cast("double")
    return df.withColumn("duration_days", F.when(~(days < 0), days)), counts


def dedupe_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per key; combined before the shuffle, so no key is ever sorted whole."""
    rest = [x for x in df.columns if x != key]
    first = F.min_by(F.struct(*[c(x) for x in rest]), F.struct(*[c(x) for x in order]))
    return df.groupBy(c(key)).agg(first.alias("_row")).select(c(key), *[F.col("_row").getField(x).alias(x) for x in rest]).select(*[c(x) for x in df.columns])


def slice_of(day: Column, first: date, last: date, n: int) -> tuple[Column, int]:
    """Which of n back-to-back date slices a day falls in, and how many there are."""
    days = (last - first).days + 1
    n = max(1, min(n, days))
    starts = F.array(*[F.lit(round(days * i / n)) for i in range(n)])
    offset = F.datediff(day, F.lit(first))
    which = F.size(F.filter(starts, lambda s: s <= offset)) - 1
    return F.when(offset.between(0, days - 1), which), n


def share_quota(available: list[int], total: int) -> list[int]:
    """An equal share per slice; what a slice cannot use passes on evenly."""
    out = []
    for k, have in enumerate(available):
        want = math.ceil((total - sum(out)) / (len(available) - k))
        out.append(max(0, min(want, have)))
    return out


def sample_by_time_slice(
    df: DataFrame, date_col: str, tie: str, total: int, first: date, last: date, slices: int = MAX_SLICES
) -> DataFrame:
    """``total`` rows spread over the period, the latest of each slice."""
    which, n = slice_of(F.to_date(c(date_col)), first, last, min(slices, total))
    df = df.withColumn("_slice", which).where(F.col("_slice").isNotNull())
    counts = {r["_slice"]: r["count"] for r in df.groupBy("_slice").count().collect()}
    quota = share_quota([counts.get(i, 0) for i in range(n)], total)
    salts = 64
    most = max(quota, default=0)
    allowed = F.element_at(F.array(*[F.lit(x) for x in quota]), F.col("_slice") + 1)
    order = [c(date_col).desc(), c(tie).asc()]
    thin = Window.partitionBy("_slice", "_salt").orderBy(*order)
    whole = Window.partitionBy("_slice").orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(c(tie)), F.lit(salts)))
        .withColumn("_rn", F.row_number().over(thin))
        # A plain number here lets Spark thin each slice before the shuffle.
        .where(F.col("_rn") <= most)
        .withColumn("_rn", F.row_number().over(whole))
        .where(F.col("_rn") <= allowed)
        .drop("_slice", "_salt", "_rn")
    )


def generate_awards(spark: SparkSession, rows: int, seed: int = 11) -> DataFrame:
    """Made-up messy awards: money text, gaps, a September bump and exact repeats."""
    pick = lambda values, s: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.rand(s) * len(values)) + 1).cast("int"))
    r = F.rand(seed)
    agency = F.when(r < 0.35, "DoD").when(r < 0.55, "HHS").when(r < 0.70, "GSA").when(r < 0.85, "DHS").otherwise("VA")
    base = spark.range(rows).select(
        F.format_string("A%09d", "id").alias("award_id"),
        F.date_add(F.lit("2019-10-01").cast("date"), F.floor(F.rand(seed + 1) * 2556).cast("int")).alias("day"),
        agency.alias("agency"),
        pick([541511, 541512, 518210, 541330, 561210], seed + 2).alias("naics_code"),
        (F.floor(F.rand(seed + 3) * 370) + 30).cast("int").alias("duration_days"),
        F.exp(F.lit(10.3) + F.randn(seed + 4) * 0.6).alias("materials"),
        F.randn(seed + 5).alias("noise"),
        F.rand(seed + 6).alias("flip"),
        pick(["Low", "Medium", "High"], seed + 7).alias("other_risk"),
        F.rand(seed + 8).alias("gap_cost"),
        F.rand(seed + 9).alias("gap_risk"),
        F.rand(seed + 10).alias("repeat"),
    )
    total = F.greatest(F.col("materials") * 1.6 + F.col("duration_days") * 120 + F.col("noise") * 9000, F.lit(1000.0))
    total = total * F.when(F.month("day") == 9, 1.5).otherwise(1.0)
    base = base.withColumn("total", total)
    risk = F.when(F.col("total") > 140_000, "High").when(F.col("total") > 80_000, "Medium").otherwise("Low")
    made = base.select(
        "award_id",
        F.col("day").cast("string").alias("award_date"),
        "agency",
        "naics_code",
        "duration_days",
        F.when(F.col("gap_cost") >= 0.03, F.round("materials", 2)).alias("materials_cost"),
        F.concat(F.lit("$"), F.format_number("total", 2)).alias("total_cost"),
        F.when(F.col("gap_risk") >= 0.02, F.when(F.col("flip") < 0.06, F.col("other_risk")).otherwise(risk)).alias("risk_level"),
        F.explode(F.when(F.col("repeat") < 0.002, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return made.drop("_copy")
