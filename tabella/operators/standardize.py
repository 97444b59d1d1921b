"""Measurements from many sources on one robust scale, checked and combined.

A source that holds much of the data is cut into chunks for the neighbour windows
and its medians are found by counting value ranges (see ``functions``), so no
source is ever sorted by one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tabella.functions.ordering import neighbourhoods
from tabella.functions.quantiles import group_quantiles
from tabella.functions.scalar import as_text, c, join_keys, moment, number, period_start, whole_days
from tabella.session import sized, split_count, spool

# Fixed values of the method.
MAD_SCALE = 1.4826
ROLLING, MIN_ROLLING = 3, 3
COMBINE = ("weighted mean", "median", "mean")


@dataclass
class Standardized:
    """Row-level scores and flags, one quality row per series, the index, a summary."""

    rows: DataFrame
    quality: DataFrame
    index: DataFrame
    summary: DataFrame


def series_key(df: DataFrame, cols: list[str]):
    """Source columns as one text key."""
    parts = [F.coalesce(as_text(df, x), F.lit("nan")) for x in cols]
    return F.concat_ws(" | ", *parts)


def robust_z(df: DataFrame, series: str, x: str, out: str = "robust_z", parts: int | None = None) -> DataFrame:
    """(x - median) / (1.4826 MAD) per series; null when the MAD is zero."""
    parts = parts or split_count(df)
    df = join_keys(df, group_quantiles(df, [series], x, {"_med": 0.5}, parts), [series])
    df = df.withColumn("_dev", F.abs(c(x) - F.col("_med")))
    df = join_keys(df, group_quantiles(df, [series], "_dev", {"_mad": 0.5}, parts), [series])
    z = (c(x) - F.col("_med")) / F.nullif(F.col("_mad") * MAD_SCALE, F.lit(0.0))
    return df.withColumn(out, z).drop("_med", "_dev", "_mad")


def vs_others(
    df: DataFrame, series: str, period: str, z: str = "robust_z", out: str = "vs_others", parts: int | None = None
) -> DataFrame:
    """Score minus the period's median over all series (three series or more)."""
    few = df.select(c(series)).distinct().limit(3).count() < 3
    if few:
        return df.withColumn(out, c(z))
    common = group_quantiles(df, [period], z, {"_common": 0.5}, parts)
    return join_keys(df, common, [period]).withColumn(out, c(z) - F.col("_common")).drop("_common")


def _neighbour_columns(df: DataFrame, series: str, date: str, tie: str | None, v: str, step_window: int, parts: int) -> DataFrame:
    """Previous value and date, local level, and levels before and after, per row."""
    reach = max(ROLLING, step_window)
    d = neighbourhoods(df, [series], date, tie, reach, reach, parts)
    w = Window.partitionBy(c(series), "_chunk").orderBy("_pos")
    half = lambda a, b: F.expr(f"percentile(`{v}`, 0.5D)").over(w.rowsBetween(a, b))
    local = w.rowsBetween(-ROLLING, ROLLING)
    return (
        d.withColumns(
            {
                "_diff": F.abs(c(v) - F.lag(c(v)).over(w)),
                "days_since_previous": whole_days(F.lag(c(date)).over(w), c(date)),
                "_local": F.when(F.count(c(v)).over(local) >= MIN_ROLLING, half(-ROLLING, ROLLING)),
                "_before": half(-step_window, -1),
                "_after": half(0, step_window - 1),
            }
        )
        .where("_own")
        .drop("_chunk", "_own")
    )


def standardize(
    df: DataFrame,
    source: str,
    date: str,
    value: str,
    tie: str | None = None,
    split: list[str] = (),
    weight: str | None = None,
    log: bool = True,
    z_flag: float = 4.5,
    gap_days: int = 21,
    step_window: int = 6,
    step_min: float = 3.5,
    period: str = "Week",
    combine: str = "weighted mean",
) -> Standardized:
    """The whole method, from raw readings to the index."""
    if combine not in COMBINE:
        raise ValueError(f"Use one of {', '.join(COMBINE)}.")
    keys = [source, *[x for x in split if x != source]]
    typed = df.select(
        *[c(x) for x in df.columns],
        moment(df, date).alias("_date"),
        number(df, value).alias("_value"),
        series_key(df, keys).alias("series"),
    )
    present = typed.dropna(subset=["_date", "_value"])
    used = present.where(F.col("_value") > 0) if log else present
    work = used.withColumn("_x", F.log10("_value") if log else F.col("_value")).withColumn("_period", period_start(F.col("_date"), period))
    # Decided once, on the plain readings: joins only blur the estimate.
    parts = split_count(work)
    small = parts <= 1
    work = spool(work, "readings", small)
    scored = spool(robust_z(work, "series", "_x", parts=parts), "scored", small)
    scored = vs_others(scored, "series", "_period", parts=parts)
    work = spool(_neighbour_columns(scored, "series", "_date", tie, "vs_others", step_window, parts), "neighbours", small)
    noise = group_quantiles(work, ["series"], "_diff", {"_noise": 0.5}, parts)
    work = join_keys(work, noise, ["series"]).withColumn(
        "_noise", F.nullif(F.col("_noise") * MAD_SCALE / math.sqrt(2), F.lit(0.0))
    )
    work = work.withColumn("vs_others_z", (F.col("vs_others") - F.col("_local")) / F.col("_noise"))
    work = work.withColumn("flag_outlier", F.coalesce(F.abs("vs_others_z") > z_flag, F.lit(False)))
    work = work.withColumn("flag_gap_before", F.coalesce(F.col("days_since_previous") > gap_days, F.lit(False)))

    quality = _quality(work, gap_days, step_window, step_min, number(work, weight) if weight else None, parts)
    index = _index(work, quality if weight and combine == "weighted mean" else None, combine)
    summary = _summary(typed, work, quality, source, log)
    rows = work.select(
        *[c(x) for x in df.columns], "series", F.col("_date").alias("date_parsed"), F.col("_value").alias("value_numeric"),
        *[F.round(x, 3).alias(x) for x in ("robust_z", "vs_others", "vs_others_z")], "flag_outlier", "days_since_previous", "flag_gap_before",
    )
    return Standardized(rows, quality, index, summary)


def step_change(work: DataFrame, step_window: int, step_min: float, parts: int = 1) -> DataFrame:
    """The largest shift in level per series, when large enough; the first on ties."""
    shift = (F.col("_after") - F.col("_before")) / F.col("_noise")
    per = sized(work.groupBy("series").agg(F.count("*").alias("_rows")), "series-rows", parts)
    d = join_keys(work.withColumn("_shift", shift), per, ["series"])
    room = (F.col("_rows") >= 2 * step_window + 2) & (F.col("_pos") > step_window) & (F.col("_pos") <= F.col("_rows") - step_window + 1)
    d = d.where(room & F.col("_shift").isNotNull() & (F.col("_shift") != 0))
    best = d.groupBy("series").agg(
        F.min_by(F.struct(F.col("_date").alias("step_date"), F.col("_shift").alias("step_size")), F.struct(-F.abs("_shift"), F.col("_pos"))).alias("s")
    )
    return best.select("series", "s.*").where(F.abs("step_size") >= step_min)


def _quality(work: DataFrame, gap_days: int, step_window: int, step_min: float, weight, parts: int) -> DataFrame:
    aggs = [
        F.count("*").alias("readings"),
        F.min("_date").alias("first_date"),
        F.max("_date").alias("last_date"),
        F.count_if("flag_outlier").alias("outliers"),
        F.count_if(F.col("days_since_previous") > gap_days).alias("gaps"),
        F.coalesce(F.max("days_since_previous"), F.lit(0)).alias("longest_gap"),
        F.count("robust_z").alias("_scored"),
    ]
    if weight is not None:
        aggs.append(F.min_by(weight, F.when(weight.isNotNull(), F.col("_pos"))).alias("weight"))
    q = work.groupBy("series").agg(*aggs)
    q = join_keys(q, group_quantiles(work, ["series"], "_value", {"median_value": 0.5}, parts), ["series"])
    q = join_keys(q, step_change(work, step_window, step_min, parts), ["series"])
    note = F.when((F.col("_scored") == 0) & (F.col("readings") > 1), "no spread").otherwise("")
    return q.withColumn("note", note).withColumn("step_size", F.round("step_size", 2)).drop("_scored")


def _index(work: DataFrame, quality: DataFrame | None, combine: str) -> DataFrame:
    """One value per period from the series' means of unflagged readings."""
    per = work.where(~F.col("flag_outlier") & F.col("robust_z").isNotNull()).groupBy("_period", "series").agg(F.avg("robust_z").alias("z"))
    sources = F.count("*").alias("sources")
    middle = quality is not None or combine == "median"
    if middle:
        per = join_keys(per, group_quantiles(per, ["_period"], "z", {"_middle": 0.5}), ["_period"])
    if quality is not None:
        per = join_keys(per, quality.select("series", "weight"), ["series"]).fillna(0.0, subset=["weight"])
        weighted = F.try_divide(F.sum(F.col("z") * F.col("weight")), F.sum("weight"))
        value = F.coalesce(F.when(F.sum("weight") > 0, weighted), F.max("_middle"))
    elif combine == "median":
        value = F.max("_middle")
    else:
        value = F.avg("z")
    return per.groupBy(F.col("_period").alias("period")).agg(F.round(value, 3).alias("index"), sources).orderBy("period")


def _summary(typed: DataFrame, work: DataFrame, quality: DataFrame, source: str, log: bool) -> DataFrame:
    complete = F.col("_date").isNotNull() & F.col("_value").isNotNull()
    a = typed.agg(
        F.count("*").alias("rows_in"), F.count_if(~complete).alias("dropped_missing"),
        (F.count_if(complete & (F.col("_value") <= 0)) if log else F.lit(0).cast("long")).alias("dropped_nonpositive"),
    )
    up = F.when(F.col("_value") > 0, F.col("_value"))
    b = work.agg(
        F.count("*").alias("rows_used"), F.count_distinct("series").alias("series"), F.count_distinct(c(source)).alias("sources"),
        F.count_if("flag_outlier").alias("outliers"), F.count_if("flag_gap_before").alias("gaps"),
        F.coalesce(F.log10(F.max(up) / F.min(up)), F.lit(0.0)).alias("orders_of_magnitude"),
    )
    s = quality.agg(F.count("step_date").alias("step_changes"))
    both = a.unionByName(b, allowMissingColumns=True).unionByName(s, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(x).alias(x) for x in both.columns]).withColumn("log_advised", F.col("orders_of_magnitude") >= 3)
