"""Regular series and forecasts for many series at once.

A series has one value per period, so its length is bounded by the calendar; it is
kept as one array per series, and every simple method is an array expression. Only
exponential smoothing, which is a recursion, runs in Python over those arrays.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabella.functions.scalar import c, join_keys, moment, number, period_label

# Seasonal cycle length per period, and the fewest periods.
CYCLES = {"Day": 7, "Week": 52, "Month": 12, "Quarter": 4, "Year": 1}
STEPS = {"Day": "1 day", "Week": "7 days", "Month": "1 month", "Quarter": "3 months", "Year": "1 year"}
MIN_PERIODS = 12
SIMPLE = ["naive", "moving_average", "linear_trend", "seasonal_naive"]
SMOOTHED = ["holt", "holt_winters"]
METHODS = ["naive", "moving_average", "linear_trend", "holt", "seasonal_naive", "holt_winters"]


def suggest_frequency(df: DataFrame, date: str) -> DataFrame:
    """The finest period that still leaves a readable number of points."""
    when = moment(df, date)
    span = F.floor((F.unix_micros(F.max(when)) - F.unix_micros(F.min(when))) / F.lit(86400 * 10**6))
    pick = F.when(span.isNull(), "Month").when(span <= 120, "Day").when(span <= 730, "Week").when(span <= 365 * 15, "Month").otherwise("Year")
    return df.agg(pick.alias("period"), span.cast("long").alias("span_days"))


# ------------------------------------------------------------------ series
def regular_series(
    df: DataFrame, date: str, value: str, period: str, agg: str = "sum", keys: list[str] = (), min_periods: int = MIN_PERIODS
) -> DataFrame:
    """One value per period and series: keys, period, t, value. Short series are left out."""
    d = df.select(*[c(k) for k in keys], period_label(moment(df, date), period).alias("period"), number(df, value).alias("v")).dropna(subset=["period", "v"])
    return _series(d.withColumn("n", F.lit(1).cast("long")), period, agg, list(keys), min_periods)


def series_from_daily(daily: DataFrame, period: str, agg: str = "sum", keys: list[str] = (), min_periods: int = MIN_PERIODS) -> DataFrame:
    """The same from per-day totals (d, total, n), so a large table is read once."""
    d = daily.select(*[c(k) for k in keys], period_label(F.col("d").cast("timestamp"), period).alias("period"), F.col("total").alias("v"), F.col("n").cast("long").alias("n"))
    return _series(d, period, agg, list(keys), min_periods)


def _series(d: DataFrame, period: str, agg: str, keys: list[str], min_periods: int) -> DataFrame:
    if agg not in ("sum", "count", "mean"):
        raise ValueError("Use sum, count or mean.")
    k = [c(x) for x in keys]
    got = d.groupBy(*k, "period").agg(F.sum("v").alias("total"), F.sum("n").alias("n"))
    spine = (
        got.groupBy(*k)
        .agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
        .select(*k, F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {STEPS[period]}"))).alias("period"))
    )
    full = join_keys(spine, got, [*keys, "period"])
    w = Window.partitionBy(*k).orderBy("period")
    full = full.withColumn("t", F.row_number().over(w) - 1)
    if agg == "sum":
        full = full.withColumn("value", F.coalesce("total", F.lit(0.0)))
    elif agg == "count":
        full = full.withColumn("value", F.coalesce("n", F.lit(0)).cast("double"))
    else:
        full = _interpolate(full.withColumn("value", F.try_divide(F.col("total"), F.col("n").cast("double"))), k)
    size = F.count("*").over(Window.partitionBy(*k))
    return full.withColumn("_n", size).where(F.col("_n") >= min_periods).select(*k, "period", "t", "value")


def _interpolate(d: DataFrame, k: list[Column]) -> DataFrame:
    """Straight lines between known periods."""
    known = F.when(F.col("value").isNotNull(), F.struct("t", "value"))
    past = Window.partitionBy(*k).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*k).orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumn("_a", F.last(known, True).over(past)).withColumn("_b", F.first(known, True).over(ahead))
    line = F.col("_a.value") + (F.col("_b.value") - F.col("_a.value")) * F.try_divide(F.col("t") - F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    return d.withColumn("value", F.coalesce("value", line, "_a.value", "_b.value")).drop("_a", "_b")


def as_arrays(series: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series: y (values in order), n, and the last period."""
    got = series.groupBy(*[c(k) for k in keys]).agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("s"), F.max("period").alias("last_period"))
    return got.select(*[c(k) for k in keys], F.col("s.value").alias("y"), F.size("s").alias("n"), "last_period").where("n > 0")


# ------------------------------------------------------------------ methods
def _linear(y: Column) -> tuple[Column, Column]:
    """Least-squares slope and intercept of an array against 0, 1, 2, ..."""
    n = F.size(y).cast("double")
    add = lambda a, x: a + x
    sy = F.aggregate(y, F.lit(0.0), add)
    sty = F.aggregate(F.transform(y, lambda v, i: v * i), F.lit(0.0), add)
    mean_t = (n - 1) / 2
    stt = n * (n * n - 1) / 12
    slope = (sty - mean_t * sy) / stt
    return slope, sy / n - slope * mean_t


def _simple(y: Column, steps: Column, m: int) -> dict[str, Column]:
    """Forecast arrays of the simple methods; null where a method does not apply."""
    n = F.size(y)
    ahead = F.sequence(F.lit(0), steps - 1)
    tail = F.slice(y, F.greatest(n - 2, F.lit(1)), F.lit(3))
    mean3 = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail)
    slope, start = _linear(y)
    seasonal = F.transform(ahead, lambda i: F.get(y, n - m + i % m))
    return {
        "naive": F.array_repeat(F.element_at(y, -1), steps),
        "moving_average": F.array_repeat(mean3, steps),
        "linear_trend": F.transform(ahead, lambda i: start + slope * (n + i)),
        "seasonal_naive": F.when((F.lit(m) > 1) & (n >= 2 * m), seasonal),
    }


def smooth(y: np.ndarray, steps: int, m: int = 0) -> np.ndarray:
    """Additive exponential smoothing with a damped trend (and an additive season).

    Every combination of a small grid runs at once as a vector; the one with the
    smallest one-step squared error gives the forecast.
    """
    grid = np.array(
        [
            (a, b, p, g)
            for a in (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
            for b in (0.01, 0.05, 0.1, 0.3)
            for p in (0.8, 0.9, 0.98)
            for g in ((0.05, 0.1, 0.3, 0.6) if m else (0.0,))
        ]
    ).T
    alpha, beta, phi, gamma = grid
    k = alpha.size
    if m:
        cycles = len(y) // m
        means = y[: cycles * m].reshape(cycles, m).mean(axis=1)
        season = np.tile((y[: cycles * m].reshape(cycles, m) - means[:, None]).mean(axis=0)[:, None], (1, k))
        level = np.full(k, means[0])
        trend = np.full(k, (means[-1] - means[0]) / max(1, (cycles - 1) * m))
    else:
        season = np.zeros((1, k))
        level, trend = np.full(k, y[0]), np.full(k, y[1] - y[0] if len(y) > 1 else 0.0)
    cycle = max(m, 1)
    error = np.zeros(k)
    for t, v in enumerate(y):
        s = season[t % cycle]
        base = level + phi * trend
        miss = v - (base + s)
        error += miss * miss
        # Error-correction form of the recursion.
        level = base + alpha * miss
        trend = phi * trend + alpha * beta * miss
        if m:
            season[t % cycle] = s + gamma * (1 - alpha) * miss
    best = int(np.argmin(error))
    h = np.arange(1, steps + 1)
    damp = np.cumsum(phi[best] ** h)
    return level[best] + damp * trend[best] + season[(len(y) + h - 1) % cycle, best]


def _smoothed(d: DataFrame, m: int) -> DataFrame:
    """Add holt and holt_winters forecast arrays; one call per batch of series."""
    schema = T.StructType([*d.schema.fields, *[T.StructField(x, T.ArrayType(T.DoubleType())) for x in SMOOTHED]])

    def run(batches):
        for pdf in batches:
            holt, winters = [], []
            for y, steps in zip(pdf["y"], pdf["steps"]):
                values = np.asarray(y, dtype=float)
                holt.append(smooth(values, int(steps)).tolist())
                winters.append(smooth(values, int(steps), m).tolist() if m > 1 and len(values) >= 2 * m else None)
            yield pdf.assign(holt=pd.Series(holt, index=pdf.index, dtype=object), holt_winters=pd.Series(winters, index=pdf.index, dtype=object))

    return d.mapInPandas(run, schema)


def _predict(d: DataFrame, m: int, methods: list[str]) -> DataFrame:
    """Rows (all columns of d, method, predicted array); d has y and steps."""
    if any(x in SMOOTHED for x in methods):
        d = _smoothed(d, m)
    simple = _simple(F.col("y"), F.col("steps"), m)
    made = {x: simple[x] if x in simple else F.col(x) for x in methods}
    rows = F.array(*[F.struct(F.lit(x).alias("method"), F.lit(METHODS.index(x)).alias("place"), v.alias("predicted")) for x, v in made.items()])
    keep = [c(x) for x in d.columns if x not in SMOOTHED]
    return d.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*").where("predicted is not null")


def forecast_simple(series: DataFrame, keys: list[str], horizon: int, period: str, method: str) -> DataFrame:
    """Future values of one method: keys, step, period, forecast."""
    d = as_arrays(series, keys).withColumn("steps", F.lit(horizon))
    p = _predict(d, CYCLES[period], [method])
    return _future(p, keys, period).select(*[c(k) for k in keys], "step", "period", "forecast")


def _future(p: DataFrame, keys: list[str], period: str) -> DataFrame:
    one = p.select("*", F.posexplode("predicted").alias("_i", "forecast"))
    amount, unit = STEPS[period].split()
    step = F.col("_i") + 1
    if unit.startswith("day"):
        when = F.col("last_period") + F.make_dt_interval(step * int(amount))
    else:
        months = int(amount) * (12 if unit.startswith("year") else 1)
        when = F.col("last_period") + F.make_ym_interval(F.lit(0), step * months)
    return one.withColumn("step", step).withColumn("period", when)


def _held_out(series: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    d = as_arrays(series, keys)
    hold = F.least(F.greatest(F.lit(horizon), F.lit(3)), F.greatest(F.lit(3), F.floor(F.col("n") / 5).cast("int")))
    d = d.withColumn("steps", hold)
    return d.withColumn("actual", F.slice("y", F.col("n") - F.col("steps") + 1, F.col("steps"))).withColumn("y", F.slice("y", F.lit(1), F.col("n") - F.col("steps")))


def backtest(series: DataFrame, keys: list[str], horizon: int, period: str, methods: list[str] = METHODS) -> DataFrame:
    """MAE, RMSE and MAPE of every method on the held-back last periods of each series."""
    p = _predict(_held_out(series, keys, horizon), CYCLES[period], methods)
    add = lambda a, x: a + x
    errors = F.zip_with("actual", "predicted", lambda a, b: a - b)
    shares = F.filter(F.zip_with("actual", "predicted", lambda a, b: F.when(a != 0, F.abs((a - b) / a))), lambda x: x.isNotNull())
    mean = lambda arr: F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), add) / F.size(arr))
    p = p.withColumn("_e", errors).withColumn("_s", shares)
    return p.select(
        *[c(k) for k in keys], "method", "place", F.col("steps").alias("holdout"),
        mean(F.transform("_e", F.abs)).alias("mae"),
        F.sqrt(mean(F.transform("_e", lambda x: x * x))).alias("rmse"),
        (100 * mean(F.col("_s"))).alias("mape"),
    )


def best_method(comparison: DataFrame, keys: list[str]) -> DataFrame:
    """The method with the lowest RMSE per series."""
    best = F.min_by(F.struct("method", "rmse", "mae", "holdout"), F.struct("rmse", "place"))
    k = [c(x) for x in keys]
    return comparison.groupBy(*k).agg(best.alias("b")).select(*k, "b.*")


def forecast_best(series: DataFrame, keys: list[str], horizon: int, period: str, methods: list[str] = METHODS) -> DataFrame:
    """Refit each series' best method on all of it; a range that widens with the step."""
    best = best_method(backtest(series, keys, horizon, period, methods), keys)
    d = as_arrays(series, keys).withColumn("steps", F.lit(horizon)).withColumn("_low", F.array_min("y"))
    p = join_keys(_predict(d, CYCLES[period], methods), best.withColumnRenamed("method", "_best"), keys, "inner") if keys else _predict(
        d, CYCLES[period], methods
    ).join(best.withColumnRenamed("method", "_best"), F.col("method") == F.col("_best"))
    f = _future(p.where(F.col("method") == F.col("_best")), keys, period)
    spread = 1.96 * F.col("rmse") * F.greatest(F.sqrt(F.col("step") / F.col("holdout")), F.lit(1.0))
    floor = lambda x: F.when(F.col("_low") >= 0, F.greatest(x, F.lit(0.0))).otherwise(x)
    return f.select(
        *[c(k) for k in keys], "method", "step", "period", floor(F.col("forecast")).alias("forecast"),
        floor(F.col("forecast") - spread).alias("low"), floor(F.col("forecast") + spread).alias("high"),
    )


def beats_naive(comparison: DataFrame, keys: list[str]) -> DataFrame:
    """How much better the best method is than repeating the last value, in percent."""
    k = [c(x) for x in keys]
    best = F.min_by(F.struct("method", "mae"), F.struct("rmse", "place"))
    out = comparison.groupBy(*k).agg(best.alias("b"), F.max(F.when(F.col("method") == "naive", F.col("mae"))).alias("naive_mae"))
    gain = F.coalesce(100 * (1 - F.try_divide(F.col("b.mae"), F.col("naive_mae"))), F.lit(0.0))
    return out.select(*k, F.col("b.method").alias("method"), F.col("b.mae").alias("mae"), "naive_mae", gain.alias("gain_pct"), ((F.col("b.method") != "naive") & (gain > 0)).alias("beats_naive"))


