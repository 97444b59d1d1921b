"""Tables behind charts: histograms, boxes, curves, and which chart suits the data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tabella.functions.ordering import neighbourhoods
from tabella.functions.quantiles import column_quantiles, group_quantiles
from tabella.functions.scalar import c, join_keys, number
from tabella.operators.clean import outlier_counts
from tabella.operators.grouping import top_categories
from tabella.operators.profile import wide_agg
from tabella.operators.stats import k_squared

GRID = 200
REACH = 8


def histogram_bins(df: DataFrame, col: str, bins: int = 20, by: str | None = None) -> DataFrame:
    """Rows per equal-width bin; with ``by``, each outcome's share per bin."""
    v = number(df, col)
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    width = (hi - lo) / bins or 1.0
    index = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    keys = [c(by).cast("string").alias("outcome")] if by else []
    out = df.where(v.isNotNull()).groupBy(index.alias("bin"), *keys).agg(F.count("*").alias("rows"))
    out = out.withColumn("low", F.lit(lo) + F.col("bin") * F.lit(width))
    if by:
        out = out.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy("outcome")))
    return out


def box_stats(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Quartiles, 1.5 x IQR whiskers and outlier counts, whole or per group."""
    d = df.select((c(group).cast("string") if group else F.lit("all")).alias("grp"), number(df, value).alias("v")).dropna()
    q = group_quantiles(d, ["grp"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    return join_keys(d, q, ["grp"]).groupBy("grp").agg(
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
        F.count("*").alias("rows"),
    )


def mean_by_x(df: DataFrame, x: str, y: str) -> DataFrame:
    """Average y at each x."""
    return df.where(c(x).isNotNull()).groupBy(c(x).alias("x")).agg(F.avg(number(df, y)).alias("y")).orderBy("x")


def density_grid(df: DataFrame, col: str, points: int = GRID) -> DataFrame:
    """Gaussian kernel density on a grid, beside the normal curve of the same mean and spread.

    Rows are collapsed to (value, count) first; each distinct value then adds its kernel to the grid points
    within ``REACH`` bandwidths (beyond them it is below 1e-14 of its height), summed before the shuffle.
    """
    d = df.select(number(df, col).alias("v")).dropna()
    a = d.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).first()
    if not a["n"] or not a["s"]:
        raise ValueError(f"'{col}' needs at least two different values.")
    width = a["s"] * a["n"] ** (-0.2)
    step = (a["hi"] - a["lo"]) / (points - 1)
    x = F.lit(a["lo"]) + F.col("point") * F.lit(step)
    z = (x - F.col("v")) / F.lit(width)
    kernel = F.col("n") * F.exp(-0.5 * z * z)
    counted = d.groupBy("v").agg(F.count("*").alias("n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("v") - F.lit(REACH * width + a["lo"])) / F.lit(step))).cast("int")
    last = F.least(F.lit(points - 1), F.floor((F.col("v") + F.lit(REACH * width - a["lo"])) / F.lit(step))).cast("int")
    near = counted.withColumns({"first": first, "last": last}).where("first <= last")
    sums = near.select("v", "n", F.explode(F.sequence("first", "last")).alias("point")).groupBy("point").agg(F.sum(kernel).alias("k"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    out = grid.join(sums, "point", "left").fillna(0.0, subset=["k"])
    unit = math.sqrt(2 * math.pi)
    t = (x - F.lit(a["m"])) / F.lit(a["s"])
    return out.select(
        "point", x.alias("x"), (F.col("k") / F.lit(a["n"] * width * unit)).alias("density"), (F.exp(-0.5 * t * t) / F.lit(a["s"] * unit)).alias("normal")
    )


def matrix_long(df: DataFrame, row: str) -> DataFrame:
    """A wide matrix as (row, column, value)."""
    cols = [x for x in df.columns if x != row]
    return df.unpivot(row, cols, "column_name", "value").withColumnRenamed(row, "row_name")


# ------------------------------------------------------------------ recommendations
def one_numeric(df: DataFrame, col: str) -> tuple[str, str]:
    v = number(df, col)
    f = df.agg(F.count(v).alias("n"), F.count_distinct(v).alias("k"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2")).first()
    if f["n"] < 8 or f["k"] < 3:
        return "histogram", "too few distinct values"
    if f["k"] <= 10:
        return "histogram", f"{f['k']} distinct values"
    flat = df.select(v.alias("v"))
    share = outlier_counts(flat, ["v"])["v"] / f["n"]
    if share >= 0.02:
        return "box", f"outliers {share:.1%}"
    if abs(f["g1"]) >= 1:
        return "box", f"skewness {f['g1']:.2f}"
    p = k_squared(f["n"], f["g1"], f["g2"])[1]
    return ("density", "close to a bell curve") if p is not None and p >= 0.05 else ("histogram", "no strong skew, few outliers")


def one_categorical(df: DataFrame, col: str) -> tuple[str, str]:
    k = df.agg(F.count_distinct(c(col))).first()[0]
    return ("pie", f"{k} categories") if 2 <= k <= 4 else ("bar", f"{k} categories")


def _one_direction(df: DataFrame, x: str, order: str) -> bool:
    """True when x only rises, or only falls, along the order column."""
    d = neighbourhoods(df.select(c(order).alias("o"), number(df, x).alias("x")).dropna(), [], "o", "x", 1, 0)
    move = F.col("x") - F.lag("x").over(Window.partitionBy("_chunk").orderBy("_pos"))
    up, down = d.select(move.alias("m"), "_own").where("_own").agg(F.count_if(F.col("m") > 0), F.count_if(F.col("m") < 0)).first()
    return up == 0 or down == 0


def two_numeric(df: DataFrame, x: str, y: str, order: str | None = None) -> tuple[str, str]:
    """Line for few repeated x, or for x that runs in row order; else scatter."""
    cols = {"x": number(df, x), "y": number(df, y)}
    d = df.select(*[v.alias(n) for n, v in cols.items()]).dropna()
    f = d.agg(F.count("*").alias("n"), F.count_distinct("x").alias("k"), F.corr("x", "y").alias("r")).first()
    if f["n"] and f["k"] <= 30 and f["n"] / f["k"] >= 5:
        return "line", f"{f['k']} distinct values of {x}"
    if order and f["n"] and f["k"] == f["n"] and _one_direction(df, x, order):
        return "line", f"{x} runs in order without repeats"
    r = f["r"]
    word = "unclear" if r is None else "strong" if abs(r) >= 0.7 else "moderate" if abs(r) >= 0.3 else "weak"
    return "scatter", f"{word} relationship"


def numeric_by_category(df: DataFrame, value: str, group: str) -> tuple[str, str]:
    sizes = df.where(c(group).isNotNull()).groupBy(c(group)).agg(F.count(number(df, value)).alias("n"))
    k, low = sizes.agg(F.count("*"), F.min("n")).first()
    if k > 12:
        return "bar", f"{k} groups"
    return ("bar", f"smallest group has {low or 0} rows") if (low or 0) < 5 else ("box", "spread per group")


def recommend_chart(df: DataFrame, profile: dict[str, str]) -> DataFrame:
    """One chart per column, and per pair of a number with another column."""
    nums = [x for x, k in profile.items() if k == "numeric"]
    cats = [x for x, k in profile.items() if k == "categorical"]
    rows = [(x, None, *one_numeric(df, x)) for x in nums] + [(x, None, *one_categorical(df, x)) for x in cats]
    rows += [(a, b, *two_numeric(df, a, b)) for i, a in enumerate(nums) for b in nums[i + 1 :]]
    rows += [(a, b, *numeric_by_category(df, a, b)) for a in nums for b in cats]
    return df.sparkSession.createDataFrame(rows, "first string, second string, chart string, reason string")


# ------------------------------------------------------------------ column report
def column_report(df: DataFrame, profile: dict[str, str], top: int = 10) -> dict[str, DataFrame]:
    """Three tables: numbers, the most common categories, and date ranges."""
    spark = df.sparkSession
    nums = [x for x, k in profile.items() if k == "numeric" and x in df.columns]
    out = {}
    if nums:
        flat = df.select(*[number(df, x).alias(x) for x in nums])
        q = column_quantiles(flat, {x: [0.25, 0.5, 0.75] for x in nums})
        f = wide_agg(flat, {x: F.struct(F.count(c(x)).alias("n"), F.avg(c(x)).alias("m"), F.min(c(x)).alias("lo"), F.max(c(x)).alias("hi")) for x in nums})
        rows = [
            (x, f[x]["n"], q[x][1], q[x][0], q[x][2], f[x]["m"], f[x]["lo"], f[x]["hi"], bool(q[x][1] and f[x]["m"] / q[x][1] > 3))
            for x in nums if f[x]["n"]
        ]
        out["numbers"] = spark.createDataFrame(
            rows, "column_name string, rows long, median double, q1 double, q3 double, mean double, lowest double, highest double, mean_far_above_median boolean"
        )
    cats = [x for x, k in profile.items() if k == "categorical" and x in df.columns]
    if cats:
        tables = [top_categories(df, x, top).withColumn("column_name", F.lit(x)) for x in cats]
        whole = tables[0]
        for t in tables[1:]:
            whole = whole.unionByName(t)
        out["categories"] = whole
    dates = [x for x, k in profile.items() if k == "datetime" and x in df.columns]
    if dates:
        f = wide_agg(df, {x: F.struct(F.date_format(F.min(c(x)), "yyyy-MM-dd").alias("lo"), F.date_format(F.max(c(x)), "yyyy-MM-dd").alias("hi"), F.count(c(x)).alias("n")) for x in dates})
        out["dates"] = spark.createDataFrame([(x, f[x]["lo"], f[x]["hi"], f[x]["n"]) for x in dates], "column_name string, earliest string, latest string, rows long")
    return out


