"""Group, summarize, pivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabella.functions.quantiles import column_quantiles, group_quantiles
from tabella.functions.scalar import c, is_number, join_keys, moment, period_start
from tabella.session import few_rows

FUNCS = ("sum", "mean", "median", "count", "min", "max", "std", "nunique")
MARGIN_FUNCS = ("sum", "count", "mean", "median", "min", "max")


def aggregate(func: str, col: str) -> Column:
    """One summary function as a Spark aggregate."""
    if func == "sum":
        return F.coalesce(F.sum(c(col)), F.lit(0))
    if func == "mean":
        return F.avg(c(col))
    if func == "median":
        return F.median(c(col))
    if func == "count":
        return F.count(c(col))
    if func == "min":
        return F.min(c(col))
    if func == "max":
        return F.max(c(col))
    if func == "std":
        return F.stddev_samp(c(col))
    if func == "nunique":
        return F.count_distinct(c(col))
    raise ValueError(f"Unknown function '{func}'; use one of {', '.join(FUNCS)}.")


def grouped(df: DataFrame, keys: list[str], measures: list[tuple[str, str, str]], rows: str | None = None) -> DataFrame:
    """Aggregate (column, function, output name) measures; medians stay splittable."""
    small = few_rows(df)
    direct = [m for m in measures if small or m[1] != "median"]
    aggs = ([F.count("*").alias(rows)] if rows else []) + [aggregate(f, v).alias(o) for v, f, o in direct]
    out = df.groupBy(*[c(k) for k in keys]).agg(*(aggs or [F.count("*").alias("_rows")]))
    for v, _, o in [m for m in measures if m not in direct]:
        if keys:
            out = join_keys(out, group_quantiles(df, keys, v, {o: 0.5}), keys)
        else:
            out = out.withColumn(o, F.lit(column_quantiles(df, {v: [0.5]})[v][0]))
    order = [*keys, *([rows] if rows else []), *[o for _, _, o in measures]]
    return out.select(*[c(n) for n in order])


def round_numbers(df: DataFrame, digits: int, skip: list[str] = ()) -> DataFrame:
    """Round every fractional column."""
    fractional = ("double", "float")
    return df.select(
        *[
            F.round(c(n), digits).alias(n) if t in fractional and n not in skip else c(n)
            for n, t in df.dtypes
        ]
    )


def with_period(df: DataFrame, date_col: str, period: str, name: str | None = None) -> tuple[DataFrame, str]:
    name = name or f"{date_col}_{period.lower()}"
    return df.withColumn(name, period_start(moment(df, date_col), period)), name


def group_summary(
    df: DataFrame,
    by: list[str],
    values: list[str],
    funcs: list[str],
    date_col: str | None = None,
    period: str | None = None,
    digits: int = 3,
    sort: bool = True,
) -> DataFrame:
    """One row per group, missing keys kept, one column per (value, function)."""
    if not by and not (date_col and period):
        raise ValueError("Pick at least one column to group by.")
    keys = list(by)
    if date_col and period:
        df, name = with_period(df, date_col, period)
        keys = [name] + [k for k in keys if k != date_col]
    measures = [(v, f, f"{v}_{f}") for v in values for f in funcs]
    out = round_numbers(grouped(df, keys, measures, "rows_in_group"), digits, keys)
    if sort and date_col and period:
        return out.orderBy(*[c(k) for k in keys])
    if sort and measures:
        return out.orderBy(c(measures[0][2]).desc(), *[c(k) for k in keys])
    return out


def pivot_long(
    df: DataFrame,
    rows: str,
    cols: str,
    value: str,
    func: str = "sum",
    date_col: str | None = None,
    period: str | None = None,
    digits: int = 3,
) -> DataFrame:
    """(rows, cols, ``value``): one value per pair of categories, with "All" for either or both where that makes sense.

    The table is as long as there are pairs, however many categories there are; nothing about them reaches the driver.
    """
    if date_col and period and rows == date_col:
        df, rows = with_period(df, date_col, period)
    df = df.select(c(rows).cast("string").alias(rows), c(cols).cast("string").alias(cols), c(value)).dropna()
    if func not in MARGIN_FUNCS:
        long = grouped(df, [rows, cols], [(value, func, "_v")])
    elif func == "median" and not few_rows(df):
        total = [(rows, cols), (rows,), (cols,), ()]
        parts = []
        for keys in total:
            part = group_quantiles(df, list(keys), value, {"_v": 0.5})
            for k in (rows, cols):
                if k not in keys:
                    part = part.withColumn(k, F.lit("All"))
            parts.append(part.select(c(rows), c(cols), "_v"))
        long = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    else:
        cube = df.cube(c(rows), c(cols)).agg(
            aggregate(func, value).alias("_v"), F.grouping(c(rows)).alias("_gr"), F.grouping(c(cols)).alias("_gc")
        )
        long = cube.select(
            F.when(F.col("_gr") == 1, "All").otherwise(c(rows)).alias(rows),
            F.when(F.col("_gc") == 1, "All").otherwise(c(cols)).alias(cols),
            "_v",
        )
    return round_numbers(long.select(c(rows), c(cols), F.col("_v").alias("value")), digits)


def pivot_table(
    df: DataFrame,
    rows: str,
    cols: str,
    value: str,
    heads: list[str],
    func: str = "sum",
    date_col: str | None = None,
    period: str | None = None,
    digits: int = 3,
) -> DataFrame:
    """``pivot_long`` as a wide table with a column for each of ``heads``, and "All" where that makes sense.

    The caller names the columns; "All" counts every category, named or not. ``column_heads`` lists them where there are few.
    """
    long = pivot_long(df, rows, cols, value, func, date_col, period, digits)
    named = [*heads, *(["All"] if func in MARGIN_FUNCS else [])]
    key = next(x for x in long.columns if x not in (cols, "value"))
    return long.groupBy(c(key)).pivot(cols, named).agg(F.first("value")).orderBy(c(key))


def column_heads(df: DataFrame, col: str, most: int = 1_000) -> list[str]:
    """The categories of a column in order; an error where there are more than ``most``, which no wide table should have."""
    some = df.select(c(col).cast("string").alias("v")).dropna().distinct().limit(most + 1).collect()
    if len(some) > most:
        raise ValueError(f"'{col}' has more than {most} categories: use the long form, or name the columns.")
    return sorted(r["v"] for r in some)


def rollup_min_mean_max(df: DataFrame, date_col: str, values: list[str]) -> DataFrame:
    """Minimum, mean and maximum per year, per month and per day, in one pass."""
    day = moment(df, date_col)
    d = df.select(
        F.year(day).alias("year"),
        F.date_format(day, "MM").alias("month"),
        F.date_format(day, "dd").alias("day"),
        *[c(v) for v in values],
    )
    aggs = [f(c(v)).alias(f"{v}_{n}") for v in values for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    out = d.rollup("year", "month", "day").agg(F.grouping_id().alias("_g"), *aggs)
    level = F.when(F.col("_g") == 3, "year").when(F.col("_g") == 1, "month").otherwise("day")
    return out.where(F.col("_g") != 7).withColumn("level", level).drop("_g")


def daily_totals(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """Sum and count per calendar day over every row, money text included."""
    from tabella.functions.scalar import dtype, is_text, money_number, number

    value = money_number(c(value_col)) if is_text(dtype(df, value_col)) else number(df, value_col)
    d = df.select(F.to_date(moment(df, date_col)).alias("d"), value.alias("_v"))
    return d.dropna().groupBy("d").agg(F.sum("_v").alias("total"), F.count("_v").alias("n"))


def top_n_other(df: DataFrame, col: str, n: int = 6, other: str = "Other") -> DataFrame:
    """Counts of the n most common values, the rest folded into one."""
    counts = df.where(c(col).isNotNull()).groupBy(c(col).cast("string").alias("category")).agg(F.count("*").alias("rows"))
    top = [r[0] for r in counts.orderBy(F.desc("rows"), "category").limit(n).collect()]
    folded = F.when(F.col("category").isin(top), F.col("category")).otherwise(F.lit(other))
    out = counts.groupBy(folded.alias("category")).agg(F.sum("rows").alias("rows"))
    return out.withColumn("percent", F.round(100 * F.col("rows") / _total(out, "rows"), 1))


def _total(df: DataFrame, col: str) -> Column:
    from pyspark.sql import Window

    return F.sum(col).over(Window.partitionBy())


def top_categories(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The most common values with their share of all rows."""
    counts = df.where(c(col).isNotNull()).groupBy(c(col).cast("string").alias("value")).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    return (
        counts.orderBy(F.desc("rows"), "value").limit(n).withColumn("share", F.round(100 * F.col("rows") / F.lit(total), 1))
    )


def extreme_rows(df: DataFrame, col: str, tie: str, n: int = 5, lowest: bool = True) -> DataFrame:
    """The n rows with the lowest (or highest) value."""
    first = c(col).asc_nulls_last() if lowest else c(col).desc_nulls_last()
    return df.orderBy(first, c(tie)).limit(n)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]

