"""Customer KPIs, churn, and any number over time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabella.functions.distributions import SIGNIFICANT, t_two_sided
from tabella.functions.scalar import c, moment, number, period_start, whole_days

MONTH_DAYS = 30.44


def _moments(df: DataFrame, cols: dict[str, str], amount: str | None = None) -> DataFrame:
    """customer, when (and amount) with incomplete rows left out."""
    out = [c(cols["customer"]).alias("customer"), moment(df, cols["date"]).alias("when")]
    if amount:
        out.append(number(df, amount).alias("amount"))
    return df.select(*out).dropna(subset=["customer", "when"])


def customer_table(
    df: DataFrame, customer: str, date: str, amount: str | None = None, churn_days: int = 90, as_of: str | None = None,
    digits: int = 2,
) -> DataFrame:
    """One row per customer: activity, value, and whether they have churned."""
    d = _moments(df, {"customer": customer, "date": date}, amount)
    end = F.lit(as_of).cast("timestamp") if as_of else F.lit(d.agg(F.max("when")).first()[0])
    aggs = [F.min("when").alias("first_date"), F.max("when").alias("last_date"), F.count_distinct("when").alias("transactions")]
    if amount:
        aggs.append(F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("total_amount"))
    t = d.groupBy("customer").agg(*aggs)
    n = F.col("transactions")
    months = F.greatest(whole_days(F.col("first_date"), end) / F.lit(MONTH_DAYS), F.lit(1.0))
    t = t.withColumn("relationship_days", whole_days(F.col("first_date"), F.col("last_date")))
    t = t.withColumns(
        {
            "transactions_per_month": F.round(n / months, 3),
            "avg_days_between": F.when(n > 1, F.col("relationship_days") / (n - 1)),
            "days_since_last": whole_days(F.col("last_date"), end),
        }
    )
    if amount:
        t = t.withColumn("avg_amount", F.round(F.col("total_amount") / n, digits))
    return t.withColumn("churned", F.when(F.col("days_since_last") > churn_days, "Yes").otherwise("No")).withColumnRenamed("customer", customer)


def customer_kpis(customers: DataFrame) -> DataFrame:
    """Headline KPIs of a customer table, in one aggregate."""
    lost = F.col("churned") == "Yes"
    share = lambda flag: 100 * F.avg(flag.cast("double"))
    aggs = [
        F.count("*").alias("customers"),
        F.round(share(lost), 1).alias("churn_pct"),
        F.round(F.avg("relationship_days"), 1).alias("avg_relationship_days"),
        F.round(F.avg("transactions"), 2).alias("avg_transactions"),
        F.round(F.avg("transactions_per_month"), 2).alias("avg_transactions_per_month"),
        F.round(share(F.col("transactions") > 1), 1).alias("repeat_pct"),
    ]
    if "total_amount" in customers.columns:
        total = F.col("total_amount")
        aggs += [
            F.round(F.avg(total), 2).alias("avg_revenue"),
            F.round(F.coalesce(F.try_divide(100 * F.sum(F.when(lost, total)), F.sum(total)), F.lit(0.0)), 1).alias("churned_revenue_pct"),
            F.round(F.avg(F.when(~lost, total)), 2).alias("avg_revenue_active"),
            F.round(F.avg(F.when(lost, total)), 2).alias("avg_revenue_churned"),
        ]
    return customers.agg(*aggs)


def churn_trend(df: DataFrame, customer: str, date: str, churn_days: int, period: str = "Month") -> DataFrame:
    """Share of each period's customers who did not come back within ``churn_days``.

    Rows are first reduced to one per (customer, period); the next purchase after
    a period's last one is then the first purchase of the next active period.
    """
    d = _moments(df, {"customer": customer, "date": date})
    active = d.groupBy("customer", period_start(F.col("when"), period).alias("period")).agg(F.min("when").alias("lo"), F.max("when").alias("hi"))
    end = F.lit(d.agg(F.max("when")).first()[0])
    later = F.lead("lo").over(Window.partitionBy("customer").orderBy("period"))
    gone = later.isNull() | (whole_days(F.col("hi"), later) > churn_days)
    out = active.withColumn("gone", gone).groupBy("period").agg(
        F.count("*").alias("active_customers"), F.count_if("gone").alias("customers_lost"), F.max("hi").alias("hi")
    )
    known = F.col("hi") + F.make_dt_interval(F.lit(churn_days)) <= end
    rate = F.round(100 * F.col("customers_lost") / F.col("active_customers"), 2)
    return out.where(known).withColumn("churn_pct", rate).drop("hi").orderBy("period")


def rate_trend(df: DataFrame, flag: str, positive: str, date: str, period: str = "Month") -> DataFrame:
    """Share of rows equal to a value, per period."""
    hit = c(flag).cast("string") == positive
    d = df.where(c(flag).isNotNull()).select(period_start(moment(df, date), period).alias("period"), hit.alias("hit")).where("period is not null")
    return d.groupBy("period").agg(
        F.count("*").alias("rows"), F.count_if("hit").alias("count"), F.round(100 * F.avg(F.col("hit").cast("double")), 2).alias("rate_pct")
    ).orderBy("period")


def kpi_trend(df: DataFrame, date: str, value: str | None, how: str, period: str = "Month") -> DataFrame:
    """Sum, mean or count per period."""
    measure: dict[str, Column] = {"count": F.count("*")}
    if value:
        measure |= {"sum": F.coalesce(F.sum("v"), F.lit(0.0)), "mean": F.avg("v")}
    d = df.select(period_start(moment(df, date), period).alias("period"), (number(df, value) if value else F.lit(1.0)).alias("v"))
    return d.where("period is not null").groupBy("period").agg(measure[how].alias("value")).orderBy("period")


def trend_summary(trend: DataFrame, period: str, col: str, last_n: int = 3) -> DataFrame:
    """Direction of a KPI: slope per period, its p-value, change between the ends.

    The table has one row per period, so numbering it is a small sort.
    """
    spark = trend.sparkSession
    row_no = F.row_number().over(Window.orderBy(c(period))) - 1
    d = trend.where(c(col).isNotNull()).select(row_no.cast("double").alias("x"), c(col).cast("double").alias("y"))
    a = d.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.corr("x", "y").alias("r")).first()
    schema = "direction string, slope double, p_value double, change_pct double, periods long"
    if a["n"] < 4:
        return spark.createDataFrame([("too few periods", None, None, None, a["n"])], schema)
    k = min(last_n, a["n"] // 2)
    first, last = d.agg(F.avg(F.when(F.col("x") < k, F.col("y"))), F.avg(F.when(F.col("x") >= a["n"] - k, F.col("y")))).first()
    r, dof = a["r"], a["n"] - 2
    flat = r is None or math.isnan(r)
    p = 1.0 if flat else 0.0 if abs(r) >= 1 else t_two_sided(spark, r * math.sqrt(dof / (1 - r * r)), dof)
    direction = "no clear trend" if p >= SIGNIFICANT else "rising" if a["slope"] > 0 else "falling"
    return spark.createDataFrame([(direction, a["slope"], p, (last - first) / abs(first) * 100 if first else None, a["n"])], schema)
