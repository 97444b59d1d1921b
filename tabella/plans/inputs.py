"""Messy inputs derived from the given tables, once in Spark and once as SQL.

Every derivation keeps whole tables; defects are planted by value (dates and
statuses), so both sides see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabella.operators.clean import normalise_missing
from tabella.session import load

MESSY_SQL = """
messy AS (
  SELECT * FROM (
    SELECT o_orderkey AS order_id, o_custkey AS customer_code,
      CASE WHEN day(o_orderdate) = 5 THEN '?' WHEN day(o_orderdate) = 6 THEN ' N/A ' ELSE o_orderstatus END AS status,
      CASE WHEN day(o_orderdate) = 17 THEN NULL WHEN day(o_orderdate) = 18 THEN 'n/a'
           ELSE '$' || format('{:,.2f}', o_totalprice) END AS price_text,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Y' WHEN '2-HIGH' THEN 'TRUE' WHEN '3-MEDIUM' THEN 'no' ELSE 'f' END AS urgent,
      CASE WHEN day(o_orderdate) = 29 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
      CASE WHEN day(o_orderdate) = 1 AND month(o_orderdate) = 1 THEN 'rare' ELSE '-' END AS note,
      CASE WHEN day(o_orderdate) = 20 THEN 'none' ELSE 'sold to customer number ' || o_custkey END AS remark,
      CAST(NULL AS VARCHAR) AS blank, o_orderstatus AS st
    FROM orders) o
  UNION ALL
  SELECT o_orderkey, o_custkey,
      CASE WHEN day(o_orderdate) = 5 THEN '?' WHEN day(o_orderdate) = 6 THEN ' N/A ' ELSE o_orderstatus END,
      CASE WHEN day(o_orderdate) = 17 THEN NULL WHEN day(o_orderdate) = 18 THEN 'n/a'
           ELSE '$' || format('{:,.2f}', o_totalprice) END,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Y' WHEN '2-HIGH' THEN 'TRUE' WHEN '3-MEDIUM' THEN 'no' ELSE 'f' END,
      CASE WHEN day(o_orderdate) = 29 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END,
      CASE WHEN day(o_orderdate) = 1 AND month(o_orderdate) = 1 THEN 'rare' ELSE '-' END,
      CASE WHEN day(o_orderdate) = 20 THEN 'none' ELSE 'sold to customer number ' || o_custkey END,
      NULL, o_orderstatus
    FROM orders WHERE o_orderstatus = 'P'
  UNION ALL
  SELECT NULL, NULL, '', '?', NULL, 'NA', '-', 'null', NULL, NULL FROM region)
"""

MARKERS_SQL = "('?','-','--','n/a','N/A','NA','na','null','NULL','None','none','missing','Missing','#N/A','.','')"


def _norm(col: str) -> str:
    return f"CASE WHEN trim({col}) NOT IN {MARKERS_SQL} THEN trim({col}) END AS {col}"


TEXT_COLUMNS = ["status", "price_text", "urgent", "order_date", "note", "remark", "blank"]

# Markers turned into nulls, as the loader leaves a file.
LOADED_SQL = (
    MESSY_SQL
    + ", loaded AS (SELECT order_id, customer_code, "
    + ", ".join(_norm(x) for x in TEXT_COLUMNS)
    + " FROM messy)"
)

# Numbers parsed, yes/no tidied, empty rows and columns gone, duplicates gone.
DISTINCT_SQL = (
    LOADED_SQL
    + """, distinct_rows AS (
  SELECT DISTINCT order_id, customer_code, status, try_cast(replace(replace(price_text, '$', ''), ',', '') AS DOUBLE) AS price_text,
    CASE WHEN lower(urgent) IN ('y','true') THEN 'Yes' WHEN lower(urgent) IN ('no','f') THEN 'No' END AS urgent,
    order_date, note, remark
  FROM loaded WHERE order_id IS NOT NULL)"""
)

CLEAN_SQL = (
    DISTINCT_SQL
    + """, cleaned AS (
  SELECT customer_code,
    coalesce(status, (SELECT status FROM distinct_rows WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status,
    coalesce(price_text, (SELECT quantile_cont(price_text, 0.5) FROM distinct_rows)) AS price_text,
    urgent, order_date, coalesce(remark, '') AS remark
  FROM distinct_rows)"""
)


def messy_orders(spark: SparkSession, folder: str) -> DataFrame:
    o = load(spark, folder, "orders")
    day = F.day("o_orderdate")
    rows = o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_code"),
        F.when(day == 5, "?").when(day == 6, " N/A ").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(day == 17, None)
        .when(day == 18, "n/a")
        .otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
        .alias("price_text"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Y")
        .when(F.col("o_orderpriority") == "2-HIGH", "TRUE")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "no")
        .otherwise("f")
        .alias("urgent"),
        F.when(day == 29, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
        F.when((day == 1) & (F.month("o_orderdate") == 1), "rare").otherwise("-").alias("note"),
        F.when(day == 20, "none")
        .otherwise(F.concat(F.lit("sold to customer number "), F.col("o_custkey").cast("string")))
        .alias("remark"),
        F.lit(None).cast("string").alias("blank"),
        F.col("o_orderstatus").alias("_st"),
    )
    repeats = rows.where("_st = 'P'")
    empty = load(spark, folder, "region").select(
        F.lit(None).cast("long").alias("order_id"),
        F.lit(None).cast("long").alias("customer_code"),
        F.lit("").alias("status"),
        F.lit("?").alias("price_text"),
        F.lit(None).cast("string").alias("urgent"),
        F.lit("NA").alias("order_date"),
        F.lit("-").alias("note"),
        F.lit("null").alias("remark"),
        F.lit(None).cast("string").alias("blank"),
    )
    return rows.unionByName(repeats).drop("_st").unionByName(empty)


def loaded_orders(spark: SparkSession, folder: str) -> DataFrame:
    return normalise_missing(messy_orders(spark, folder))


# Orders with planted gaps and real types.
GAPS_SQL = """
gaps AS (
  SELECT o_orderkey, o_orderdate, o_orderpriority,
    CASE WHEN day(o_orderdate) IN (7, 8) THEN NULL ELSE o_totalprice END AS price,
    CASE WHEN day(o_orderdate) = 9 THEN NULL ELSE o_orderstatus END AS status
  FROM orders)
"""


def gap_orders(spark: SparkSession, folder: str) -> DataFrame:
    day = F.day("o_orderdate")
    return load(spark, folder, "orders").select(
        "o_orderkey",
        "o_orderdate",
        "o_orderpriority",
        F.when(~day.isin(7, 8), F.col("o_totalprice")).alias("price"),
        F.when(day != 9, F.col("o_orderstatus")).alias("status"),
    )


GAP_PROFILE = {
    "o_orderkey": "numeric", "o_orderdate": "datetime", "o_orderpriority": "categorical", "price": "numeric", "status": "categorical",
}


def day_text(col: str):
    return F.date_format(col, "yyyy-MM-dd").alias(col)
