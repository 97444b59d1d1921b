"""Queries over cleaning, profiling, row and column edits, and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabella.operators import clean, grouping, profile, wrangle
from tabella.plans.inputs import (
    CLEAN_SQL, GAP_PROFILE, GAPS_SQL, LOADED_SQL, TEXT_COLUMNS,
    day_text, gap_orders, loaded_orders, messy_orders,
)
from tabella.plans.registry import query
from tabella.session import load

PROFILED = {
    "customer_code": "categorical", "status": "categorical", "price_text": "numeric", "urgent": "categorical",
    "order_date": "datetime", "remark": "text",
}


# ------------------------------------------------------------------ cleaning steps
@query(
    "normalise_missing",
    f"WITH {LOADED_SQL} SELECT * FROM loaded",
)
def _(spark, d):
    return clean.normalise_missing(messy_orders(spark, d))


@query(
    "drop_empty_rows_cols",
    f"WITH {LOADED_SQL} SELECT * EXCLUDE (blank) FROM loaded WHERE order_id IS NOT NULL",
)
def _(spark, d):
    return clean.drop_empty_rows_cols(loaded_orders(spark, d))


@query(
    "text_to_number",
    f"""WITH {LOADED_SQL} SELECT order_id, status, order_date,
      try_cast(replace(replace(price_text, '$', ''), ',', '') AS DOUBLE) AS price_text FROM loaded""",
)
def _(spark, d):
    return clean.text_to_number(loaded_orders(spark, d).select("order_id", "status", "order_date", "price_text"))


@query(
    "normalise_yes_no",
    f"""WITH {LOADED_SQL} SELECT order_id, status,
      CASE WHEN lower(urgent) IN ('y','true') THEN 'Yes' WHEN lower(urgent) IN ('no','f') THEN 'No' END AS urgent,
      CASE WHEN customer_code > 700 THEN 'Yes' WHEN customer_code <= 700 THEN 'No' END AS large FROM loaded""",
)
def _(spark, d):
    df = loaded_orders(spark, d).select("order_id", "status", "urgent", (F.col("customer_code") > 700).alias("large"))
    return clean.normalise_yes_no(df)


@query("drop_duplicates", "SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem")
def _(spark, d):
    return clean.drop_duplicates(load(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"))


@query("remove_identifiers", "SELECT o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, d):
    df = load(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), "o_custkey", "o_orderstatus", "o_totalprice")
    return clean.remove_identifiers(df)


@query("set_aside_near_empty", f"WITH {LOADED_SQL} SELECT * EXCLUDE (note, blank) FROM loaded")
def _(spark, d):
    return clean.set_aside_near_empty(loaded_orders(spark, d))


@query(
    "parse_dates",
    f"""WITH {LOADED_SQL} SELECT order_id, strftime(try_strptime(order_date, '%Y-%m-%d'), '%Y-%m-%d') AS order_date,
     strftime(try_strptime(order_date, '%Y-%m-%d'), '%Y-%m-%d') AS us_date FROM loaded""",
)
def _(spark, d):
    df = loaded_orders(spark, d).select("order_id", "order_date")
    us = F.date_format(F.try_to_timestamp("order_date", F.lit("yyyy-MM-dd")), "MM/dd/yyyy")
    df = clean.parse_dates(df.withColumn("us_date", us), ["order_date", "us_date"])
    return df.select("order_id", day_text("order_date"), day_text("us_date"))


# One spelling for each order, dealt by key: (DuckDB format, Spark format).
SPELLINGS = [
    ("%Y-%m-%d", "yyyy-MM-dd"), ("%-m/%-d/%Y", "M/d/yyyy"), ("%Y-%m-%d %H:%M", "yyyy-MM-dd HH:mm"), ("%Y-%m-%dT%H:%M:%SZ", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    ("%b %-d, %Y", "MMM d, yyyy"), ("%d-%b-%Y", "dd-MMM-yyyy"), ("%d.%m.%Y", "dd.MM.yyyy"), ("%Y%m%d", "yyyyMMdd"), ("%-m/%-d/%Y %H:%M", "M/d/yyyy HH:mm"),
    ("%Y/%m/%d", "yyyy/MM/dd"), ("%B %-d, %Y", "MMMM d, yyyy"),
]


@query(
    "parse_dates_spellings",
    "WITH o AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % "
    + str(len(SPELLINGS))
    + " "
    + " ".join(f"WHEN {i} THEN strptime(strftime(o_orderdate, '{a}'), '{a}')" for i, (a, _) in enumerate(SPELLINGS))
    + " END AS d FROM orders) SELECT o_orderkey, strftime(d, '%Y-%m-%d %H:%M') AS parsed FROM o",
)
def _(spark, d):
    written = F.lit(None).cast("string")
    for i, (_, form) in enumerate(SPELLINGS):
        written = F.when(F.col("o_orderkey") % len(SPELLINGS) == i, F.date_format("o_orderdate", form)).otherwise(written)
    df = clean.parse_dates(load(spark, d, "orders").select("o_orderkey", written.alias("parsed")), ["parsed"])
    return df.select("o_orderkey", F.date_format("parsed", "yyyy-MM-dd HH:mm").alias("parsed"))


GAP_OUT = "o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority"


def _gap_out(df):
    return df.select("o_orderkey", day_text("o_orderdate"), "o_orderpriority", "price", "status")


@query(
    "fill_automatic",
    f"""WITH {GAPS_SQL} SELECT {GAP_OUT}, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM gaps)) AS price,
     coalesce(status, (SELECT status FROM gaps WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status
     FROM gaps""",
)
def _(spark, d):
    return _gap_out(clean.fill_automatic(gap_orders(spark, d), GAP_PROFILE))


@query(
    "fill_mean",
    f"""WITH {GAPS_SQL} SELECT {GAP_OUT}, round(coalesce(price, (SELECT avg(price) FROM gaps)), 4) AS price,
     coalesce(status, (SELECT status FROM gaps WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status
     FROM gaps""",
)
def _(spark, d):
    return _gap_out(clean.fill_mean(gap_orders(spark, d), GAP_PROFILE)).withColumn("price", F.round("price", 4))


@query(
    "fill_zero_unknown",
    f"WITH {GAPS_SQL} SELECT {GAP_OUT}, coalesce(price, 0) AS price, coalesce(status, 'Unknown') AS status FROM gaps",
)
def _(spark, d):
    return _gap_out(clean.fill_zero_unknown(gap_orders(spark, d), GAP_PROFILE))


FORWARD_SQL = """
  coalesce(last_value({0} IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING),
           first_value({0} IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {0}"""


@query(
    "fill_forward",
    f"WITH {GAPS_SQL} SELECT {GAP_OUT}, {FORWARD_SQL.format('price')}, {FORWARD_SQL.format('status')} FROM gaps",
)
def _(spark, d):
    return _gap_out(clean.fill_forward(gap_orders(spark, d), GAP_PROFILE, tie="o_orderkey"))


@query(
    "fill_forward_text",
    f"""WITH {GAPS_SQL}, g AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, price FROM gaps)
     SELECT o_orderkey, day, last_value(price IGNORE NULLS) OVER (ORDER BY day, o_orderkey ROWS UNBOUNDED PRECEDING) AS price FROM g""",
)
def _(spark, d):
    df = gap_orders(spark, d).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "price")
    return clean.fill_column(df, "price", "forward", "day", "o_orderkey")


@query("fill_drop_rows", f"WITH {GAPS_SQL} SELECT {GAP_OUT}, price, status FROM gaps WHERE price IS NOT NULL AND status IS NOT NULL")
def _(spark, d):
    return _gap_out(clean.fill_drop_rows(gap_orders(spark, d), GAP_PROFILE))


@query(
    "fill_column",
    f"""WITH {GAPS_SQL} SELECT {GAP_OUT}, status,
      first_value(price IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price FROM gaps""",
)
def _(spark, d):
    return _gap_out(clean.fill_column(gap_orders(spark, d), "price", "backward", "o_orderdate", "o_orderkey"))


@query(
    "flag_outliers_iqr",
    """WITH lim AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3,
         quantile_cont(l_quantity * l_quantity * l_quantity, 0.25) AS r1, quantile_cont(l_quantity * l_quantity * l_quantity, 0.75) AS r3 FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_extendedprice AS price, l_quantity * l_quantity * l_quantity AS cubed,
         l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1) AS price_outlier,
         l_quantity * l_quantity * l_quantity < r1 - 1.5 * (r3 - r1) OR l_quantity * l_quantity * l_quantity > r3 + 1.5 * (r3 - r1) AS cubed_outlier
       FROM lineitem, lim""",
)
def _(spark, d):
    q = F.col("l_quantity")
    df = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), (q * q * q).alias("cubed"))
    return clean.flag_outliers_iqr(df, ["price", "cubed"])


# ------------------------------------------------------------------ whole cleaning runs
@query("clean_table", f"WITH {CLEAN_SQL} SELECT * FROM cleaned")
def _(spark, d):
    return clean.clean_table(loaded_orders(spark, d)).table.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


@query(
    "clean_metrics",
    f"""WITH {CLEAN_SQL}, lim AS (SELECT quantile_cont(price_text, 0.25) AS q1, quantile_cont(price_text, 0.75) AS q3 FROM cleaned)
     SELECT (SELECT count(*) FROM cleaned) AS rows_after, 6 AS columns_kept,
       (SELECT count(*) FROM loaded) - (SELECT count(*) FROM cleaned) AS rows_removed,
       (SELECT count(*) FILTER (status IS NULL) + count(*) FILTER (price_text IS NULL) + count(*) FILTER (remark IS NULL) FROM distinct_rows) AS values_filled,
       (SELECT count(*) FROM cleaned, lim WHERE price_text < q1 - 1.5 * (q3 - q1) OR price_text > q3 + 1.5 * (q3 - q1)) AS outliers_flagged""",
)
def _(spark, d):
    return clean.clean_table(loaded_orders(spark, d)).metrics()


@query("clean_report")
def _(spark, d):
    return clean.clean_table(loaded_orders(spark, d)).report()


@query(
    "clean_full_table",
    f"""WITH {LOADED_SQL}, u AS (
      SELECT DISTINCT order_id, customer_code, status, try_cast(replace(replace(price_text, '$', ''), ',', '') AS DOUBLE) AS price_text,
        urgent, order_date, note, remark, blank FROM loaded)
     SELECT customer_code, coalesce(status, (SELECT status FROM u WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status,
       coalesce(price_text, (SELECT quantile_cont(price_text, 0.5) FROM u)) AS price_text, order_date,
       coalesce(urgent, (SELECT urgent FROM u WHERE urgent IS NOT NULL GROUP BY urgent ORDER BY count(*) DESC, urgent LIMIT 1)) AS urgent, remark
     FROM (SELECT * REPLACE (coalesce(customer_code, (SELECT customer_code FROM u WHERE customer_code IS NOT NULL GROUP BY customer_code ORDER BY count(*) DESC, customer_code LIMIT 1)) AS customer_code) FROM u)""",
)
def _(spark, d):
    out, _ = clean.clean_full_table(loaded_orders(spark, d), PROFILED, ["order_id"])
    return out.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


@query(
    "clean_then_group",
    f"""WITH {CLEAN_SQL} SELECT strftime(date_trunc('month', CAST(order_date AS DATE)), '%Y-%m-%d') AS month, urgent, count(*) AS rows_in_group,
      round(sum(price_text), 3) AS price_text_sum, round(avg(price_text), 3) AS price_text_mean, round(median(price_text), 3) AS price_text_median
      FROM cleaned GROUP BY ALL""",
)
def _(spark, d):
    done = clean.clean_table(loaded_orders(spark, d)).table
    out = grouping.group_summary(done, ["urgent"], ["price_text"], ["sum", "mean", "median"], "order_date", "Month")
    return out.select(F.date_format("order_date_month", "yyyy-MM-dd").alias("month"), *[x for x in out.columns if x != "order_date_month"])


# ------------------------------------------------------------------ profile and quality tables
@query(
    "profile_columns",
    """SELECT * FROM (VALUES ('order_id','identifier'), ('customer_code','categorical'), ('status','categorical'), ('price_text','text'),
      ('urgent','categorical'), ('order_date','datetime'), ('note','categorical'), ('remark','text'), ('blank','categorical')) t(column_name, kind)""",
)
def _(spark, d):
    return profile.profile_table(loaded_orders(spark, d).dropna("all").dropDuplicates())


@query(
    "missing_table",
    f"WITH {LOADED_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{x}' AS column_name, count(*) - count({x}) AS missing, round(100.0 * (count(*) - count({x})) / count(*), 1) AS missing_pct FROM loaded"
        for x in ["order_id", "customer_code", *TEXT_COLUMNS]
    ),
)
def _(spark, d):
    return profile.missing_table(loaded_orders(spark, d))


@query(
    "summarize_table",
    " UNION ALL ".join(
        f"""SELECT '{x}' AS column_name, '{t}' AS stored_as, count(*) AS rows, 0e0 AS missing_pct, count(DISTINCT {x}) AS distinct_values,
        {lo} AS min_value, {hi} AS max_value, {m} AS mean FROM orders"""
        for x, t, lo, hi, m in [
            ("o_orderkey", "bigint", "min(o_orderkey)::VARCHAR", "max(o_orderkey)::VARCHAR", "round(avg(o_orderkey), 2)"),
            ("o_orderstatus", "string", "min(o_orderstatus)", "max(o_orderstatus)", "NULL::DOUBLE"),
            ("o_orderpriority", "string", "min(o_orderpriority)", "max(o_orderpriority)", "NULL::DOUBLE"),
            ("o_orderdate", "timestamp", "strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S')", "strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S')", "NULL::DOUBLE"),
        ]
    ),
)
def _(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return profile.summarize_table(df, exact=True)


@query(
    "data_quality_report",
    f"""WITH {CLEAN_SQL}, lim AS (SELECT quantile_cont(price_text, 0.25) AS q1, quantile_cont(price_text, 0.75) AS q3 FROM cleaned),
     facts AS ("""
    + " UNION ALL ".join(
        f"SELECT '{x}' AS column_name, count(*) - count({x}) AS missing, round(100.0 * (count(*) - count({x})) / count(*), 2) AS missing_pct, count(DISTINCT {x}) AS distinct_values FROM loaded"
        for x in ["order_id", "customer_code", *TEXT_COLUMNS]
    )
    + """), notes(column_name, kind, scale_type, kept) AS (VALUES ('order_id','removed (identifier)','identifier/text','no'),
      ('customer_code','categorical','nominal','yes'), ('status','categorical','nominal','yes'), ('price_text','numeric','ratio','yes'),
      ('urgent','categorical','nominal','yes'), ('order_date','datetime','interval','yes'), ('note','removed (identifier)','identifier/text','no'),
      ('remark','text','identifier/text','yes'), ('blank','removed (identifier)','identifier/text','no'))
     SELECT f.*, kind, scale_type, CASE WHEN column_name = 'price_text' THEN
       (SELECT count(*) FROM cleaned, lim WHERE price_text < q1 - 1.5 * (q3 - q1) OR price_text > q3 + 1.5 * (q3 - q1)) END AS outliers, kept
     FROM facts f JOIN notes USING (column_name)""",
)
def _(spark, d):
    raw = loaded_orders(spark, d)
    done = clean.clean_table(raw)
    return profile.data_quality_report(raw, done.table, done.profile)


@query(
    "scale_types",
    """SELECT * FROM (VALUES ('size','categorical','ordinal'), ('segment','categorical','nominal'), ('balance','numeric','interval'),
       ('price','numeric','ratio'), ('sold','datetime','interval')) t(column_name, kind, scale_type)""",
)
def _(spark, d):
    o = load(spark, d, "orders")
    df = o.select(
        F.when(F.col("o_totalprice") < 1e5, "Low").when(F.col("o_totalprice") < 3e5, "Medium").otherwise("HIGH").alias("size"),
        F.col("o_orderstatus").alias("segment"),
        (F.col("o_totalprice") - 200000).alias("balance"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("sold"),
    )
    kinds = {"size": "categorical", "segment": "categorical", "balance": "numeric", "price": "numeric", "sold": "datetime"}
    return profile.scale_types(df, kinds)


@query(
    "detect_problem_type",
    "SELECT * FROM (VALUES ('l_extendedprice','regression'), ('l_linenumber','classification'), ('l_returnflag','classification')) t(target, problem)",
)
def _(spark, d):
    li = load(spark, d, "lineitem")
    rows = [(x, profile.detect_problem_type(li, x)) for x in ("l_extendedprice", "l_linenumber", "l_returnflag")]
    return spark.createDataFrame(rows, "target string, problem string")


# ------------------------------------------------------------------ column and row edits
@query("drop_columns", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _(spark, d):
    return wrangle.drop_columns(load(spark, d, "customer"), ["c_acctbal", "c_mktsegment"])


@query("rename_column", "SELECT s_suppkey AS supplier_no, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, d):
    return wrangle.rename_column(load(spark, d, "supplier"), "s_suppkey", "supplier_no")


@query("rename_all", "SELECT n_nationkey AS key, n_name AS label, n_regionkey AS region FROM nation")
def _(spark, d):
    return wrangle.rename_all(load(spark, d, "nation"), ["key", "label", "region"])


@query("rename_map", "SELECT p_partkey AS part_no, p_name, p_brand AS brand, p_type, p_size, p_retailprice FROM part")
def _(spark, d):
    return wrangle.rename_map(load(spark, d, "part"), {"p_partkey": "part_no", "p_brand": "brand"})


@query(
    "calc_column",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_extendedprice, round(l_extendedprice * l_quantity, 4) AS times,
       round(l_extendedprice / nullif(l_tax, 0), 4) AS ratio, round(l_quantity - 25, 4) AS less, round(l_quantity + l_tax, 4) AS plus FROM lineitem""",
)
def _(spark, d):
    df = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_extendedprice")
    df = wrangle.calc_column(df, "times", "l_extendedprice", "*", "l_quantity")
    df = wrangle.calc_column(df, "ratio", "l_extendedprice", "/", "l_tax")
    df = wrangle.calc_column(df, "less", "l_quantity", "-", 25)
    df = wrangle.calc_column(df, "plus", "l_quantity", "+", "l_tax")
    return df.withColumns({x: F.round(x, 4) for x in ("times", "ratio", "less", "plus")})


@query("filter_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def _(spark, d):
    return wrangle.filter_range(load(spark, d, "lineitem"), "l_quantity", 10, 20).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_dates", "SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def _(spark, d):
    return wrangle.filter_dates(load(spark, d, "events"), "ts", "2024-01-05", "2024-01-12").select("event_id", "event_type")


@query("filter_values", "SELECT p_partkey, p_size, p_brand FROM part WHERE CAST(p_size AS VARCHAR) IN ('1', '7', '49')")
def _(spark, d):
    return wrangle.filter_values(load(spark, d, "part"), "p_size", ["1", "7", "49"]).select("p_partkey", "p_size", "p_brand")


@query(
    "override_type",
    """SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS l_quantity, l_returnflag FROM lineitem""",
)
def _(spark, d):
    df = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    df, _ = wrangle.override_type(df, "l_quantity", "categorical")
    return wrangle.override_type(df, "l_returnflag", "numeric")[0]


@query(
    "safe_columns",
    "SELECT n_nationkey AS nation_key, n_name AS nation_name, n_regionkey AS col_2, n_regionkey AS nation_key_2 FROM nation",
)
def _(spark, d):
    n = load(spark, d, "nation")
    return wrangle.safe_columns(n.select("n_nationkey", "n_name", "n_regionkey", F.col("n_regionkey").alias("again")).toDF("nation key", " nation-name%", "??", "nation.key"))


@query(
    "escape_formulas",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '''=' || c_name WHEN c_mktsegment = 'MACHINERY' THEN '''@x'
       WHEN c_acctbal < 0 THEN printf('%.2f', c_acctbal) ELSE c_name END AS cell, c_mktsegment AS "'+seg" FROM customer""",
)
def _(spark, d):
    seg = F.col("c_mktsegment")
    df = load(spark, d, "customer").select(
        "c_custkey",
        F.when(seg == "BUILDING", F.concat(F.lit("="), F.col("c_name")))
        .when(seg == "MACHINERY", "@x")
        .when(F.col("c_acctbal") < 0, F.format_string("%.2f", "c_acctbal"))
        .otherwise(F.col("c_name"))
        .alias("cell"),
        seg.alias("+seg"),
    )
    return wrangle.escape_formulas(df)


@query(
    "add_date_parts",
    "SELECT o_orderkey, year(o_orderdate) AS year, strftime(o_orderdate, '%m') AS month, strftime(o_orderdate, '%d') AS day FROM orders",
)
def _(spark, d):
    return wrangle.add_date_parts(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query(
    "stringify_nested",
    """SELECT user_id, CAST(to_json(list_sort(list(DISTINCT event_type))) AS VARCHAR) AS kinds, count(*) AS n FROM events GROUP BY user_id""",
)
def _(spark, d):
    df = load(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"), F.count("*").alias("n"))
    return clean.stringify_nested(df)


# ------------------------------------------------------------------ grouping
@query(
    "group_summary",
    """WITH o AS (SELECT *, sqrt(o_totalprice) AS worth FROM orders)
      SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, o_orderpriority, count(*) AS rows_in_group,
      round(sum(worth), 3) AS worth_sum, round(avg(worth), 3) AS worth_mean, round(median(worth), 3) AS worth_median,
      count(worth) AS worth_count, round(min(worth), 3) AS worth_min, round(max(worth), 3) AS worth_max,
      round(stddev_samp(worth), 3) AS worth_std, count(DISTINCT worth) AS worth_nunique
      FROM o GROUP BY ALL""",
)
def _(spark, d):
    df = load(spark, d, "orders").withColumn("worth", F.sqrt("o_totalprice"))
    out = grouping.group_summary(df, ["o_orderpriority"], ["worth"], list(grouping.FUNCS), "o_orderdate", "Month")
    return out.withColumn("month", F.date_format("o_orderdate_month", "yyyy-MM-dd")).drop("o_orderdate_month")


@query(
    "group_summary_missing_keys",
    f"""WITH {GAPS_SQL} SELECT status, count(*) AS rows_in_group, round(coalesce(sum(price), 0), 3) AS price_sum, count(price) AS price_count FROM gaps GROUP BY status""",
)
def _(spark, d):
    return grouping.group_summary(gap_orders(spark, d), ["status"], ["price"], ["sum", "count"])


@query(
    "period_start",
    """SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS d, strftime(date_trunc('week', ts), '%Y-%m-%d') AS w,
      strftime(date_trunc('month', ts), '%Y-%m-%d') AS m, strftime(date_trunc('quarter', ts), '%Y-%m-%d') AS q, strftime(date_trunc('year', ts), '%Y-%m-%d') AS y FROM events""",
)
def _(spark, d):
    from tabella.functions.scalar import period_start

    parts = {"d": "Day", "w": "Week", "m": "Month", "q": "Quarter", "y": "Year"}
    return load(spark, d, "events").select(
        "event_id", *[F.date_format(period_start(F.col("ts"), p), "yyyy-MM-dd").alias(x) for x, p in parts.items()]
    )


@query(
    "pivot_table",
    """WITH c AS (SELECT coalesce(l_returnflag, 'All') AS l_returnflag, coalesce(l_linestatus, 'All') AS s, median(l_extendedprice) AS v
       FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus))
       SELECT l_returnflag, round(max(v) FILTER (s = 'F'), 3) AS "F", round(max(v) FILTER (s = 'O'), 3) AS "O", round(max(v) FILTER (s = 'All'), 3) AS "All"
       FROM c GROUP BY l_returnflag""",
)
def _(spark, d):
    return grouping.pivot_table(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice", ["F", "O"], "median")


@query(
    "pivot_long",
    """SELECT coalesce(c_mktsegment, 'All') AS c_mktsegment, coalesce(c_nationkey::VARCHAR, 'All') AS c_nationkey, round(avg(c_acctbal), 3) AS value FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)""",
)
def _(spark, d):
    return grouping.pivot_long(load(spark, d, "customer"), "c_mktsegment", "c_nationkey", "c_acctbal", "mean")


@query(
    "pivot_table_sum",
    """WITH c AS (SELECT coalesce(strftime(date_trunc('year', o_orderdate), '%Y-%m-%d %H:%M:%S'), 'All') AS yr, coalesce(o_orderstatus, 'All') AS s, sum(o_totalprice) AS v
       FROM orders GROUP BY CUBE (date_trunc('year', o_orderdate), o_orderstatus))
       SELECT yr AS o_orderdate_year, round(max(v) FILTER (s = 'F'), 3) AS "F", round(max(v) FILTER (s = 'O'), 3) AS "O", round(max(v) FILTER (s = 'P'), 3) AS "P",
       round(max(v) FILTER (s = 'All'), 3) AS "All" FROM c GROUP BY yr""",
)
def _(spark, d):
    return grouping.pivot_table(load(spark, d, "orders"), "o_orderdate", "o_orderstatus", "o_totalprice", ["F", "O", "P"], "sum", "o_orderdate", "Year")


@query(
    "rollup_min_mean_max",
    """SELECT year(o_orderdate) AS year, strftime(o_orderdate, '%m') AS month, strftime(o_orderdate, '%d') AS day,
       min(o_totalprice) AS o_totalprice_min, round(avg(o_totalprice), 6) AS o_totalprice_mean, max(o_totalprice) AS o_totalprice_max,
       CASE grouping(year(o_orderdate), strftime(o_orderdate, '%m'), strftime(o_orderdate, '%d')) WHEN 3 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END AS level
       FROM orders GROUP BY GROUPING SETS ((year(o_orderdate)), (year(o_orderdate), strftime(o_orderdate, '%m')),
         (year(o_orderdate), strftime(o_orderdate, '%m'), strftime(o_orderdate, '%d')))""",
)
def _(spark, d):
    out = grouping.rollup_min_mean_max(load(spark, d, "orders"), "o_orderdate", ["o_totalprice"])
    return out.withColumn("o_totalprice_mean", F.round("o_totalprice_mean", 6))


@query(
    "daily_totals",
    f"""WITH {LOADED_SQL}, t AS (SELECT order_date, try_cast(replace(replace(price_text, '$', ''), ',', '') AS DOUBLE) AS v FROM loaded)
       SELECT order_date AS d, round(sum(v), 2) AS total, count(v) AS n FROM t WHERE v IS NOT NULL AND order_date IS NOT NULL GROUP BY order_date""",
)
def _(spark, d):
    out = grouping.daily_totals(loaded_orders(spark, d), "order_date", "price_text")
    return out.select(F.date_format("d", "yyyy-MM-dd").alias("d"), F.round("total", 2).alias("total"), "n")


@query(
    "top_n_other",
    """WITH n AS (SELECT p_brand, count(*) AS c FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, p_brand) AS k FROM n)
       SELECT CASE WHEN k <= 6 THEN p_brand ELSE 'Other' END AS category, CAST(sum(c) AS BIGINT) AS rows, round(100.0 * sum(c) / (SELECT count(*) FROM part), 1) AS percent FROM r GROUP BY 1""",
)
def _(spark, d):
    return grouping.top_n_other(load(spark, d, "part"), "p_brand", 6)


@query(
    "top_categories",
    """SELECT p_brand AS value, count(*) AS rows, round(100.0 * count(*) / (SELECT count(*) FROM part), 1) AS share FROM part GROUP BY 1 ORDER BY rows DESC, value LIMIT 10""",
)
def _(spark, d):
    return grouping.top_categories(load(spark, d, "part"), "p_brand")


@query("extreme_rows", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5")
def _(spark, d):
    return grouping.extreme_rows(load(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 5)


