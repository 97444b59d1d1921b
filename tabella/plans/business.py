"""Queries over preparation, chart tables, KPIs, baskets, text, standardization and forecasts."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabella.operators import basket, chart_tables, forecast, kpi, prepare, profile, standardize, text
from tabella.plans.inputs import day_text
from tabella.plans.registry import query
from tabella.plans.sqltext import rank_avg, t_two_sided
from tabella.session import load


def _round(df, digits, *names):
    return df.withColumns({x: F.round(x, digits) for x in names})


# ------------------------------------------------------------------ preparation
@query(
    "bin_numeric",
    """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)
      SELECT o_orderkey, CASE WHEN o_totalprice <= lo + (hi - lo) / 3 THEN 'Low' WHEN o_totalprice <= lo + (hi - lo) * 2 / 3 THEN 'Medium' ELSE 'High' END AS width_bin,
       CASE WHEN o_totalprice <= a THEN 'Bin 1' WHEN o_totalprice <= b THEN 'Bin 2' WHEN o_totalprice <= c THEN 'Bin 3' ELSE 'Bin 4' END AS count_bin FROM orders, e""",
)
def _(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    df = prepare.bin_numeric(df, "o_totalprice", 3, out="width_bin")
    return prepare.bin_numeric(df, "o_totalprice", 4, "equal frequency", out="count_bin").drop("o_totalprice")


@query(
    "one_hot",
    """SELECT o_orderkey, o_orderstatus, CAST(o_orderstatus = 'F' AS INT) AS "o_orderstatus_F", CAST(o_orderstatus = 'O' AS INT) AS "o_orderstatus_O", CAST(o_orderstatus = 'P' AS INT) AS "o_orderstatus_P" FROM orders""",
)
def _(spark, d):
    return prepare.one_hot(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


@query(
    "one_hot_sparse",
    """WITH p AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS place FROM (SELECT DISTINCT p_type FROM part)) SELECT p_partkey, p.place::INT AS entry, 1.0::DOUBLE AS held, (SELECT count(*) FROM p)::INT AS entries FROM part JOIN p USING (p_type)""",
)
def _(spark, d):
    out = prepare.one_hot_sparse(load(spark, d, "part").select("p_partkey", "p_type"), "p_type", "v")
    v = vector_to_array("v")
    return out.select("p_partkey", (F.array_position(v, F.lit(1.0)) - 1).cast("int").alias("entry"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("held"), F.size(v).alias("entries"))


@query(
    "ordinal_encode",
    """WITH r AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS brand_rank FROM part GROUP BY 1)
      SELECT p_partkey, brand_rank, CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END AS size_rank FROM part JOIN r USING (p_brand)""",
)
def _(spark, d):
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "Medium").otherwise("LARGE")
    df = load(spark, d, "part").select("p_partkey", "p_brand", size.alias("size"))
    df = prepare.ordinal_encode(df, "p_brand", "brand_rank")
    return prepare.ordinal_encode(df, "size", "size_rank").select("p_partkey", "brand_rank", "size_rank")


@query(
    "rescale_minmax",
    "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS c_acctbal FROM customer",
)
def _(spark, d):
    return _round(prepare.rescale_minmax(load(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), 6, "c_acctbal")


@query("rescale_zscore", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def _(spark, d):
    return _round(prepare.rescale_zscore(load(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), 6, "c_acctbal")


@query("transform_log", "SELECT event_id, round(ln(1 + value), 6) AS value FROM events")
def _(spark, d):
    return _round(prepare.transform_log(load(spark, d, "events").select("event_id", "value"), "value"), 6, "value")


@query("transform_sqrt", "SELECT event_id, round(sqrt(value), 6) AS value FROM events")
def _(spark, d):
    return _round(prepare.transform_sqrt(load(spark, d, "events").select("event_id", "value"), "value"), 6, "value")


@query("transform_square", "SELECT event_id, round(value * value, 6) AS value FROM events")
def _(spark, d):
    return _round(prepare.transform_square(load(spark, d, "events").select("event_id", "value"), "value"), 6, "value")


# The exponent to three digits is the best point of a grid of thousandths around the optimum.
LAMBDA_SQL = """WITH v AS (SELECT {x} AS x FROM {t}), coarse AS (SELECT i / 50.0 AS g FROM range(-100, 151) r(i)),
  s1 AS (SELECT g, (g - 1) * sum({w}) - count(*) / 2.0 * ln(var_pop({y})) AS l FROM v, coarse GROUP BY g), top AS (SELECT arg_max(g, l) AS g0 FROM s1),
  fine AS (SELECT g0 + i / 1000.0 AS g FROM top, range(-20, 21) r(i)), s2 AS (SELECT g, (g - 1) * sum({w}) - count(*) / 2.0 * ln(var_pop({y})) AS l FROM v, fine GROUP BY g)
  SELECT '{c}' AS column_name, '{m}' AS method, round(arg_max(g, l), 3) AS lambda FROM s2"""
BOX_Y = "CASE WHEN abs(g) < 1e-12 THEN ln(x) ELSE (pow(x, g) - 1) / g END"
YEO_Y = "CASE WHEN x >= 0 THEN CASE WHEN abs(g) < 1e-12 THEN ln(1 + x) ELSE (pow(x + 1, g) - 1) / g END ELSE CASE WHEN abs(2 - g) < 1e-12 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - g) - 1) / (2 - g) END END"


@query("box_cox", LAMBDA_SQL.format(x="o_totalprice", t="orders", w="ln(x)", y=BOX_Y, c="o_totalprice", m="box-cox"))
def _(spark, d):
    df = load(spark, d, "orders")
    return _round(prepare.fitted_params(df, prepare.fit_gaussian(df, ["o_totalprice"], "box-cox")), 3, "lambda")


@query("yeo_johnson", LAMBDA_SQL.format(x="c_acctbal", t="customer", w="sign(x) * ln(1 + abs(x))", y=YEO_Y, c="c_acctbal", m="yeo-johnson"))
def _(spark, d):
    df = load(spark, d, "customer")
    return _round(prepare.fitted_params(df, prepare.fit_gaussian(df, ["c_acctbal"], "yeo-johnson")), 3, "lambda")


@query(
    "quantile_to_normal",
    """SELECT event_id, value IS NULL AS is_missing, true AS in_order, true AS in_bounds, true AS looks_normal FROM events""",
)
def _(spark, d):
    """Scores keep the order of the values (none is below that of a smaller value), lie within five deviations and are centred with spread one."""
    df = load(spark, d, "events").select("event_id", "value")
    scores = prepare.quantile_to_normal(df.withColumn("score", F.col("value")), "score")
    bands = scores.dropna().groupBy(F.floor("value").alias("band")).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    wrong = bands.alias("a").join(bands.alias("b"), F.col("b.band") == F.col("a.band") + 1).where("b.low < a.high").count()
    centre = scores.agg(F.avg("score").alias("m"), F.stddev("score").alias("s")).first()
    normal = abs(centre["m"]) < 0.05 and 0.9 < centre["s"] < 1.1
    return scores.select("event_id", F.col("value").isNull().alias("is_missing"), F.lit(wrong == 0).alias("in_order"), F.coalesce(F.col("score").between(-5.3, 5.3), F.lit(True)).alias("in_bounds"), F.lit(normal).alias("looks_normal"))


@query("map_to_gaussian")
def _(spark, d):
    df = load(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    return prepare.map_to_gaussian(df, ["l_quantity", "l_extendedprice", "l_discount"])[1]


@query("train_test_split", "SELECT o_orderkey, 1 AS parts, true AS same_again, true AS share_close FROM orders")
def _(spark, d):
    """Every row is in one part, the same one when the table is dealt anew, and the test part has about its share."""
    o = load(spark, d, "orders")
    part = lambda df, name: [x.select("o_orderkey", F.lit(i).alias(name)) for i, x in enumerate(prepare.train_test_split(df, ["o_orderkey"], 0.3))]
    both = part(o, "p")[0].unionByName(part(o, "p")[1])
    again = part(o.repartition(3), "q")[0].unionByName(part(o.repartition(3), "q")[1])
    share = both.agg(F.avg("p").alias("share"), F.count("*").alias("n")).first()
    close = abs(share["share"] - 0.3) <= 6 * (0.21 / share["n"]) ** 0.5
    rows = both.join(again, "o_orderkey").groupBy("o_orderkey")
    return rows.agg(F.count("*").cast("int").alias("parts"), F.bool_and(F.col("p") == F.col("q")).alias("same_again")).withColumn("share_close", F.lit(close))


@query(
    "pca",
    """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT 'PC1' AS component, round((1 + abs(r)) / 2 * 100, 2) AS explained_pct, round((1 + abs(r)) / 2 * 100, 2) AS cumulative_pct FROM c
       UNION ALL SELECT 'PC2', round((1 - abs(r)) / 2 * 100, 2), 100.0 FROM c""",
)
def _(spark, d):
    return prepare.pca(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], 2)[0]


@query(
    "pca_scores",
    """WITH s AS (SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () AS a, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER () AS b,
       (SELECT corr(l_quantity, l_extendedprice) FROM lineitem) AS r FROM lineitem)
       SELECT l_orderkey, l_linenumber, round(abs(CASE WHEN r >= 0 THEN a + b ELSE a - b END) / sqrt(2), 4) AS first_size, round(abs(CASE WHEN r >= 0 THEN a - b ELSE a + b END) / sqrt(2), 4) AS second_size FROM s""",
)
def _(spark, d):
    df = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    scores = prepare.pca(df, ["l_quantity", "l_extendedprice"], 2)[2]
    return scores.select("l_orderkey", "l_linenumber", F.round(F.abs("PC1"), 4).alias("first_size"), F.round(F.abs("PC2"), 4).alias("second_size"))


def _z(x):
    return f"(l_{x} - avg(l_{x}) OVER ()) / stddev_samp(l_{x}) OVER ()"


@query(
    "pca_reduced",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, {_z("quantity")} AS a, {_z("extendedprice")} AS b, {_z("discount")} AS c, {_z("tax")} AS d FROM lineitem)
       SELECT l_orderkey, l_linenumber, round(a * a + b * b + c * c + d * d, 3) AS whole_length, true AS two_are_shorter, true AS two_explain_their_share FROM s""",
)
def _(spark, d):
    """Four columns turned (each row keeps its length, so the axes are orthogonal) and reduced to two that hold what they explain."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    df = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    whole = prepare.pca(df, cols, 4)[2]
    share, _, two = prepare.pca(df, cols, 2)
    explained = share.agg(F.sum("explained_pct")).first()[0]
    held = two.agg(100 * (F.var_samp("PC1") + F.var_samp("PC2")) / len(cols)).first()[0]
    part = F.col("PC1") * F.col("PC1") + F.col("PC2") * F.col("PC2")
    length = part + F.col("PC3") * F.col("PC3") + F.col("PC4") * F.col("PC4")
    return whole.select("l_orderkey", "l_linenumber", F.round(length, 3).alias("whole_length"), (part <= length + 1e-9).alias("two_are_shorter"), F.lit(abs(explained - held) < 0.02).alias("two_explain_their_share"))


# ------------------------------------------------------------------ chart tables
@query(
    "histogram_bins",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem),
      b AS (SELECT CAST(least(floor((l_extendedprice - lo) / w), 29) AS INT) AS bin, l_returnflag AS outcome, lo, w FROM lineitem, e)
      SELECT bin, outcome, count(*) AS rows, round(any_value(lo + bin * w), 4) AS low, round(count(*) / sum(count(*)) OVER (PARTITION BY outcome), 6) AS share FROM b GROUP BY bin, outcome""",
)
def _(spark, d):
    out = chart_tables.histogram_bins(load(spark, d, "lineitem"), "l_extendedprice", 30, "l_returnflag")
    return _round(_round(out, 4, "low"), 6, "share")


@query(
    "box_stats",
    """WITH q AS (SELECT event_type AS grp, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
      j AS (SELECT grp, value AS v, q1, median, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM events JOIN q ON grp = event_type)
      SELECT grp, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, min(v) FILTER (ok) AS whisker_low, max(v) FILTER (ok) AS whisker_high, count(*) FILTER (NOT ok) AS outliers, count(*) AS rows FROM j GROUP BY grp""",
)
def _(spark, d):
    return _round(chart_tables.box_stats(load(spark, d, "events"), "value", "event_type"), 6, "q1", "median", "q3")


@query("mean_by_x", "SELECT l_linenumber AS x, round(avg(l_extendedprice), 4) AS y FROM lineitem GROUP BY 1")
def _(spark, d):
    return _round(chart_tables.mean_by_x(load(spark, d, "lineitem"), "l_linenumber", "l_extendedprice"), 4, "y")


@query(
    "density_grid",
    """WITH a AS (SELECT count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem),
      g AS (SELECT CAST(i AS INT) AS point, lo + i * (hi - lo) / 199 AS x, n, m, s, s * pow(n, -0.2) AS w FROM a, range(200) r(i)), c AS (SELECT l_quantity AS v, count(*) AS k FROM lineitem GROUP BY 1)
      SELECT point, round(x, 6) AS x, round(sum(k * exp(-0.5 * pow((x - v) / w, 2))) / any_value(n * w * sqrt(2 * pi())), 8) AS density, round(any_value(exp(-0.5 * pow((x - m) / s, 2)) / (s * sqrt(2 * pi()))), 8) AS normal FROM g, c GROUP BY point, x""",
)
def _(spark, d):
    return _round(_round(chart_tables.density_grid(load(spark, d, "lineitem"), "l_quantity"), 6, "x"), 8, "density", "normal")


@query("matrix_long", "SELECT o_orderpriority AS row_name, o_orderstatus AS column_name, count(*) AS value FROM orders GROUP BY 1, 2")
def _(spark, d):
    wide = load(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return chart_tables.matrix_long(wide, "o_orderpriority")


@query("recommend_chart")
def _(spark, d):
    kinds = {"l_quantity": "numeric", "l_extendedprice": "numeric", "l_returnflag": "categorical", "l_linenumber": "numeric"}
    return chart_tables.recommend_chart(load(spark, d, "lineitem"), kinds)


@query(
    "column_report",
    """SELECT 'value' AS column_name, count(*) AS rows, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3,
       round(avg(value), 6) AS mean, min(value) AS lowest, max(value) AS highest, avg(value) / median(value) > 3 AS mean_far_above_median FROM events""",
)
def _(spark, d):
    out = chart_tables.column_report(load(spark, d, "events"), {"value": "numeric", "event_type": "categorical", "ts": "datetime"})
    return _round(out["numbers"], 6, "median", "q1", "q3", "mean")


@query("column_report_dates", "SELECT 'ts' AS column_name, strftime(min(ts), '%Y-%m-%d') AS earliest, strftime(max(ts), '%Y-%m-%d') AS latest, count(*) AS rows FROM events")
def _(spark, d):
    return chart_tables.column_report(load(spark, d, "events"), {"ts": "datetime"})["dates"]


# ------------------------------------------------------------------ KPIs
CUST_SQL = """cust AS (SELECT o_custkey, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, count(DISTINCT o_orderdate) AS transactions, round(sum(o_totalprice), 2) AS total_amount FROM orders GROUP BY 1),
  fin AS (SELECT max(o_orderdate) AS fin FROM orders),
  ct AS (SELECT o_custkey, first_date, last_date, transactions, total_amount, datesub('day', first_date, last_date) AS relationship_days,
    round(transactions / greatest(datesub('day', first_date, fin) / 30.44, 1), 3) AS transactions_per_month,
    CASE WHEN transactions > 1 THEN datesub('day', first_date, last_date) / (transactions - 1) END AS avg_days_between, datesub('day', last_date, fin) AS days_since_last,
    round(total_amount / transactions, 6) AS avg_amount, CASE WHEN datesub('day', last_date, fin) > 180 THEN 'Yes' ELSE 'No' END AS churned FROM cust, fin)"""


def _customers(spark, d):
    return kpi.customer_table(load(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", 180, digits=6)


@query(
    "customer_table",
    f"""WITH {CUST_SQL} SELECT o_custkey, strftime(first_date, '%Y-%m-%d') AS first_date, strftime(last_date, '%Y-%m-%d') AS last_date, transactions, total_amount, relationship_days,
      transactions_per_month, round(avg_days_between, 6) AS avg_days_between, days_since_last, avg_amount, churned FROM ct""",
)
def _(spark, d):
    out = _round(_customers(spark, d), 6, "avg_days_between")
    return out.withColumns({x: F.date_format(x, "yyyy-MM-dd") for x in ("first_date", "last_date")})


@query(
    "customer_kpis",
    f"""WITH {CUST_SQL} SELECT count(*) AS customers, round(100.0 * avg(CAST(churned = 'Yes' AS INT)), 1) AS churn_pct, round(avg(relationship_days), 1) AS avg_relationship_days, round(avg(transactions), 2) AS avg_transactions,
      round(avg(transactions_per_month), 2) AS avg_transactions_per_month, round(100.0 * avg(CAST(transactions > 1 AS INT)), 1) AS repeat_pct, round(avg(total_amount), 2) AS avg_revenue,
      round(100 * sum(total_amount) FILTER (churned = 'Yes') / sum(total_amount), 1) AS churned_revenue_pct, round(avg(total_amount) FILTER (churned = 'No'), 2) AS avg_revenue_active, round(avg(total_amount) FILTER (churned = 'Yes'), 2) AS avg_revenue_churned FROM ct""",
)
def _(spark, d):
    return kpi.customer_kpis(_customers(spark, d))


@query(
    "churn_trend",
    """WITH dd AS (SELECT DISTINCT o_custkey AS cu, o_orderdate AS dt FROM orders), nx AS (SELECT *, lead(dt) OVER (PARTITION BY cu ORDER BY dt) AS nxt FROM dd),
      la AS (SELECT cu, date_trunc('month', dt) AS per, max(dt) AS hi, arg_max(nxt, dt) AS nx0 FROM nx GROUP BY 1, 2), la2 AS (SELECT la.cu, per, hi, nxt FROM la JOIN nx ON nx.cu = la.cu AND nx.dt = la.hi),
      g AS (SELECT per, count(*) AS a, count(*) FILTER (nxt IS NULL OR datesub('day', hi, nxt) > 180) AS l, max(hi) AS mx FROM la2 GROUP BY 1)
      SELECT strftime(per, '%Y-%m-%d') AS period, a AS active_customers, l AS customers_lost, round(100.0 * l / a, 2) AS churn_pct FROM g WHERE mx + INTERVAL 180 DAY <= (SELECT max(o_orderdate) FROM orders)""",
)
def _(spark, d):
    out = kpi.churn_trend(load(spark, d, "orders"), "o_custkey", "o_orderdate", 180)
    return out.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query(
    "rate_trend",
    """SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS period, count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS count, round(100.0 * avg(CAST(o_orderstatus = 'F' AS INT)), 2) AS rate_pct FROM orders GROUP BY 1""",
)
def _(spark, d):
    out = kpi.rate_trend(load(spark, d, "orders"), "o_orderstatus", "F", "o_orderdate", "Quarter")
    return out.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query("kpi_trend", "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, round(sum(value), 4) AS value FROM events GROUP BY 1")
def _(spark, d):
    out = kpi.kpi_trend(load(spark, d, "events"), "ts", "value", "sum", "Week")
    return out.select(F.date_format("period", "yyyy-MM-dd").alias("period"), F.round("value", 4).alias("value"))


@query(
    "trend_summary",
    f"""WITH t AS (SELECT date_trunc('month', o_orderdate) AS p, avg(o_totalprice) AS y FROM orders GROUP BY 1), k AS (SELECT row_number() OVER (ORDER BY p) - 1 AS x, y, count(*) OVER () AS n FROM t),
      a AS (SELECT count(*) AS n, regr_slope(y, x) AS slope, corr(y, x) AS r, avg(y) FILTER (x < 3) AS f, avg(y) FILTER (x >= n - 3) AS l FROM k), s AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS dof FROM a),
      pv AS ({t_two_sided('s', 't', 'dof', 'n, slope, f, l')})
      SELECT CASE WHEN p >= 0.05 THEN 'no clear trend' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS direction, round(slope, 4) AS slope, round(p, 6) AS p_value, round((l - f) / abs(f) * 100, 4) AS change_pct, n AS periods FROM pv""",
)
def _(spark, d):
    trend = kpi.kpi_trend(load(spark, d, "orders"), "o_orderdate", "o_totalprice", "mean")
    return _round(_round(kpi.trend_summary(trend, "period", "value"), 4, "slope", "change_pct"), 6, "p_value")


# ------------------------------------------------------------------ baskets
PAIRS_SQL = "pairs AS (SELECT DISTINCT l_orderkey AS o, p_brand AS i FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT count(DISTINCT o) AS n FROM pairs), k AS (SELECT i, count(*) AS k FROM pairs GROUP BY 1)"
RULES_SQL = """rules AS (SELECT a.i AS item, b.i AS also, count(*) AS orders_with_both, round(100.0 * count(*) / any_value(n.n), 2) AS support_pct, round(100.0 * count(*) / any_value(ka.k), 1) AS confidence_pct,
  round((count(*) / any_value(ka.k)) / (any_value(kb.k) / any_value(n.n)), 2) AS lift FROM pairs a JOIN pairs b ON a.o = b.o AND a.i <> b.i JOIN k ka ON ka.i = a.i JOIN k kb ON kb.i = b.i, n GROUP BY a.i, b.i HAVING count(*) >= 5)"""


def _brands(spark, d):
    li, pa = load(spark, d, "lineitem"), load(spark, d, "part")
    return li.join(pa, li.l_partkey == pa.p_partkey).select("l_orderkey", "p_brand")


@query("baskets", f"WITH {PAIRS_SQL} SELECT o AS order_key, count(*) AS items FROM pairs GROUP BY 1")
def _(spark, d):
    return basket.baskets(_brands(spark, d), "l_orderkey", "p_brand")


@query("basket_summary", f"WITH {PAIRS_SQL}, s AS (SELECT o, count(*) AS c FROM pairs GROUP BY 1) SELECT count(*) AS orders, count(*) FILTER (c >= 2) AS multi_item_orders, round(avg(c), 2) AS avg_items FROM s")
def _(spark, d):
    return basket.basket_summary(_brands(spark, d), "l_orderkey", "p_brand")


@query("item_counts", f"WITH {PAIRS_SQL} SELECT i AS item, k AS orders, round(100.0 * k / n, 1) AS orders_pct FROM k, n")
def _(spark, d):
    return basket.item_counts(_brands(spark, d), "l_orderkey", "p_brand")


@query("basket_rules", f"WITH {PAIRS_SQL}, {RULES_SQL} SELECT * FROM rules")
def _(spark, d):
    return basket.basket_rules(_brands(spark, d), "l_orderkey", "p_brand")


@query(
    "recommend_items",
    f"""WITH {PAIRS_SQL}, {RULES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY confidence_pct DESC, lift DESC, also) AS place FROM rules WHERE lift >= 1.02) SELECT * FROM r WHERE place <= 5""",
)
def _(spark, d):
    return basket.recommend_items(basket.basket_rules(_brands(spark, d), "l_orderkey", "p_brand"), min_lift=1.02)


# ------------------------------------------------------------------ text
STOP_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(text.STOP))) + "]"
SHORT_LIST = "[" + ", ".join("'" + w + "'" for w in sorted(set(text.SHORT_STOP))) + "]"


def _tokens_sql(col, pattern="[a-z][a-z'']+", stop=STOP_LIST):
    return f"[w for w in regexp_extract_all(lower({col}), '{pattern}') if length(w) > 2 AND NOT list_contains({stop}, w)]"


@query("tokenize", f"SELECT doc_id, array_to_string({_tokens_sql('text')}, ' ') AS tokens FROM documents")
def _(spark, d):
    out = text.tokenize(load(spark, d, "documents"), "text")
    return out.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("word_counts", f"SELECT word, count(*) AS count FROM (SELECT unnest({_tokens_sql('text')}) AS word FROM documents) GROUP BY 1 ORDER BY count DESC, word LIMIT 20")
def _(spark, d):
    return text.word_counts(load(spark, d, "documents"), "text")


HYPHEN_SQL = _tokens_sql("text", "[a-z][a-z''-]+", SHORT_LIST)


@query("word_frequencies", f"SELECT word, count(*) AS count FROM (SELECT unnest({HYPHEN_SQL}) AS word FROM conversations) GROUP BY 1 ORDER BY count DESC, word LIMIT 25")
def _(spark, d):
    return text.word_frequencies(load(spark, d, "conversations"), "text")


@query(
    "phrase_counts",
    f"""WITH t AS (SELECT {_tokens_sql('text')} AS w FROM documents), p AS (SELECT unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS phrase FROM t)
      SELECT * FROM (SELECT phrase, count(*) AS count FROM p GROUP BY 1 ORDER BY count DESC, phrase LIMIT 15) WHERE count > 1""",
)
def _(spark, d):
    return text.phrase_counts(load(spark, d, "documents"), "text")


# A word list made from frequent tokens of the texts themselves, with fixed valences by length.
LEXICON_SQL = f"""lex AS (SELECT word, CASE WHEN length(word) >= 6 THEN 1.5 WHEN length(word) = 5 THEN -1.0 WHEN length(word) = 4 THEN 0.5 ELSE -0.5 END AS valence
  FROM (SELECT unnest({_tokens_sql('text')}) AS word FROM documents) GROUP BY word ORDER BY count(*) DESC, word LIMIT 40)"""
SCORED_SQL = (
    LEXICON_SQL
    + r""", one AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z'']+')) AS word FROM documents), s AS (SELECT doc_id, sum(valence) AS s FROM one JOIN lex USING (word) GROUP BY 1),
  sc AS (SELECT d.doc_id, d.lang, d.source, d.text, coalesce(s, 0) AS s, len(regexp_extract_all(text, '\S+')) AS word_count FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id),
  scored AS (SELECT doc_id, lang, source, text, CASE WHEN trim(text) <> '' THEN s / sqrt(s * s + 15) END AS sentiment_score,
    CASE WHEN trim(text) = '' THEN 'No text' WHEN s / sqrt(s * s + 15) >= 0.05 THEN 'Positive' WHEN s / sqrt(s * s + 15) <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment, CAST(word_count AS INT) AS word_count FROM sc)"""
)


def _scored(spark, d):
    docs = load(spark, d, "documents")
    n = F.length("word")
    valence = F.when(n >= 6, 1.5).when(n == 5, -1.0).when(n == 4, 0.5).otherwise(-0.5)
    lexicon = text.word_counts(docs, "text", 40).select("word", valence.alias("valence"))
    return docs, text.lexicon_sentiment(docs, "doc_id", "text", lexicon)


@query("lexicon_sentiment", f"WITH {SCORED_SQL} SELECT doc_id, round(sentiment_score, 6) AS sentiment_score, sentiment, word_count FROM scored")
def _(spark, d):
    return _round(_scored(spark, d)[1], 6, "sentiment_score")


@query(
    "sentiment_by_group",
    f"""WITH {SCORED_SQL} SELECT lang, count(*) AS comments, round(avg(sentiment_score), 3) AS average_score, round(100.0 * avg(CAST(sentiment = 'Positive' AS INT)), 1) AS positive_pct,
      round(100.0 * avg(CAST(sentiment = 'Negative' AS INT)), 1) AS negative_pct FROM scored WHERE sentiment <> 'No text' AND lang IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    docs, scored = _scored(spark, d)
    return text.sentiment_by_group(scored.join(docs.select("doc_id", "lang"), "doc_id"), "lang")


@query(
    "words_by_sentiment",
    f"""WITH {SCORED_SQL}, w AS (SELECT sentiment, unnest({_tokens_sql('text')}) AS word FROM scored WHERE sentiment IN ('Positive', 'Negative')),
      c AS (SELECT sentiment, word, count(*) AS count, row_number() OVER (PARTITION BY sentiment ORDER BY count(*) DESC, word) AS place FROM w GROUP BY 1, 2) SELECT * FROM c WHERE place <= 12""",
)
def _(spark, d):
    docs, scored = _scored(spark, d)
    return text.words_by_sentiment(docs.join(scored.select("doc_id", "sentiment"), "doc_id"), "text")


@query(
    "score_vs_rating",
    f"""WITH {SCORED_SQL}, j AS (SELECT sentiment_score AS x, n_chars AS y FROM scored JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) WHERE sentiment_score IS NOT NULL),
      r AS (SELECT {rank_avg('x')} AS a, {rank_avg('y')} AS b FROM j) SELECT round(corr(a, b), 6) AS rho FROM r""",
)
def _(spark, d):
    docs, scored = _scored(spark, d)
    joined = scored.withColumn("sentiment_score", F.round("sentiment_score", 12)).join(docs.select("doc_id", "n_chars"), "doc_id")
    return _round(text.score_vs_rating(joined, "sentiment_score", "n_chars"), 6, "rho")


@query("text_columns", "SELECT 'text' AS column_name FROM conversations HAVING avg(len(regexp_extract_all(text, '\\S+'))) >= 3")
def _(spark, d):
    df = load(spark, d, "conversations")
    names = profile.text_columns(df, {"role": "categorical", "text": "text", "conv_id": "numeric"})
    return spark.createDataFrame([(x,) for x in names], "column_name string")


# ------------------------------------------------------------------ standardization
STD_TEXT = """src AS (SELECT o_orderkey, o_orderdate AS dt, o_totalprice AS v, log10(o_totalprice) AS x, o_orderpriority || ' | ' || o_orderstatus AS s, o_orderpriority AS source, date_trunc('week', o_orderdate) AS per, o_custkey AS w FROM orders WHERE o_totalprice > 0),
 md AS (SELECT s, median(x) AS med FROM src GROUP BY s), ma AS (SELECT s, any_value(med) AS med, median(abs(x - med)) AS mad FROM src JOIN md USING (s) GROUP BY s),
 z AS (SELECT src.*, (x - med) / nullif(mad * 1.4826, 0) AS rz FROM src JOIN ma USING (s)), pm AS (SELECT per, median(rz) AS common FROM z GROUP BY per),
 vo AS (SELECT z.*, rz - common AS vs FROM z JOIN pm USING (per)),
 nb AS (SELECT *, row_number() OVER w1 AS pos, count(*) OVER (PARTITION BY s) AS n, abs(vs - lag(vs) OVER w1) AS d, datesub('day', lag(dt) OVER w1, dt) AS gap,
   CASE WHEN count(vs) OVER (w1 ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) >= 3 THEN quantile_cont(vs, 0.5) OVER (w1 ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS loc,
   quantile_cont(vs, 0.5) OVER (w1 ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS bef, quantile_cont(vs, 0.5) OVER (w1 ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS aft
   FROM vo WINDOW w1 AS (PARTITION BY s ORDER BY dt, o_orderkey)),
 ns AS (SELECT s, nullif(median(d) * 1.4826 / sqrt(2), 0) AS noise FROM nb GROUP BY s),
 wk AS (SELECT nb.*, noise, (vs - loc) / noise AS vz, coalesce(abs((vs - loc) / noise) > 4.5, false) AS flag, coalesce(gap > 7, false) AS gapflag, (aft - bef) / noise AS shift FROM nb JOIN ns USING (s)),
 st0 AS (SELECT s, arg_min(dt, (-abs(shift), pos)) AS step_date, arg_min(shift, (-abs(shift), pos)) AS step_size FROM wk WHERE n >= 14 AND pos > 6 AND pos <= n - 5 AND shift <> 0 GROUP BY s), st AS (SELECT * FROM st0 WHERE abs(step_size) >= {step}),
 qa AS (SELECT s AS series, count(*) AS readings, min(dt) AS first_date, max(dt) AS last_date, count(*) FILTER (flag) AS outliers, count(*) FILTER (gap > 7) AS gaps, coalesce(max(gap), 0) AS longest_gap, median(v) AS median_value, arg_min(w, pos)::DOUBLE AS weight FROM wk GROUP BY s),
 per AS (SELECT per, s, avg(rz) AS z FROM wk WHERE NOT flag AND rz IS NOT NULL GROUP BY 1, 2),
 idx AS (SELECT per, sum(z * weight) / sum(weight) AS idx, median(z) AS med, count(*) AS sources FROM per JOIN qa ON series = s GROUP BY per)"""
STD_SQL = STD_TEXT.replace("{step}", "3.5")


def _standard(spark, d, **kw):
    return standardize.standardize(
        load(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", tie="o_orderkey", split=["o_orderstatus"],
        weight="o_custkey", gap_days=7, **kw,
    )


ROWS_SQL = f"WITH {STD_SQL} SELECT o_orderkey, s AS series, round(rz, 3) AS robust_z"


@query("robust_z", f"WITH {STD_SQL} SELECT o_orderkey, s AS series, round(rz, 6) AS robust_z FROM z")
def _(spark, d):
    o = load(spark, d, "orders")
    df = o.select("o_orderkey", standardize.series_key(o, ["o_orderpriority", "o_orderstatus"]).alias("series"), F.log10("o_totalprice").alias("x"))
    return _round(standardize.robust_z(df, "series", "x"), 6, "robust_z").drop("x")


@query("vs_others", f"{ROWS_SQL}, round(vs, 3) AS vs_others FROM wk")
def _(spark, d):
    return _standard(spark, d).rows.select("o_orderkey", "series", "robust_z", "vs_others")


@query("flag_outliers_local", f"WITH {STD_SQL} SELECT o_orderkey, round(vz, 3) AS vs_others_z, flag AS flag_outlier FROM wk")
def _(spark, d):
    return _standard(spark, d).rows.select("o_orderkey", "vs_others_z", "flag_outlier")


@query("flag_gaps", f"WITH {STD_SQL} SELECT o_orderkey, gap AS days_since_previous, gapflag AS flag_gap_before FROM wk")
def _(spark, d):
    return _standard(spark, d).rows.select("o_orderkey", "days_since_previous", "flag_gap_before")


@query("step_change", f"WITH {STD_TEXT.replace('{step}', '2.0')} SELECT s AS series, strftime(step_date, '%Y-%m-%d') AS step_date, round(step_size, 2) AS step_size FROM st")
def _(spark, d):
    return _standard(spark, d, step_min=2.0).quality.where("step_date is not null").select("series", day_text("step_date"), "step_size")


@query(
    "series_quality",
    f"""WITH {STD_SQL} SELECT series, readings, strftime(first_date, '%Y-%m-%d') AS first_date, strftime(last_date, '%Y-%m-%d') AS last_date, outliers, gaps, longest_gap, round(median_value, 4) AS median_value, weight, round(step_size, 2) AS step_size, '' AS note FROM qa LEFT JOIN st ON s = series""",
)
def _(spark, d):
    q = _round(_standard(spark, d).quality, 4, "median_value").drop("step_date")
    return q.withColumns({x: F.date_format(x, "yyyy-MM-dd") for x in ("first_date", "last_date")})


@query("combined_index", f"WITH {STD_SQL} SELECT strftime(per, '%Y-%m-%d') AS period, round(idx, 3) AS index, sources FROM idx")
def _(spark, d):
    return _standard(spark, d).index.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query("combined_index_median", f"WITH {STD_SQL} SELECT strftime(per, '%Y-%m-%d') AS period, round(med, 3) AS index, sources FROM idx")
def _(spark, d):
    return _standard(spark, d, combine="median").index.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query(
    "standardize_summary",
    f"""WITH {STD_SQL} SELECT (SELECT count(*) FROM orders) AS rows_in, 0 AS dropped_missing, (SELECT count(*) FROM orders WHERE o_totalprice <= 0) AS dropped_nonpositive, count(*) AS rows_used, count(DISTINCT s) AS series, count(DISTINCT source) AS sources,
      count(*) FILTER (flag) AS outliers, count(*) FILTER (gapflag) AS gaps, round(log10(max(v) / min(v)), 6) AS orders_of_magnitude, (SELECT count(*) FROM st) AS step_changes, log10(max(v) / min(v)) >= 3 AS log_advised FROM wk""",
)
def _(spark, d):
    return _round(_standard(spark, d).summary, 6, "orders_of_magnitude")


# ------------------------------------------------------------------ series and forecasts
@query("suggest_frequency", "SELECT CASE WHEN s <= 120 THEN 'Day' WHEN s <= 730 THEN 'Week' WHEN s <= 5475 THEN 'Month' ELSE 'Year' END AS period, s AS span_days FROM (SELECT datesub('day', min(o_orderdate), max(o_orderdate)) AS s FROM orders)")
def _(spark, d):
    return forecast.suggest_frequency(load(spark, d, "orders"), "o_orderdate")


MONTH_SQL = """got AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1, 2),
 ends AS (SELECT k, min(p) AS lo, max(p) AS hi FROM got GROUP BY 1), spine AS (SELECT k, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS p FROM ends),
 ser AS (SELECT spine.k, spine.p, row_number() OVER (PARTITION BY spine.k ORDER BY spine.p) - 1 AS t, coalesce(total, 0) AS y, count(*) OVER (PARTITION BY spine.k) AS n FROM spine LEFT JOIN got ON got.k = spine.k AND got.p = spine.p)"""


def _monthly(spark, d):
    return forecast.regular_series(load(spark, d, "orders"), "o_orderdate", "o_totalprice", "Month", keys=["o_orderpriority"])


@query("regular_series", f"WITH {MONTH_SQL} SELECT k AS o_orderpriority, strftime(p, '%Y-%m-%d') AS period, t, round(y, 4) AS value FROM ser WHERE n >= 12")
def _(spark, d):
    out = _round(_monthly(spark, d), 4, "value")
    return out.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


# Mean per day and part: most days are missing, so values are interpolated.
SPARSE_SQL = """got AS (SELECT l_partkey AS k, date_trunc('month', l_shipdate) AS p, avg(sqrt(l_extendedprice)) AS a FROM lineitem GROUP BY 1, 2),
 ends AS (SELECT k, min(p) AS lo, max(p) AS hi FROM got GROUP BY 1), spine AS (SELECT k, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS p FROM ends),
 f AS (SELECT spine.k, spine.p, row_number() OVER (PARTITION BY spine.k ORDER BY spine.p) - 1 AS t, a, count(*) OVER (PARTITION BY spine.k) AS n FROM spine LEFT JOIN got ON got.k = spine.k AND got.p = spine.p),
 g AS (SELECT *, last_value(CASE WHEN a IS NOT NULL THEN t END IGNORE NULLS) OVER pa AS t0, last_value(a IGNORE NULLS) OVER pa AS a0, first_value(CASE WHEN a IS NOT NULL THEN t END IGNORE NULLS) OVER fu AS t1, first_value(a IGNORE NULLS) OVER fu AS a1
   FROM f WINDOW pa AS (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING), fu AS (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("regular_series_mean", f"WITH {SPARSE_SQL} SELECT k AS l_partkey, strftime(p, '%Y-%m-%d') AS period, t, round(CASE WHEN a IS NOT NULL THEN a ELSE a0 + (a1 - a0) * (t - t0) / (t1 - t0) END, 5) AS value FROM g WHERE n >= 12")
def _(spark, d):
    df = load(spark, d, "lineitem").withColumn("root", F.sqrt("l_extendedprice"))
    out = forecast.regular_series(df, "l_shipdate", "root", "Month", "mean", ["l_partkey"])
    return _round(out, 5, "value").withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query(
    "series_from_daily",
    """WITH got AS (SELECT date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS p, count(*) AS n FROM orders GROUP BY 1), ends AS (SELECT min(p) AS lo, max(p) AS hi FROM got),
      spine AS (SELECT unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS p FROM ends)
      SELECT strftime(spine.p, '%Y-%m-%d') AS period, row_number() OVER (ORDER BY spine.p) - 1 AS t, coalesce(n, 0)::DOUBLE AS value FROM spine LEFT JOIN got ON got.p = spine.p""",
)
def _(spark, d):
    from tabella.operators.grouping import daily_totals

    out = forecast.series_from_daily(daily_totals(load(spark, d, "orders"), "o_orderdate", "o_totalprice"), "Week", "count")
    return out.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


def _forecast_sql(value, extra=""):
    return f"""WITH {MONTH_SQL}, a AS (SELECT k, max(n) AS n, max(p) AS hi, arg_max(y, t) AS last, avg(y) FILTER (t >= n - 3) AS m3, regr_slope(y, t) AS b, regr_intercept(y, t) AS i0 FROM ser WHERE n >= 12 GROUP BY k)
      SELECT a.k AS o_orderpriority, CAST(s AS INT) AS step, strftime(hi + to_months(CAST(s AS INT)), '%Y-%m-%d') AS period, round({value}, 4) AS forecast FROM a, range(1, 7) r(s) {extra}"""


for _name, _value, _extra in [
    ("naive", "last", ""),
    ("moving_average", "m3", ""),
    ("linear_trend", "i0 + b * (a.n + s - 1)", ""),
    ("seasonal_naive", "ser.y", "JOIN ser ON ser.k = a.k AND ser.t = a.n - 12 + (s - 1) % 12"),
]:

    def _run(spark, d, method=_name):
        out = forecast.forecast_simple(_monthly(spark, d), ["o_orderpriority"], 6, "Month", method)
        return _round(out, 4, "forecast").withColumn("period", F.date_format("period", "yyyy-MM-dd"))

    query(f"forecast_{_name}", _forecast_sql(_value, _extra))(_run)


@query("forecast_holt")
def _(spark, d):
    return forecast.forecast_simple(_monthly(spark, d), ["o_orderpriority"], 6, "Month", "holt")


@query("forecast_holt_winters")
def _(spark, d):
    return forecast.forecast_simple(_monthly(spark, d), ["o_orderpriority"], 6, "Month", "holt_winters")


BACK_SQL = f"""{MONTH_SQL}, h AS (SELECT *, least(greatest(6, 3), greatest(3, n // 5)) AS hold FROM ser WHERE n >= 12), tr AS (SELECT * FROM h WHERE t < n - hold),
  a AS (SELECT k, max(n - hold) AS nt, arg_max(y, t) AS last, avg(y) FILTER (t >= n - hold - 3) AS m3, regr_slope(y, t) AS b, regr_intercept(y, t) AS i0 FROM tr GROUP BY k),
  pr AS (SELECT h.k, h.t, h.y, h.hold, a.last, a.m3, a.i0 + a.b * h.t AS lin, CASE WHEN a.nt >= 24 THEN s.y END AS sea FROM h JOIN a ON a.k = h.k AND h.t >= h.n - h.hold LEFT JOIN tr s ON s.k = h.k AND s.t = a.nt - 12 + (h.t - a.nt) % 12),
  long AS (SELECT k, y, hold, 'naive' AS method, 0 AS place, last AS f FROM pr UNION ALL SELECT k, y, hold, 'moving_average', 1, m3 FROM pr UNION ALL SELECT k, y, hold, 'linear_trend', 2, lin FROM pr UNION ALL SELECT k, y, hold, 'seasonal_naive', 4, sea FROM pr WHERE sea IS NOT NULL),
  cmp AS (SELECT k, method, place, any_value(hold) AS hold, avg(abs(y - f)) AS mae, sqrt(avg(pow(y - f, 2))) AS rmse, 100 * avg(CASE WHEN y <> 0 THEN abs((y - f) / y) END) AS mape FROM long GROUP BY 1, 2, 3)"""


@query("backtest", f"WITH {BACK_SQL} SELECT k AS o_orderpriority, method, CAST(hold AS INT) AS holdout, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 6) AS mape FROM cmp")
def _(spark, d):
    out = forecast.backtest(_monthly(spark, d), ["o_orderpriority"], 6, "Month", forecast.SIMPLE).drop("place")
    return _round(_round(out, 4, "mae", "rmse"), 6, "mape")


@query(
    "forecast_best",
    f"""WITH {BACK_SQL}, best AS (SELECT k, arg_min(method, (rmse, place)) AS method, min(rmse) AS rmse, any_value(hold) AS hold FROM cmp GROUP BY k),
      full_fit AS (SELECT k, max(n) AS n, max(p) AS hi, min(y) AS lo, arg_max(y, t) AS last, avg(y) FILTER (t >= n - 3) AS m3, regr_slope(y, t) AS b, regr_intercept(y, t) AS i0 FROM ser WHERE n >= 12 GROUP BY k),
      f AS (SELECT a.k, best.method, s, hi, lo, 1.96 * rmse * greatest(sqrt(s / hold), 1) AS sp, CASE best.method WHEN 'naive' THEN last WHEN 'moving_average' THEN m3 WHEN 'linear_trend' THEN i0 + b * (a.n + s - 1) ELSE ser.y END AS f
        FROM full_fit a JOIN best ON best.k = a.k CROSS JOIN range(1, 13) r(s) LEFT JOIN ser ON ser.k = a.k AND ser.t = a.n - 12 + (s - 1) % 12)
      SELECT k AS o_orderpriority, method, CAST(s AS INT) AS step, strftime(hi + to_months(CAST(s AS INT)), '%Y-%m-%d') AS period, round(CASE WHEN lo >= 0 THEN greatest(f, 0) ELSE f END, 4) AS forecast,
        round(CASE WHEN lo >= 0 THEN greatest(f - sp, 0) ELSE f - sp END, 4) AS low, round(CASE WHEN lo >= 0 THEN greatest(f + sp, 0) ELSE f + sp END, 4) AS high FROM f""".replace("greatest(6, 3)", "greatest(12, 3)"),
)
def _(spark, d):
    out = forecast.forecast_best(_monthly(spark, d), ["o_orderpriority"], 12, "Month", forecast.SIMPLE)
    return _round(out, 4, "forecast", "low", "high").withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query(
    "beats_naive",
    f"""WITH {BACK_SQL}, g AS (SELECT k, arg_min(method, (rmse, place)) AS method, arg_min(mae, (rmse, place)) AS mae, max(mae) FILTER (method = 'naive') AS nm FROM cmp GROUP BY k)
      SELECT k AS o_orderpriority, method, round(mae, 4) AS mae, round(nm, 4) AS naive_mae, round(100 * (1 - mae / nm), 4) AS gain_pct, method <> 'naive' AND mae < nm AS beats_naive FROM g""",
)
def _(spark, d):
    cmp = forecast.backtest(_monthly(spark, d), ["o_orderpriority"], 6, "Month", forecast.SIMPLE)
    return _round(forecast.beats_naive(cmp, ["o_orderpriority"]), 4, "mae", "naive_mae", "gain_pct")


@query("forecast_all_methods")
def _(spark, d):
    series = forecast.regular_series(load(spark, d, "events"), "ts", "value", "Day", keys=["event_type"])
    return forecast.forecast_best(series, ["event_type"], 7, "Day")


# ------------------------------------------------------------------ questions
@query(
    "answerable_questions",
    """WITH s AS (SELECT o, count(*) AS k FROM (SELECT DISTINCT o_custkey AS o, o_orderpriority AS i FROM orders) GROUP BY 1), b AS (SELECT count(*) >= 10 AND avg(CAST(k >= 2 AS INT)) >= 0.1 AS ok FROM s)
      SELECT * FROM (VALUES ('future values', true, 'o_totalprice, o_orderdate', 'a date and a number'), ('who leaves, converts or defaults', true, 'returned', 'a two-valued outcome'), ('unusual records', true, 'o_custkey', 'a number'),
       ('what something should cost', true, 'o_totalprice', 'a number and other columns'), ('which rows are alike', true, 'o_custkey, o_totalprice', 'two numbers'), ('totals across groups', true, 'o_orderpriority, o_custkey', 'a category or date and a number'),
       ('which machines fail or drift', false, '', 'readings over time or a failed flag'), ('how customers feel', false, '', 'written comments'), ('images, audio or scans', false, '', 'not supported')) t(question, answerable, columns, needs)
      UNION ALL SELECT 'what is bought together', ok, CASE WHEN ok THEN 'o_custkey, o_orderpriority' ELSE '' END, 'one row per item with a repeating order' FROM b""",
)
def _(spark, d):
    from tabella.operators.questions import answerable_questions

    df = load(spark, d, "orders").withColumn("returned", F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No"))
    kinds = {"o_custkey": "numeric", "o_totalprice": "numeric", "o_orderpriority": "categorical", "returned": "categorical", "o_orderdate": "datetime"}
    return answerable_questions(df, kinds, "o_custkey", "o_orderpriority")
