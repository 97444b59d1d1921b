"""Queries over descriptive statistics, correlation and significance tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabella.operators import describe, stats
from tabella.plans.inputs import GAPS_SQL, gap_orders
from tabella.plans.registry import query
from tabella.plans.sqltext import chi2_tail, f_tail, rank_avg, t_two_sided
from tabella.session import load


def _sixes(df, *names):
    return df.withColumns({x: F.round(x, 6) for x in names})


SIZES_SQL = "sized AS (SELECT *, CASE WHEN o_totalprice < 100000 THEN 'Low' WHEN o_totalprice < 300000 THEN 'Medium' ELSE 'High' END AS size FROM orders)"


def _sized(spark, d):
    size = F.when(F.col("o_totalprice") < 100000, "Low").when(F.col("o_totalprice") < 300000, "Medium").otherwise("High")
    return load(spark, d, "orders").withColumn("size", size)


# ------------------------------------------------------------------ one column
@query(
    "summary_stats",
    """WITH v AS (SELECT value AS x FROM events), m AS (SELECT avg(x) AS a FROM v),
      s AS (SELECT count(x)::DOUBLE AS n, avg(x) AS mean, median(x) AS med, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3,
        var_samp(x) AS var, stddev_samp(x) AS sd, avg(abs(x - a)) AS mad, skewness(x) AS sk, kurtosis(x) AS ku FROM v, m),
      md AS (SELECT x AS mode FROM v GROUP BY x ORDER BY count(*) DESC, x LIMIT 1),
      r AS (SELECT 'count' AS measure, n AS value FROM s UNION ALL SELECT 'mean', mean FROM s UNION ALL SELECT 'median', med FROM s UNION ALL SELECT 'mode', mode FROM md
        UNION ALL SELECT 'minimum', lo FROM s UNION ALL SELECT 'maximum', hi FROM s UNION ALL SELECT 'range', hi - lo FROM s UNION ALL SELECT 'q1', q1 FROM s
        UNION ALL SELECT 'q3', q3 FROM s UNION ALL SELECT 'iqr', q3 - q1 FROM s UNION ALL SELECT 'variance', var FROM s UNION ALL SELECT 'std', sd FROM s
        UNION ALL SELECT 'mean_abs_deviation', mad FROM s UNION ALL SELECT 'cv_pct', sd / mean * 100 FROM s UNION ALL SELECT 'skewness', sk FROM s UNION ALL SELECT 'kurtosis', ku FROM s)
      SELECT measure, round(value, 4) AS value FROM r""",
)
def _(spark, d):
    return describe.summary_stats(load(spark, d, "events"), "value").withColumn("value", F.round("value", 4))


@query(
    "categorical_stats",
    f"""WITH {SIZES_SQL}, c AS (SELECT size, count(*) AS n FROM sized GROUP BY 1),
      r AS (SELECT CASE size WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS k FROM sized)
      SELECT 'count' AS measure, CAST(sum(n) AS BIGINT)::VARCHAR AS value FROM c UNION ALL SELECT 'distinct categories', count(*)::VARCHAR FROM c
      UNION ALL (SELECT 'mode', size FROM c ORDER BY n DESC, size LIMIT 1) UNION ALL (SELECT 'mode frequency', n::VARCHAR FROM c ORDER BY n DESC, size LIMIT 1)
      UNION ALL SELECT 'median category', CASE floor(median(k)) WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END FROM r""",
)
def _(spark, d):
    return describe.categorical_stats(_sized(spark, d), "size")


@query(
    "frequency_table",
    f"""WITH {SIZES_SQL}, c AS (SELECT size AS value, count(*) AS frequency FROM sized GROUP BY 1), t AS (SELECT *, CASE value WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS k, sum(frequency) OVER () AS n FROM c)
      SELECT value, frequency, round(100.0 * frequency / n, 2) AS percent, CAST(sum(frequency) OVER (ORDER BY k) AS BIGINT) AS cumulative,
        round(100.0 * sum(frequency) OVER (ORDER BY k) / n, 2) AS cumulative_percent FROM t""",
)
def _(spark, d):
    return describe.frequency_table(_sized(spark, d), "size", "categorical")


EQUAL_WIDTH_SQL = """e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, CAST(ceil(log2(count(*)) + 1) AS INT) AS k FROM lineitem),
  edges AS (SELECT i AS bin, lo + (hi - lo) * i / k AS low, CASE WHEN i = k - 1 THEN hi ELSE lo + (hi - lo) * (i + 1) / k END AS high FROM e, range(1000) r(i) WHERE i < k),
  counts AS (SELECT bin, round(low, 6) AS low, round(high, 6) AS high, (SELECT count(*) FROM lineitem WHERE (l_extendedprice > low OR (bin = 0 AND l_extendedprice = low)) AND l_extendedprice <= high) AS n FROM edges)"""


@query(
    "frequency_table_numeric",
    f"""WITH {EQUAL_WIDTH_SQL} SELECT bin, low, high, n AS frequency, round(100.0 * n / sum(n) OVER (), 2) AS percent, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cumulative,
      round(100.0 * sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 2) AS cumulative_percent FROM counts""",
)
def _(spark, d):
    return _sixes(describe.frequency_table(load(spark, d, "lineitem"), "l_extendedprice", "numeric"), "low", "high")


@query("bin_equal_width", f"WITH {EQUAL_WIDTH_SQL} SELECT * FROM counts")
def _(spark, d):
    return _sixes(describe.bin_equal_width(load(spark, d, "lineitem"), "l_extendedprice"), "low", "high")


@query(
    "bin_equal_count",
    """WITH q AS (SELECT DISTINCT unnest(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM events),
      edges AS (SELECT row_number() OVER (ORDER BY e) - 1 AS bin, e AS low, lead(e) OVER (ORDER BY e) AS high FROM q)
      SELECT CAST(bin AS INTEGER) AS bin, round(low, 6) AS low, round(high, 6) AS high, (SELECT count(*) FROM events WHERE (value > low OR (bin = 0 AND value = low)) AND value <= high) AS n FROM edges WHERE high IS NOT NULL""",
)
def _(spark, d):
    return _sixes(describe.bin_equal_count(load(spark, d, "events"), "value"), "low", "high")


LOG_VALUE = "(l_extendedprice * l_extendedprice * l_tax)"


@query(
    "bin_log",
    f"""WITH v AS (SELECT {LOG_VALUE} AS x FROM lineitem), f AS (SELECT floor(log10(min(x) FILTER (x > 0))) AS a, ceil(log10(max(x))) AS b, max(x) AS hi, min(x) AS lo FROM v),
      e AS (SELECT 0.0 AS e FROM f WHERE lo = 0 UNION ALL SELECT pow(10.0, a + i) FROM f, range(40) r(i) WHERE a + i <= b),
      edges AS (SELECT row_number() OVER (ORDER BY e) - 1 AS bin, e AS low, lead(e) OVER (ORDER BY e) AS high FROM e)
      SELECT CAST(bin AS INTEGER) AS bin, low, high, (SELECT count(*) FROM v WHERE (x > low OR (bin = 0 AND x = low)) AND x <= high) AS n FROM edges WHERE high IS NOT NULL""",
)
def _(spark, d):
    df = load(spark, d, "lineitem").select((F.col("l_extendedprice") * F.col("l_extendedprice") * F.col("l_tax")).alias("x"))
    return describe.bin_log(df, "x")


@query(
    "choose_binning",
    """SELECT 'value' AS column_name, CASE WHEN abs(skewness(value)) <= 2 THEN 'equal width' WHEN min(value) >= 0 AND count(*) FILTER (value > 0) >= 3 THEN 'log' ELSE 'equal count' END AS method,
       round(skewness(value), 6) AS skewness FROM events""",
)
def _(spark, d):
    return _sixes(describe.choose_binning(load(spark, d, "events"), "value"), "skewness")


# ------------------------------------------------------------------ two and more columns
@query(
    "crosstab",
    """WITH c AS (SELECT coalesce(o_orderpriority, 'Total') AS o_orderpriority, coalesce(o_orderstatus, 'Total') AS s, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus))
      SELECT o_orderpriority, max(n) FILTER (s = 'F') AS "F", max(n) FILTER (s = 'O') AS "O", max(n) FILTER (s = 'P') AS "P", max(n) FILTER (s = 'Total') AS "Total" FROM c GROUP BY 1""",
)
def _(spark, d):
    return describe.crosstab(load(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(
    "crosstab_long",
    """SELECT coalesce(p_brand, 'Total') AS p_brand, coalesce(p_type, 'Total') AS p_type, count(*) AS value FROM part GROUP BY CUBE (p_brand, p_type)""",
)
def _(spark, d):
    return describe.crosstab_long(load(spark, d, "part"), "p_brand", "p_type")


@query(
    "crosstab_row_percent",
    """WITH c AS (SELECT o_orderpriority, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY o_orderpriority), 2) AS v FROM c)
      SELECT o_orderpriority, max(v) FILTER (s = 'F') AS "F", max(v) FILTER (s = 'O') AS "O", max(v) FILTER (s = 'P') AS "P" FROM p GROUP BY 1""",
)
def _(spark, d):
    return describe.crosstab(load(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "index")


@query(
    "group_describe",
    f"""WITH {SIZES_SQL} SELECT size, count(*) AS count, round(avg(o_totalprice), 2) AS mean, round(median(o_totalprice), 2) AS median, round(stddev_samp(o_totalprice), 2) AS std,
       min(o_totalprice) AS min, max(o_totalprice) AS max, round(sum(o_totalprice), 2) AS total FROM sized GROUP BY size""",
)
def _(spark, d):
    return describe.group_describe(_sized(spark, d), "size", "o_totalprice")


@query(
    "multivariate_frequency",
    """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS frequency, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 6) AS percent FROM lineitem GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return describe.multivariate_frequency(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], digits=6)


@query(
    "target_balance",
    """WITH c AS (SELECT o_orderstatus AS value, count(*) AS rows FROM orders GROUP BY 1), a AS (SELECT min(rows) AS lo, max(rows) AS hi, sum(rows) AS n FROM c)
      SELECT value, rows, round(100.0 * rows / n, 1) AS share, round(hi / lo, 4) AS ratio, CASE WHEN lo / n < 0.1 THEN 'severe' WHEN lo / n < 0.3 THEN 'moderate' ELSE 'balanced' END AS level FROM c, a""",
)
def _(spark, d):
    return describe.target_balance(load(spark, d, "orders"), "o_orderstatus")


@query(
    "outcome_rate_by_category",
    "SELECT l_linestatus || l_linenumber AS category, count(*) AS rows, round(100.0 * avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 1) AS rate FROM lineitem GROUP BY 1",
)
def _(spark, d):
    df = load(spark, d, "lineitem").withColumn("category", F.concat("l_linestatus", F.col("l_linenumber").cast("string")))
    return describe.outcome_rate_by_category(df, "category", "l_returnflag", "R")


# ------------------------------------------------------------------ correlation
PAIR_SQL = f"""pair AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), ranked AS (SELECT {rank_avg('x')} AS rx, {rank_avg('y')} AS ry FROM pair),
  a AS (SELECT count(*) AS n, covar_samp(x, y) AS cov, corr(x, y) AS r FROM pair), b AS (SELECT corr(rx, ry) AS rho FROM ranked)"""


@query(
    "bivariate_numeric",
    f"""WITH {PAIR_SQL}, st AS (SELECT 'pearson_p' AS measure, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS dof FROM a UNION ALL SELECT 'spearman_p', rho * sqrt((n - 2) / (1 - rho * rho)), n - 2 FROM a, b),
      pv AS ({t_two_sided('st', 't', 'dof', 'measure')})
      SELECT 'n' AS measure, n::DOUBLE AS value FROM a UNION ALL SELECT 'covariance', round(cov, 6) FROM a UNION ALL SELECT 'pearson_r', round(r, 6) FROM a
      UNION ALL SELECT 'spearman_rho', round(rho, 6) FROM b UNION ALL SELECT measure, round(p, 6) FROM pv""",
)
def _(spark, d):
    return _sixes(stats.bivariate_numeric(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), "value")


NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _matrix_sql(cell, source="lineitem"):
    return " UNION ALL ".join(f"SELECT '{a}' AS row_name, '{b}' AS column_name, {cell(a, b)} AS value FROM {source}" for a in NUMS for b in NUMS)


@query("correlation_matrix", _matrix_sql(lambda a, b: "1.0" if a == b else f"round(corr({a}, {b}), 3)", "lineitem").replace("1.0 AS value FROM lineitem", "1.0 AS value"))
def _(spark, d):
    return stats.correlation_matrix(load(spark, d, "lineitem"), NUMS)


@query(
    "correlation_matrix_spearman",
    "WITH lr AS (SELECT " + ", ".join(f"{rank_avg(x)} AS {x}" for x in NUMS) + " FROM lineitem) "
    + _matrix_sql(lambda a, b: "1.0" if a == b else f"round(corr({a}, {b}), 3)", "lr").replace("1.0 AS value FROM lr", "1.0 AS value"),
)
def _(spark, d):
    return stats.correlation_matrix(load(spark, d, "lineitem"), NUMS, "spearman")


@query("covariance_matrix", _matrix_sql(lambda a, b: f"round(covar_samp({a}, {b}), 2)"))
def _(spark, d):
    return stats.covariance_matrix(load(spark, d, "lineitem"), NUMS)


@query(
    "strongest_pairs",
    f"""WITH v AS (SELECT l_quantity AS quantity, l_quantity * l_extendedprice AS worth, l_extendedprice AS price FROM lineitem),
      r AS (SELECT {rank_avg('quantity')} AS a, {rank_avg('worth')} AS b, {rank_avg('price')} AS c FROM v),
      k AS (SELECT 'quantity' AS a, 'worth' AS b, corr(a, b) AS v FROM r UNION ALL SELECT 'quantity', 'price', corr(a, c) FROM r UNION ALL SELECT 'worth', 'price', corr(b, c) FROM r)
      SELECT a, b, round(v, 4) AS correlation, CASE WHEN abs(v) >= 0.7 THEN 'strong' WHEN abs(v) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM k""",
)
def _(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    df = load(spark, d, "lineitem").select(q.alias("quantity"), (q * p).alias("worth"), p.alias("price"))
    return stats.strongest_pairs(df, ["quantity", "worth", "price"])


TARGET_SQL = """t AS (SELECT l_quantity, l_extendedprice, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS s, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS f FROM lineitem)"""
TARGET_COLS = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_linestatus = O": "s", "l_returnflag = R": "f"}


@query(
    "target_correlation",
    f"WITH {TARGET_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS row_name, '{b}' AS column_name, " + ("1.0 AS value" if a == b else f"round(corr({x}, {y}), 3) AS value FROM t")
        for a, x in TARGET_COLS.items() for b, y in TARGET_COLS.items()
    ),
)
def _(spark, d):
    kinds = {"l_quantity": "numeric", "l_extendedprice": "numeric", "l_linestatus": "categorical", "l_returnflag": "categorical"}
    return stats.target_correlation(load(spark, d, "lineitem"), "l_returnflag", list(kinds), kinds, "R")


@query(
    "multicollinear_pairs",
    """WITH v AS (SELECT l_quantity AS q, l_quantity * (1 + l_tax) AS taxed, l_discount AS cut FROM lineitem),
      k AS (SELECT 'q' AS a, 'taxed' AS b, corr(q, taxed) AS v FROM v UNION ALL SELECT 'q', 'cut', corr(q, cut) FROM v UNION ALL SELECT 'taxed', 'cut', corr(taxed, cut) FROM v)
      SELECT a, b, round(v, 3) AS correlation FROM k WHERE abs(v) >= 0.8""",
)
def _(spark, d):
    df = load(spark, d, "lineitem").select(
        F.col("l_quantity").alias("q"), (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("taxed"), F.col("l_discount").alias("cut")
    )
    return stats.multicollinear_pairs(df, ["q", "taxed", "cut"])


# ------------------------------------------------------------------ tests
def _tested(df):
    return _sixes(df, "statistic", "dof", "p_value")


def _test_sql(name, cte, p_sql, dof2="NULL::DOUBLE"):
    return f"""WITH {cte}, pv AS ({p_sql}) SELECT '{name}' AS test, round(stat, 6) AS statistic, round(dof, 6) AS dof, {dof2} AS dof_error, round(p, 6) AS p_value, p < 0.05 AS significant FROM pv"""


def _chi_cte(a, b, table):
    return f"""o AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS o FROM {table} GROUP BY 1, 2), ra AS (SELECT a, sum(o) AS r FROM o GROUP BY 1), cb AS (SELECT b, sum(o) AS s FROM o GROUP BY 1),
      k AS (SELECT (SELECT count(*) FROM ra) - 1 AS da, (SELECT count(*) FROM cb) - 1 AS db, (SELECT sum(o) FROM o) AS t),
      cells AS (SELECT coalesce(o, 0) AS o, r * s / t AS e, da * db AS dof FROM ra CROSS JOIN cb CROSS JOIN k LEFT JOIN o ON o.a = ra.a AND o.b = cb.b),
      st AS (SELECT sum(pow(CASE WHEN dof = 1 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE abs(o - e) END, 2) / e) AS stat, any_value(dof)::DOUBLE AS dof FROM cells)"""


@query("chi_square_independence", _test_sql("chi-square independence", _chi_cte("o_orderpriority", "o_orderstatus", "orders"), chi2_tail("st", "stat", "dof", "stat, dof")))
def _(spark, d):
    return _tested(stats.chi_square_independence(load(spark, d, "orders"), "o_orderpriority", "o_orderstatus"))


@query(
    "chi_square_two_by_two",
    _test_sql("chi-square independence", _chi_cte("l_linestatus", "l_quantity > 25", "lineitem"), chi2_tail("st", "stat", "dof", "stat, dof")),
)
def _(spark, d):
    df = load(spark, d, "lineitem").withColumn("large", F.col("l_quantity") > 25)
    return _tested(stats.chi_square_independence(df, "l_linestatus", "large"))


@query(
    "chi_square_goodness_of_fit",
    _test_sql(
        "chi-square goodness of fit",
        "c AS (SELECT count(*)::DOUBLE AS o FROM orders GROUP BY o_orderpriority), st AS (SELECT sum(pow(o - m, 2) / m) AS stat, count(*)::DOUBLE - 1 AS dof FROM c, (SELECT avg(o) AS m FROM c))",
        chi2_tail("st", "stat", "dof", "stat, dof"),
    ),
)
def _(spark, d):
    return _tested(stats.chi_square_goodness_of_fit(load(spark, d, "orders"), "o_orderpriority"))


@query(
    "welch_t_test",
    _test_sql(
        "welch t-test",
        """g AS (SELECT l_linestatus AS s, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) / count(*) AS v FROM lineitem GROUP BY 1),
        st AS (SELECT (a.m - b.m) / sqrt(a.v + b.v) AS stat, pow(a.v + b.v, 2) / (a.v * a.v / (a.n - 1) + b.v * b.v / (b.n - 1)) AS dof FROM g a, g b WHERE a.s = 'F' AND b.s = 'O')""",
        t_two_sided("st", "stat", "dof", "stat, dof"),
    ),
)
def _(spark, d):
    return _tested(stats.welch_t_test(load(spark, d, "lineitem"), "l_quantity", "l_linestatus"))


@query(
    "one_way_anova",
    _test_sql(
        "one-way anova",
        """g AS (SELECT o_orderpriority AS s, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) * (count(*) - 1) AS w FROM orders GROUP BY 1), u AS (SELECT avg(o_totalprice) AS mu, count(*) AS tot FROM orders),
        st AS (SELECT (sum(n * pow(m - mu, 2)) / (count(*) - 1)) / (sum(w) / (any_value(tot) - count(*))) AS stat, count(*)::DOUBLE - 1 AS dof, any_value(tot)::DOUBLE - count(*) AS dof2 FROM g, u)""",
        f_tail("st", "stat", "dof", "dof2", "stat, dof, dof2"),
        "dof2",
    ),
)
def _(spark, d):
    return _tested(stats.one_way_anova(load(spark, d, "orders"), "o_totalprice", "o_orderpriority"))


@query(
    "correlation_test",
    _test_sql(
        "pearson correlation",
        "st AS (SELECT corr(value, user_id) AS stat, count(*)::DOUBLE - 2 AS dof FROM events)",
        t_two_sided("st", "stat * sqrt(dof / (1 - stat * stat))", "dof", "stat, dof"),
    ),
)
def _(spark, d):
    return _tested(stats.correlation_test(load(spark, d, "events"), "value", "user_id"))


@query(
    "normality_k2",
    """WITH v AS (SELECT 'l_quantity' AS column_name, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem),
      m AS (SELECT column_name, count(*)::DOUBLE AS n, skewness(x) AS skewness, kurtosis(x) AS kurtosis, skewness_pop AS g1, kurtosis_pop(x) AS g2 FROM
        (SELECT v.*, sk.skewness_pop FROM v JOIN (SELECT column_name, avg(pow(x - mu, 3)) / pow(avg(pow(x - mu, 2)), 1.5) AS skewness_pop FROM v JOIN (SELECT column_name, avg(x) AS mu FROM v GROUP BY 1) USING (column_name) GROUP BY 1) sk USING (column_name)) GROUP BY column_name, skewness_pop),
      z AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
        (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS k,
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS root FROM m),
      w AS (SELECT *, -1 + sqrt(2 * (beta - 1)) AS w2, 6 + 8 / root * (2 / root + sqrt(1 + 4 / (root * root))) AS a FROM z),
      zz AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, ((1 - 2 / (9 * a)) - cbrt((1 - 2 / a) / (1 + k * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM w)
      SELECT column_name, CAST(n AS BIGINT) AS n, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(z1 * z1 + z2 * z2, 4) AS k2, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p_value,
        exp(-(z1 * z1 + z2 * z2) / 2) >= 0.05 AS looks_normal, CASE WHEN abs(g1) < 0.5 THEN 'roughly symmetric' WHEN g1 > 0 THEN 'skewed right' ELSE 'skewed left' END AS shape FROM zz""",
)
def _(spark, d):
    out = stats.normality_k2(load(spark, d, "lineitem"), ["l_quantity", "l_tax"])
    return _sixes(out, "skewness", "kurtosis", "p_value").withColumn("k2", F.round("k2", 4))


@query(
    "drivers",
    f"""WITH f AS (SELECT *, l_returnflag = 'R' AS y FROM lineitem),
      nums AS (SELECT 'l_quantity' AS c, l_quantity AS x, y FROM f UNION ALL SELECT 'l_extendedprice', l_extendedprice, y FROM f),
      mo AS (SELECT c, count(*) FILTER (y) AS na, avg(x) FILTER (y) AS ma, var_samp(x) FILTER (y) AS va, count(*) FILTER (NOT y) AS nb, avg(x) FILTER (NOT y) AS mb, var_samp(x) FILTER (NOT y) AS vb FROM nums GROUP BY c),
      tt AS (SELECT c, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS dof,
        abs(ma - mb) / sqrt((va + vb) / 2) AS strength, ma, mb FROM mo),
      {_chi_cte('l_linestatus', 'y', 'f')}, rate AS (SELECT l_linestatus AS s, 100 * avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS r FROM f GROUP BY 1),
      p1 AS ({t_two_sided('tt', 't', 'dof', 'c, strength, ma, mb')}), p2 AS ({chi2_tail('st', 'stat', 'dof', 'stat')})
      SELECT c AS column_name, 't-test' AS test, round(strength, 3) AS strength, round(p, 4) AS p_value, round(ma, 4) AS first, round(mb, 4) AS second, NULL AS detail, p < 0.05 AS significant FROM p1
      UNION ALL SELECT 'l_linestatus', 'chi-square', round(sqrt(stat / (SELECT count(*) FROM f)), 3), round(p, 4), round((SELECT max(r) FROM rate), 4), round((SELECT min(r) FROM rate), 4),
        (SELECT max_by(s, r) || ' to ' || min_by(s, r) FROM rate), p < 0.05 FROM p2""",
)
def _(spark, d):
    df = load(spark, d, "lineitem").withColumn("returned", F.when(F.col("l_returnflag") == "R", "R").otherwise("kept"))
    kinds = {"l_quantity": "numeric", "l_extendedprice": "numeric", "l_linestatus": "categorical", "returned": "categorical"}
    out = stats.drivers(df, "returned", list(kinds), kinds, "R").withColumn("p_value", F.round("p_value", 4))
    return out.withColumns({x: F.round(x, 4) for x in ("first", "second")})


@query(
    "drivers_of_number",
    f"""WITH g AS (SELECT * FROM gaps), {GAPS_SQL}, pr AS (SELECT o_orderkey AS x, price AS y FROM gaps WHERE price IS NOT NULL), rk AS (SELECT {rank_avg('x')} AS rx, {rank_avg('y')} AS ry FROM pr),
      sp AS (SELECT corr(rx, ry) AS rho, count(*) AS n FROM rk), s1 AS (SELECT rho, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, n - 2 AS dof FROM sp),
      m AS (SELECT o_orderpriority AS s, count(price) AS n, avg(price) AS m, var_samp(price) * (count(price) - 1) AS w FROM gaps GROUP BY 1), u AS (SELECT avg(price) AS mu, var_samp(price) * (count(*) - 1) AS grand, count(price) AS tot FROM gaps),
      s2 AS (SELECT (sum(n * pow(m - mu, 2)) / (count(*) - 1)) / (sum(w) / (any_value(tot) - count(*))) AS f, count(*) - 1 AS d1, any_value(tot) - count(*) AS d2, sqrt(sum(n * pow(m - mu, 2)) / any_value(grand)) AS strength,
        min(m) AS lo, max(m) AS hi, min_by(s, m) || ' to ' || max_by(s, m) AS note FROM m, u),
      p1 AS ({t_two_sided('s1', 't', 'dof', 'rho')}), p2 AS ({f_tail('s2', 'f', 'd1', 'd2', 'strength, lo, hi, note')})
      SELECT 'o_orderkey' AS column_name, 'spearman' AS test, round(abs(rho), 3) AS strength, round(p, 6) AS p_value, round(rho, 4) AS first, NULL AS second, NULL AS detail, p < 0.05 AS significant FROM p1
      UNION ALL SELECT 'o_orderpriority', 'anova', round(strength, 3), round(p, 6), round(lo, 4), round(hi, 4), note, p < 0.05 FROM p2""".replace("g AS (SELECT * FROM gaps), ", ""),
)
def _(spark, d):
    kinds = {"o_orderkey": "numeric", "o_orderpriority": "categorical", "price": "numeric"}
    out = _sixes(stats.drivers(gap_orders(spark, d), "price", list(kinds), kinds), "p_value")
    return out.withColumns({x: F.round(x, 4) for x in ("first", "second")})
