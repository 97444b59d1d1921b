"""Correlation, covariance and significance tests.

Spark computes each statistic over all rows; only its tail probability is taken
on the driver.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabella.functions.distributions import (
    SIGNIFICANT, chi2_upper, correlation_p, f_upper, t_two_sided,
)
from tabella.functions.quantiles import rank_average
from tabella.functions.scalar import c, number
from tabella.operators.profile import wide_agg
from tabella.session import spool

STRONG, MODERATE = 0.7, 0.4
COLLINEAR = 0.8


def _numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[number(df, x).alias(x) for x in cols])


def ranked_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tie-averaged ranks of two columns over their complete pairs, with a weight.

    Rows are first collapsed to (x, y, count), then each distinct value is ranked.
    """
    full = spool(_numbers(df, [x, y]).toDF("x", "y").dropna(), "pair")
    pairs = full.groupBy("x", "y").agg(F.count("*").alias("w"))
    return (
        pairs.join(rank_average(full, "x", "rx").select("x", "rx"), "x")
        .join(rank_average(full, "y", "ry").select("y", "ry"), "y")
        .select("rx", "ry", "w")
    )


def weighted_corr(df: DataFrame, a: str, b: str, w: str) -> float | None:
    """Pearson correlation of counted pairs."""
    A, B, W = F.col(a), F.col(b), F.col(w).cast("double")
    m = df.agg(F.sum(W).alias("n"), (F.sum(W * A) / F.sum(W)).alias("ma"), (F.sum(W * B) / F.sum(W)).alias("mb")).first()
    if not m["n"]:
        return None
    da, db = A - F.lit(m["ma"]), B - F.lit(m["mb"])
    s = df.agg(F.sum(W * da * db), F.sum(W * da * da), F.sum(W * db * db)).first()
    return s[0] / math.sqrt(s[1] * s[2]) if s[1] and s[2] else None


def spearman(df: DataFrame, x: str, y: str) -> float | None:
    return weighted_corr(ranked_pair(df, x, y), "rx", "ry", "w")


def bivariate_numeric(df: DataFrame, x: str, y: str) -> DataFrame:
    """Covariance, Pearson and Spearman correlation with p-values on complete pairs."""
    spark = df.sparkSession
    pair = _numbers(df, [x, y]).toDF("x", "y").dropna()
    a = pair.agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("cov"), F.corr("x", "y").alias("r")).first()
    rho = spearman(df, x, y)
    rows = [
        ("n", float(a["n"])), ("covariance", a["cov"]), ("pearson_r", a["r"]), ("pearson_p", correlation_p(spark, a["r"], a["n"])),
        ("spearman_rho", rho), ("spearman_p", correlation_p(spark, rho, a["n"])),
    ]
    return spark.createDataFrame(rows, "measure string, value double")


def _pairwise(df: DataFrame, cols: list[str], how: str) -> dict[tuple[str, str], float | None]:
    """corr or covar_samp of every pair in one aggregate (pairwise complete)."""
    df = _numbers(df, cols)
    fn = F.corr if how == "pearson" else F.covar_samp
    todo = list(combinations(cols, 2)) + ([] if how == "pearson" else [(x, x) for x in cols])
    return wide_agg(df, {(a, b): fn(c(a), c(b)) for a, b in todo}) if todo else {}


def correlations(df: DataFrame, cols: list[str], method: str = "pearson") -> dict[tuple[str, str], float | None]:
    if method == "pearson":
        return _pairwise(df, cols, "pearson")
    flat = spool(_numbers(df, cols), "numbers")
    gaps = wide_agg(flat, {x: F.count_if(c(x).isNull()) for x in cols}) if cols else {}
    whole = [x for x in cols if not gaps[x]]
    # Columns without gaps are ranked once and share one aggregate; a pair with
    # gaps is ranked on its own complete rows.
    ranked = flat.select(*[c(x) for x in whole])
    for i, x in enumerate(whole):
        ranked = ranked.join(rank_average(flat, x, f"_r{i}").select(c(x), f"_r{i}"), x)
    got = wide_agg(
        ranked, {(whole[i], whole[j]): F.corr(f"_r{i}", f"_r{j}") for i, j in combinations(range(len(whole)), 2)}
    ) if len(whole) > 1 else {}
    return {(a, b): got[a, b] if (a, b) in got else spearman(df, a, b) for a, b in combinations(cols, 2)}


def _square(df: DataFrame, cols: list[str], values: dict, diagonal: dict | None, digits: int, name: str) -> DataFrame:
    def cell(a: str, b: str) -> float | None:
        if a == b and diagonal is None:
            return 1.0
        v = values.get((a, b), values.get((b, a)))
        return None if v is None else v

    rows = [(a, b, cell(a, b)) for a in cols for b in cols]
    out = df.sparkSession.createDataFrame(rows, f"row_name string, column_name string, {name} double")
    return out.withColumn(name, F.round(name, digits))


def correlation_matrix(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    """Correlation of every pair, one row per cell."""
    return _square(df, cols, correlations(df, cols, method), None, 3, "value")


def covariance_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    return _square(df, cols, _pairwise(df, cols, "covariance"), {}, 2, "value")


def strongest_pairs(df: DataFrame, cols: list[str], n: int = 8) -> DataFrame:
    """The strongest rank correlations, labelled strong, moderate or weak."""
    found = [(a, b, v) for (a, b), v in correlations(df, cols, "spearman").items() if v is not None]
    found.sort(key=lambda t: -abs(t[2]))
    label = lambda v: "strong" if abs(v) >= STRONG else "moderate" if abs(v) >= MODERATE else "weak"
    return df.sparkSession.createDataFrame(
        [(a, b, round(v, 4), label(v)) for a, b, v in found[:n]], "a string, b string, correlation double, strength string"
    )


def _indicators(df: DataFrame, cols: list[str], profile: dict[str, str], target: str, positive: str | None) -> DataFrame:
    """Numbers as they are; two-valued categories and the outcome as 1/0 columns."""
    cats = [x for x in cols if profile.get(x) == "categorical"]
    got = wide_agg(df, {x: F.struct(F.count_distinct(c(x)).alias("k"), F.max(c(x).cast("string")).alias("hi"), F.count_if(c(x).cast("string") == "Yes").alias("yes")) for x in cats}) if cats else {}
    out: list[Column] = []
    for x in cols:
        if profile.get(x) == "numeric":
            out.append(number(df, x).alias(x))
        elif x in got and got[x]["k"] == 2:
            pos = "Yes" if got[x]["yes"] else got[x]["hi"]
            out.append(F.coalesce((c(x).cast("string") == pos), F.lit(False)).cast("double").alias(f"{x} = {pos}"))
    if positive is not None:
        out.append(F.coalesce(c(target).cast("string") == positive, F.lit(False)).cast("double").alias(f"{target} = {positive}"))
    elif profile.get(target) == "numeric":
        out.append(number(df, target).alias(target))
    return df.select(*out)


def target_correlation(df: DataFrame, target: str, cols: list[str], profile: dict[str, str], positive: str | None = None) -> DataFrame:
    flat = _indicators(df, [x for x in cols if x != target], profile, target, positive)
    return correlation_matrix(flat, flat.columns)


def multicollinear_pairs(df: DataFrame, cols: list[str], limit: float = COLLINEAR) -> DataFrame:
    """Pairs of inputs so alike that a model cannot tell them apart."""
    rows = [(a, b, round(v, 3)) for (a, b), v in correlations(df, cols).items() if v is not None and abs(round(v, 3)) >= limit]
    return df.sparkSession.createDataFrame(rows, "a string, b string, correlation double")


# ------------------------------------------------------------------ tests
TEST_SCHEMA = "test string, statistic double, dof double, dof_error double, p_value double, significant boolean"


def _test(df: DataFrame, name: str, stat: float | None, dof: float | None, dof2: float | None, p: float | None) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(name, stat, dof, dof2, p, None if p is None else p < SIGNIFICANT)], TEST_SCHEMA
    )


def chi_square_facts(df: DataFrame, a: str, b: str) -> dict:
    """Statistic, degrees of freedom, total and smaller side of a two-way table.

    Works on the counted table; cells that never occur add their expected count.
    """
    n = (
        df.select(c(a).cast("string").alias("a"), c(b).cast("string").alias("b")).dropna().groupBy("a", "b").agg(F.count("*").cast("double").alias("o"))
    )
    size = n.agg(F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"), F.sum("o").alias("t")).first()
    ka, kb, t = size["ka"], size["kb"], size["t"] or 0.0
    dof = (ka - 1) * (kb - 1)
    if dof <= 0:
        return {"stat": None, "dof": dof, "n": t, "side": min(ka, kb)}
    cell = n.select(
        "a", "b", "o", F.sum("o").over(Window.partitionBy("a")).alias("ra"), F.sum("o").over(Window.partitionBy("b")).alias("cb")
    ).withColumn("e", F.col("ra") * F.col("cb") / F.lit(t))
    gap = F.abs(F.col("o") - F.col("e"))
    # Continuity correction for a 2 x 2 table, as statistics packages apply by default.
    diff = gap - F.least(F.lit(0.5), gap) if dof == 1 else gap
    s = cell.agg(F.sum(diff * diff / F.col("e")).alias("x"), F.sum("e").alias("e"), F.count("*").alias("k")).first()
    if dof == 1 and s["k"] < 4:
        # A 2 x 2 table with an empty cell: finish the missing cell from the margins.
        margin = cell.groupBy("a").agg(F.first("ra").alias("ra")).collect(), cell.groupBy("b").agg(F.first("cb").alias("cb")).collect()
        seen = {(r["a"], r["b"]) for r in cell.select("a", "b").collect()}
        rest = sum(
            (e - min(0.5, e)) ** 2 / e for ra in margin[0] for cb in margin[1] if (ra["a"], cb["b"]) not in seen for e in [ra["ra"] * cb["cb"] / t]
        )
    else:
        rest = t - s["e"]
    return {"stat": s["x"] + rest, "dof": dof, "n": t, "side": min(ka, kb)}


def chi_square_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    f = chi_square_facts(df, a, b)
    return _test(df, "chi-square independence", f["stat"], float(f["dof"]), None, chi2_upper(df.sparkSession, f["stat"], f["dof"]))


def chi_square_goodness_of_fit(df: DataFrame, col: str) -> DataFrame:
    """Against an even split over the categories."""
    n = df.where(c(col).isNotNull()).groupBy(c(col)).agg(F.count("*").cast("double").alias("o"))
    a = n.agg(F.count("*").alias("k"), F.sum("o").alias("t"), F.sum(F.col("o") * F.col("o")).alias("s")).first()
    stat, dof = (a["s"] * a["k"] / a["t"] - a["t"], a["k"] - 1) if a["k"] else (None, 0)
    return _test(df, "chi-square goodness of fit", stat, float(dof), None, chi2_upper(df.sparkSession, stat, dof))


def _group_moments(df: DataFrame, num: str, group: str) -> list:
    v = number(df, num)
    g = df.where(c(group).isNotNull()).groupBy(c(group).cast("string").alias("g"))
    return sorted(g.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s2"), F.count("*").alias("rows")).collect(), key=lambda r: r["g"])


def welch(a, b) -> tuple[float | None, float | None]:
    """t and degrees of freedom of two groups given (n, m, s2)."""
    if a["n"] < 2 or b["n"] < 2:
        return None, None
    va, vb = a["s2"] / a["n"], b["s2"] / b["n"]
    if va + vb == 0:
        return None, None
    dof = (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
    return (a["m"] - b["m"]) / math.sqrt(va + vb), dof


def welch_t_test(df: DataFrame, num: str, group: str) -> DataFrame:
    """Two groups (in sorted order), unequal variances."""
    if df.where(c(group).isNotNull()).select(c(group)).distinct().limit(3).count() != 2:
        raise ValueError(f"A t-test needs exactly 2 groups in '{group}'. Use ANOVA for 3 or more.")
    t, dof = welch(*_group_moments(df, num, group))
    return _test(df, "welch t-test", t, dof, None, t_two_sided(df.sparkSession, t, dof))


def anova(groups: list) -> tuple[float | None, int, int, float]:
    """F, both degrees of freedom, and the between-group sum of squares."""
    groups = [g for g in groups if g["n"]]
    n, k = sum(g["n"] for g in groups), len(groups)
    if k < 2 or n <= k:
        return None, k - 1, n - k, 0.0
    mean = sum(g["n"] * g["m"] for g in groups) / n
    between = sum(g["n"] * (g["m"] - mean) ** 2 for g in groups)
    within = sum((g["n"] - 1) * (g["s2"] or 0.0) for g in groups)
    return (between / (k - 1)) / (within / (n - k)) if within else math.inf, k - 1, n - k, between


def one_way_anova(df: DataFrame, num: str, group: str) -> DataFrame:
    """Three or more groups. The per-group moments are all that leaves Spark."""
    v = number(df, num)
    per = df.where(c(group).isNotNull()).groupBy(c(group).alias("g")).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s2"))
    per = per.where("n > 0")
    a = per.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"),
        F.sum((F.col("n") - 1) * F.coalesce("s2", F.lit(0.0))).alias("within"),
    ).first()
    if a["k"] < 3:
        raise ValueError(f"ANOVA needs 3 or more groups in '{group}', but found {a['k']}. Use a t-test for 2 groups.")
    mean = a["s"] / a["n"]
    between = per.agg(F.sum(F.col("n") * (F.col("m") - mean) ** 2)).first()[0]
    d1, d2 = a["k"] - 1, a["n"] - a["k"]
    f = (between / d1) / (a["within"] / d2) if d2 and a["within"] else None
    return _test(df, "one-way anova", f, float(d1), float(d2), f_upper(df.sparkSession, f, d1, d2))


def correlation_test(df: DataFrame, x: str, y: str) -> DataFrame:
    pair = _numbers(df, [x, y]).toDF("x", "y").dropna()
    a = pair.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r")).first()
    return _test(df, "pearson correlation", a["r"], float(a["n"] - 2), None, correlation_p(df.sparkSession, a["r"], a["n"]))


# ------------------------------------------------------------------ normality
def k_squared(n: int, skew: float | None, kurt: float | None) -> tuple[float | None, float | None]:
    """D'Agostino-Pearson K2 and its p-value from population skewness and excess kurtosis."""
    if n < 20 or skew is None or kurt is None or math.isnan(skew):
        return None, None
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta - 1))
    delta = 1 / math.sqrt(0.5 * math.log(w2))
    alpha = math.sqrt(2.0 / (w2 - 1))
    z1 = delta * math.asinh(y / alpha)
    expected = 3.0 * (n - 1) / (n + 1)
    variance = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1.0) * (n + 3) * (n + 5))
    x = (kurt + 3 - expected) / math.sqrt(variance)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / root * (2.0 / root + math.sqrt(1 + 4.0 / root**2))
    ratio = (1 - 2.0 / a) / (1 + x * math.sqrt(2.0 / (a - 4.0)))
    cube = math.copysign(abs(ratio) ** (1 / 3), ratio)
    z2 = (1 - 2.0 / (9.0 * a) - cube) / math.sqrt(2.0 / (9.0 * a))
    k2 = z1 * z1 + z2 * z2
    return k2, math.exp(-k2 / 2)


def normality_k2(df: DataFrame, cols: list[str]) -> DataFrame:
    """Skewness, excess kurtosis and a normality test per column, over all rows."""
    from tabella.operators.describe import sample_kurtosis, sample_skew

    flat = _numbers(df, cols)
    got = wide_agg(
        flat,
        {
            x: F.struct(
                F.count(c(x)).alias("n"), F.skewness(c(x)).alias("g1"), F.kurtosis(c(x)).alias("g2"), sample_skew(c(x)).alias("G1"),
                sample_kurtosis(c(x)).alias("G2"), F.max(c(x)).alias("hi"), F.min(c(x)).alias("lo"),
            )
            for x in cols
        },
    )
    rows = []
    for x in cols:
        f = got[x].asDict()
        k2, p = k_squared(f["n"], f["g1"], f["g2"])
        shape = None
        if f["g1"] is not None:
            shape = "roughly symmetric" if abs(f["g1"]) < 0.5 else "skewed right" if f["g1"] > 0 else "skewed left"
        rows.append((x, f["n"], f["G1"], f["G2"], k2, p, None if p is None else p >= SIGNIFICANT, shape))
    return df.sparkSession.createDataFrame(
        rows, "column_name string, n long, skewness double, kurtosis double, k2 double, p_value double, looks_normal boolean, shape string"
    )


# ------------------------------------------------------------------ drivers of a target
def drivers(df: DataFrame, target: str, cols: list[str], profile: dict[str, str], positive: str | None = None) -> DataFrame:
    """How strongly each input is linked to the target, with a significance test."""
    spark = df.sparkSession
    cols = [x for x in cols if x != target and x in df.columns]
    rows: list[tuple] = []
    cats = [x for x in cols if profile.get(x) == "categorical"]
    nums = [x for x in cols if profile.get(x) == "numeric"]
    outcome = profile.get(target) == "categorical" and df.agg(F.count_distinct(c(target))).first()[0] == 2
    if outcome:
        if positive is None:
            positive = df.agg(F.max(c(target).cast("string"))).first()[0]
        flag = F.coalesce(c(target).cast("string") == positive, F.lit(False))
        rows += _number_drivers(df, nums, flag, spark) + [r for x in cats for r in _category_driver(df, x, flag, spark)]
    elif profile.get(target) == "numeric":
        for x in nums:
            pair = _numbers(df, [x, target]).toDF("x", "y").dropna()
            n, rho = pair.count(), spearman(df, x, target)
            if rho is not None:
                rows.append((x, "spearman", abs(rho), correlation_p(spark, rho, n), rho, None, None))
        rows += [r for x in cats for r in _anova_driver(df, x, target, spark)]
    out = spark.createDataFrame(
        rows, "column_name string, test string, strength double, p_value double, first double, second double, detail string"
    )
    return out.withColumn("strength", F.round("strength", 3)).withColumn("significant", F.col("p_value") < SIGNIFICANT).orderBy(F.desc("strength"), "column_name")


def _number_drivers(df: DataFrame, nums: list[str], flag: Column, spark) -> list[tuple]:
    """Welch t and effect size of every number in one aggregate."""
    exprs = {}
    for x in nums:
        for side, on in (("a", flag), ("b", ~flag)):
            v = F.when(on, number(df, x))
            exprs[f"{side}:{x}"] = F.struct(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s2"))
    got = wide_agg(df, exprs) if exprs else {}
    rows = []
    for x in nums:
        a, b = got[f"a:{x}"], got[f"b:{x}"]
        if a["n"] < 3 or b["n"] < 3:
            continue
        t, dof = welch(a, b)
        spread = math.sqrt((a["s2"] + b["s2"]) / 2)
        rows.append((x, "t-test", abs(a["m"] - b["m"]) / spread if spread else None, t_two_sided(spark, t, dof), a["m"], b["m"], None))
    return rows


def _category_driver(df: DataFrame, x: str, flag: Column, spark) -> list[tuple]:
    t = df.select(c(x).cast("string").alias("x"), flag.cast("string").alias("y"), flag.alias("f")).where("x is not null")
    f = chi_square_facts(t, "x", "y")
    if f["stat"] is None:
        return []
    rate = t.groupBy("x").agg((100 * F.avg(F.col("f").cast("double"))).alias("r"))
    ends = rate.agg(F.max_by(F.struct("x", "r"), F.struct("r", "x")).alias("hi"), F.min_by(F.struct("x", "r"), F.struct("r", "x")).alias("lo")).first()
    strength = math.sqrt(f["stat"] / (f["n"] * (f["side"] - 1)))
    note = f"{ends['hi']['x']} to {ends['lo']['x']}"
    return [(x, "chi-square", strength, chi2_upper(spark, f["stat"], f["dof"]), ends["hi"]["r"], ends["lo"]["r"], note)]


def _anova_driver(df: DataFrame, x: str, target: str, spark) -> list[tuple]:
    """Only sums over the groups leave Spark, so a category may have any number of values."""
    v = number(df, target)
    whole = df.agg(F.var_samp(v).alias("s2"), F.avg(v).alias("m"), F.count("*").alias("n")).first()
    groups = df.where(c(x).isNotNull()).groupBy(c(x).cast("string").alias("g"))
    groups = groups.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s2"), F.count("*").alias("rows"))
    used = F.col("rows") >= 3
    full = used & (F.col("n") > 0)
    gap = F.col("m") - F.lit(whole["m"])
    end = F.when(F.col("m").isNotNull(), F.struct("m", "g"))
    s = groups.agg(
        F.count_if(used).alias("used"), F.count_if(full).alias("k"), F.sum(F.when(full, F.col("n"))).alias("n"),
        F.sum(F.when(full, F.col("n") * gap)).alias("s1"), F.sum(F.when(full, F.col("n") * gap * gap)).alias("s2"),
        F.sum(F.when(full, (F.col("n") - 1) * F.coalesce("s2", F.lit(0.0)))).alias("within"), F.min(end).alias("lo"), F.max(end).alias("hi"),
    ).first()
    if s["used"] < 2:
        return []
    f, d1, d2 = None, s["k"] - 1, (s["n"] or 0) - s["k"]
    if s["k"] >= 2 and d2 > 0:
        between = s["s2"] - s["s1"] ** 2 / s["n"]  # around the mean of the groups used
        f = (between / d1) / (s["within"] / d2) if s["within"] else math.inf
    grand = whole["s2"] * (whole["n"] - 1) if whole["s2"] is not None else 0
    note = f"{s['lo']['g']} to {s['hi']['g']}"
    return [(x, "anova", math.sqrt(s["s2"] / grand) if grand else None, f_upper(spark, f, d1, d2), s["lo"]["m"], s["hi"]["m"], note)]
