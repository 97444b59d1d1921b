"""Preparation: bins, encodings, scaling, transforms, Gaussian mapping, splits, PCA."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabella.functions.distributions import normal_quantile
from tabella.functions.ordering import add_position
from tabella.functions.quantiles import column_quantiles, many_quantiles
from tabella.functions.scalar import c, join_keys, number
from tabella.operators.describe import bin_index, category_counts
from tabella.operators.profile import ordinal_orders, ordinal_rank, wide_agg
from tabella.operators.stats import normality_k2
from tabella.session import cheap_to_cache, spool, stage

LOW_MEDIUM_HIGH = ["Low", "Medium", "High"]
QUANTILES = 1000
EDGE = 1e-7


# ------------------------------------------------------------------ categories
def bin_numeric(
    df: DataFrame, col: str, k: int = 4, method: str = "equal width", labels: list[str] | None = None, out: str | None = None
) -> DataFrame:
    """A number as k ordered labels; ranges are closed on the right."""
    labels = labels or {3: LOW_MEDIUM_HIGH}.get(k, list(map("Bin {}".format, range(1, k + 1))))
    v = number(df, col)
    if method == "equal frequency":
        edges = sorted(set(column_quantiles(df.select(v.alias("v")), {"v": [i / k for i in range(k + 1)]})["v"]))
        if len(edges) - 1 != len(labels):
            raise ValueError("Repeated values leave fewer groups than labels; ask for fewer groups.")
    else:
        lo, hi = df.agg(F.min(v), F.max(v)).first()
        if lo == hi:
            step = 0.001 * abs(lo) or 0.001
            lo, hi = lo - step, hi + step
        edges = [lo + (hi - lo) * i / k for i in range(k)] + [hi]
    names = F.array(*[F.lit(x) for x in labels])
    return df.withColumn(out or f"{col}_bin", F.get(names, bin_index(v, edges)))


def category_places(df: DataFrame, col: str) -> DataFrame:
    """(``value``, ``place``): every category with its place from 0 in sorted order, numbered over ranges where there are many."""
    values = df.select(c(col).cast("string").alias("value")).dropna().distinct()
    return add_position(values, [], "value", None, "place").withColumn("place", (F.col("place") - 1).cast("int"))


def one_hot_sparse(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """A sparse 0/1 vector with an entry per category; a missing value has none. Only the number of categories reaches the driver."""
    out = out or f"{col}_vector"
    places = stage(category_places(df, col), "places")
    size = places.count()
    coded = join_keys(df.withColumn("_value", c(col).cast("string")), places.withColumnRenamed("value", "_value"), ["_value"])
    flags = OneHotEncoder(inputCol="place", outputCol=out, dropLast=True, handleInvalid="keep")
    coded = coded.withColumn("place", F.coalesce("place", F.lit(size)))
    known = df.sparkSession.range(max(size, 1)).select(F.col("id").cast("int").alias("place"))
    return flags.fit(known).transform(coded).drop("_value", "place")


def one_hot(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """One 0/1 column for each of ``values``, which the caller names; see ``one_hot_sparse`` for all of many categories."""
    text = c(col).cast("string")
    return df.withColumns({f"{col}_{v}": F.coalesce((text == F.lit(v)).cast("int"), F.lit(0)) for v in values})


def ordinal_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """1..k by the natural order when one is known, else by frequency."""
    out = out or f"{col}_rank"
    order = ordinal_orders(df.select(c(col)), [col])[col]
    if order:
        return df.withColumn(out, F.when(c(col).isNotNull(), ordinal_rank(c(col), order) + 1).cast("long"))
    ranks = add_position(category_counts(df, col).withColumn("_rarity", -F.col("n")), [], "_rarity", "value", out)
    ranks = ranks.select(F.col("value").alias("_value"), c(out))
    return df.join(ranks, c(col).cast("string") == F.col("_value"), "left").drop("_value")


# ------------------------------------------------------------------ scaling
def rescale(df: DataFrame, cols: list[str], method: str = "min-max") -> DataFrame:
    """Min-max to 0..1, or z-scores with the population spread; constants become 0."""
    if method not in ("min-max", "z-score"):
        raise ValueError("Use min-max or z-score.")
    facts = wide_agg(
        df,
        {x: F.struct(F.min(number(df, x)).alias("lo"), F.max(number(df, x)).alias("hi"), F.avg(number(df, x)).alias("m"), F.stddev_pop(number(df, x)).alias("s")) for x in cols},
    )
    new: dict[str, Column] = {}
    for x in cols:
        f = facts[x]
        shift, scale = (f["lo"], (f["hi"] or 0) - (f["lo"] or 0)) if method == "min-max" else (f["m"], f["s"])
        new[x] = (number(df, x) - F.lit(shift)) / F.lit(scale) if scale else number(df, x) * 0
    return df.withColumns(new)


def rescale_minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    return rescale(df, cols, "min-max")


def rescale_zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    return rescale(df, cols, "z-score")


def _checked_minimum(df: DataFrame, col: str, allowed, message: str) -> None:
    low = df.agg(F.min(number(df, col))).first()[0]
    if low is not None and not allowed(low):
        raise ValueError(message)


def transform_log(df: DataFrame, col: str) -> DataFrame:
    """log(1 + x)."""
    _checked_minimum(df, col, lambda v: v >= 0, "Log transform needs values of 0 or more.")
    return df.withColumn(col, F.log1p(number(df, col)))


def transform_sqrt(df: DataFrame, col: str) -> DataFrame:
    _checked_minimum(df, col, lambda v: v >= 0, "Square root needs values of 0 or more.")
    return df.withColumn(col, F.sqrt(number(df, col)))


def transform_square(df: DataFrame, col: str) -> DataFrame:
    v = number(df, col)
    return df.withColumn(col, v * v)


# ------------------------------------------------------------------ power transforms
def box_cox_value(v: Column, lam: Column) -> Column:
    return F.when(F.abs(lam) < 1e-12, F.ln(v)).otherwise((F.pow(v, lam) - 1) / lam)


def yeo_johnson_value(v: Column, lam: Column) -> Column:
    """Box-Cox of 1 + |v|, with the exponent mirrored around 1 below zero."""
    size, power = F.abs(v) + 1, F.when(v >= 0, lam).otherwise(2 - lam)
    return F.when(v >= 0, 1).otherwise(-1) * box_cox_value(size, power)


@dataclass
class _Search:
    """Where one column's exponent is being looked for."""

    method: str
    low: float = -2.0
    high: float = 2.0
    best: float = 0.0
    done: bool = False


def fit_lambdas(df: DataFrame, methods: dict[str, str], points: int = 16) -> dict[str, float]:
    """Maximum-likelihood exponents of several columns.

    Each pass sums every column's values under a small grid of exponents, whole
    batches at a time in the task that reads them; the next grid lies around the
    best point, and a parabola through the last three finishes it.
    """
    names = list(methods)
    flat = spool(df.select(*[number(df, x).alias(f"v{i}") for i, x in enumerate(names)]), "powers", cheap_to_cache(df))
    state = {x: _Search(m) for x, m in methods.items()}
    while open_ := [i for i, x in enumerate(names) if not state[x].done]:
        grids = {i: [state[names[i]].low + (state[names[i]].high - state[names[i]].low) / points * j for j in range(points + 1)] for i in open_}
        found = _power_sums(flat, {i: (grids[i], methods[names[i]] == "box-cox") for i in open_})
        for i in open_:
            score = [
                (g - 1) * r["w"] - r["n"] / 2 * math.log(r["s2"]) if r and r["s2"] and math.isfinite(r["s2"]) else -math.inf
                for j, g in enumerate(grids[i]) for r in [found.get((i, j))]
            ]
            _closer(state[names[i]], grids[i], score)
    return {x: s.best for x, s in state.items()}


def _powers(v: np.ndarray, g: float, box: bool) -> np.ndarray:
    """Box-Cox or Yeo-Johnson of all values with one exponent."""
    if box:
        return np.log(v) if abs(g) < 1e-12 else np.expm1(g * np.log(v)) / g
    up, size = v >= 0, np.log1p(np.abs(v))
    high = size if abs(g) < 1e-12 else np.expm1(g * size) / g
    low = -size if abs(2 - g) < 1e-12 else -np.expm1((2 - g) * size) / (2 - g)
    return np.where(up, high, low)


def _power_sums(flat: DataFrame, grids: dict[int, tuple[list[float], bool]]) -> dict:
    """Per (column, place in its grid): rows ``n``, ``w`` that the exponent multiplies in the likelihood, and the variance ``s2``.

    A task keeps rows, mean and squared deviations of what it has read; tasks are put together around the common mean.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [(i, j) for i, (grid, _) in grids.items() for j in range(len(grid))]
        sums = {key: np.zeros(4) for key in keys}  # rows, weights, mean, squared deviations
        for batch in batches:
            for i, (grid, box) in grids.items():
                v = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                if not len(v):
                    continue
                with np.errstate(all="ignore"):
                    weight = float((np.log(v) if box else np.sign(v) * np.log1p(np.abs(v))).sum())
                    for j, g in enumerate(grid):
                        made, s = _powers(v, g, box), sums[i, j]
                        mean = made.mean()
                        n, apart = s[0] + len(v), mean - s[2]
                        s[3] += ((made - mean) ** 2).sum() + apart * apart * s[0] * len(v) / n
                        s[2] += apart * len(v) / n
                        s[0], s[1] = n, s[1] + weight
        rows = [(*key, *sums[key]) for key in keys if sums[key][0]]
        kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[p] for r in rows], kind) for p, kind in enumerate(kinds)], ["k", "j", "n", "w", "m", "d"])

    parts = flat.mapInArrow(run, "k int, j int, n double, w double, m double, d double")
    whole = Window.partitionBy("k", "j")  # a row a task
    parts = parts.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(whole) / F.sum("n").over(whole))
    spread = F.sum(F.col("d") + F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))) / F.sum("n")
    rows = parts.groupBy("k", "j").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), spread.alias("s2")).collect()  # columns x grid
    return {(r["k"], r["j"]): r for r in rows}


def _closer(s: _Search, grid: list[float], score: list[float]) -> None:
    top = max(range(len(grid)), key=score.__getitem__)
    step, s.best = grid[1] - grid[0], grid[top]
    edge = top in (0, len(grid) - 1)
    if edge and abs(s.best) < 40:
        s.low, s.high = s.best - 2.0, s.best + 2.0
    elif step < 2e-3 or edge:
        s.done = True
        if not edge:
            a, b, e = score[top - 1], score[top], score[top + 1]
            bend = a - 2 * b + e
            s.best += step * 0.5 * (a - e) / bend if bend else 0.0
    else:
        s.low, s.high = s.best - step, s.best + step


@dataclass
class Gaussian:
    """Parameters of one column's mapping, learnt on one table and usable on any."""

    column: str
    method: str
    lam: float | None = None
    mean: float = 0.0
    std: float = 1.0
    quantiles: list[float] | None = None


def fit_gaussian(df: DataFrame, cols: list[str], method: str = "yeo-johnson", standardise: bool = True) -> list[Gaussian]:
    """Learn the mapping of each column with more than two values."""
    facts = wide_agg(df, {x: F.struct(F.approx_count_distinct(number(df, x)).alias("k"), F.min(number(df, x)).alias("lo"), F.count(number(df, x)).alias("n")) for x in cols})
    chosen: dict[str, str] = {}
    for x in cols:
        f = facts[x]
        if f["k"] <= 4 and df.select(number(df, x).alias("v")).dropna().distinct().limit(3).count() <= 2:
            continue
        chosen[x] = "yeo-johnson" if method == "box-cox" and f["lo"] <= 0 else method
    powers = {x: m for x, m in chosen.items() if m != "quantile"}
    lambdas = fit_lambdas(df, powers) if powers else {}
    out = []
    for x, how in chosen.items():
        if how == "quantile":
            k = min(QUANTILES, facts[x]["n"])
            probs = [i / (k - 1) for i in range(k)]
            out.append(Gaussian(x, how, quantiles=many_quantiles(df.select(number(df, x).alias("v")), "v", probs)))
        else:
            out.append(Gaussian(x, how, lambdas[x]))
    if standardise and powers:
        fitted = [g for g in out if g.method != "quantile"]
        got = wide_agg(df, {g.column: F.struct(F.avg(_power(df, g)).alias("m"), F.stddev_pop(_power(df, g)).alias("s")) for g in fitted})
        for g in fitted:
            g.mean, g.std = got[g.column]["m"], got[g.column]["s"]
    return out


def _power(df: DataFrame, g: Gaussian) -> Column:
    v = number(df, g.column)
    if g.method == "box-cox":
        return F.when(v > 0, box_cox_value(v, F.lit(g.lam)))
    return yeo_johnson_value(v, F.lit(g.lam))


def _normal_scores(edges: list[float]):
    """A vectorized function: value -> place among the quantiles -> normal score."""
    knots = np.asarray(edges, dtype=float)
    shares = np.linspace(0, 1, len(knots))

    @F.pandas_udf("double")
    def scores(v: pd.Series) -> pd.Series:
        x = v.to_numpy(dtype=float)
        # Runs of equal knots: take the middle of the run.
        p = 0.5 * (np.interp(x, knots, shares) - np.interp(-x, -knots[::-1], -shares[::-1]))
        ok = ~np.isnan(p)
        out = np.full(len(p), np.nan)
        out[ok] = normal_quantile(np.clip(p[ok], EDGE, 1 - EDGE))
        return pd.Series(out)

    return scores


def apply_gaussian(df: DataFrame, fitted: list[Gaussian], digits: int = 5) -> DataFrame:
    """Apply learnt mappings; columns that are not there are passed over."""
    new = {}
    for g in fitted:
        if g.column not in df.columns:
            continue
        if g.method == "quantile":
            v = number(df, g.column)
            value = F.when(v.isNotNull(), _normal_scores(g.quantiles)(v))
        else:
            value = (_power(df, g) - F.lit(g.mean)) / F.lit(g.std or 1.0)
        new[g.column] = F.round(value, digits)
    return df.withColumns(new) if new else df


def fitted_params(df: DataFrame, fitted: list[Gaussian]) -> DataFrame:
    rows = [(g.column, g.method, None if g.lam is None else round(g.lam, 4)) for g in fitted]
    return df.sparkSession.createDataFrame(rows, "column_name string, method string, lambda double")


def box_cox(df: DataFrame, col: str) -> DataFrame:
    """Box-Cox with the fitted exponent; not standardised."""
    _checked_minimum(df, col, lambda v: v > 0, "Box-Cox needs strictly positive values.")
    return apply_gaussian(df, fit_gaussian(df, [col], "box-cox", standardise=False))


def yeo_johnson(df: DataFrame, col: str) -> DataFrame:
    return apply_gaussian(df, fit_gaussian(df, [col], "yeo-johnson"))


def quantile_to_normal(df: DataFrame, col: str) -> DataFrame:
    """Ranks mapped onto a bell curve through up to 1,000 quantiles."""
    return apply_gaussian(df, fit_gaussian(df, [col], "quantile"))


def map_to_gaussian(df: DataFrame, cols: list[str], method: str = "yeo-johnson") -> tuple[DataFrame, DataFrame]:
    """Map columns to a bell shape; also a before / after table."""
    fitted = fit_gaussian(df, cols, method)
    done = apply_gaussian(df, fitted)
    used = [g.column for g in fitted]
    if not used:
        raise ValueError("Every chosen column has two values or fewer.")
    parts = "skewness", "p_value"
    before = normality_k2(df, used).select("column_name", *[F.col(x).alias(f"{x}_before") for x in parts])
    after = normality_k2(done, used).select("column_name", *[F.col(x).alias(f"{x}_after") for x in parts])
    return done, before.join(after, "column_name").join(fitted_params(df, fitted), "column_name")


# ------------------------------------------------------------------ splits and components
def train_test_split(df: DataFrame, keys: list[str], test: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A split by a hash of the key: stable, and needs no shuffle."""
    place = F.pmod(F.xxhash64(F.lit(seed), *[c(k) for k in keys]), F.lit(1_000_000)) / 1_000_000
    return df.where(place >= test), df.where(place < test)


def standardised_vector(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    df = VectorAssembler(inputCols=cols, outputCol="_raw").transform(df)
    scaler = StandardScaler(inputCol="_raw", outputCol=out, withMean=True, withStd=True)
    return scaler.fit(df).transform(df).drop("_raw")


def pca(df: DataFrame, cols: list[str], k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Explained variance, loadings and scores of the standardised columns."""
    spark = df.sparkSession
    k = min(k, len(cols))
    flat = df.withColumns({x: number(df, x) for x in cols}).dropna(subset=cols)
    ready = standardised_vector(flat, cols)
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(ready)
    share, parts = model.explainedVariance.toArray(), model.pc.toArray()
    signs = [1.0 if parts[abs(parts[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    run, rows = 0.0, []
    for j in range(k):
        run += share[j]
        rows.append((f"PC{j + 1}", round(float(share[j]) * 100, 2), round(float(run) * 100, 2)))
    variance = spark.createDataFrame(rows, "component string, explained_pct double, cumulative_pct double")
    loadings = spark.createDataFrame(
        [(x, f"PC{j + 1}", round(float(parts[i, j] * signs[j]), 3)) for i, x in enumerate(cols) for j in range(k)],
        "column_name string, component string, loading double",
    )
    values = vector_to_array(F.col("scores"))
    scores = model.transform(ready).select(
        *[c(x) for x in df.columns], *[(F.get(values, F.lit(j)) * signs[j]).alias(f"PC{j + 1}") for j in range(k)]
    )
    return variance, loadings, scores


