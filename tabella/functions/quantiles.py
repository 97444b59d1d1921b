"""Exact quantiles with linear interpolation, at any size.

``percentile`` keeps every distinct value of a group in one buffer. That is used
only when the counted rows fit one task; otherwise the order statistics are found by
narrowing (whole columns) or by counting value ranges (per group).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabella.functions.ordering import RANGE, order_ranges
from tabella.functions.scalar import c, join_keys, q
from tabella.session import few_rows, sized, split_count

BRACKET_ROWS = 1_000_000
ACCURACY = 10_000


@dataclass
class _Target:
    """One order statistic of one column, and the interval known to hold it."""

    col: str
    rank: int
    low: float = -math.inf
    high: float = math.inf
    below: int = 0
    inside: int = 0
    value: float | None = None


def column_quantiles(
    df: DataFrame, wanted: dict[str, list[float]], exact_rows: int = BRACKET_ROWS, small: bool | None = None
) -> dict[str, list[float | None]]:
    """Exact quantiles of several numeric columns, one fused aggregate per pass."""
    if not wanted:
        return {}
    names = list(wanted)
    df = df.select(*[c(n).cast("double").alias(n) for n in names])
    small = few_rows(df) if small is None else small
    if small:
        row = df.agg(*[F.percentile(c(n), wanted[n]).alias(f"q{i}") for i, n in enumerate(names)]).first()
        return {n: list(row[i]) if row[i] is not None else [None] * len(wanted[n]) for i, n in enumerate(names)}
    counts = df.agg(*[F.count(c(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
    total = {n: counts[i] for i, n in enumerate(names)}
    targets: dict[tuple[str, int], _Target] = {}
    for n in names:
        for p in wanted[n]:
            if total[n]:
                spot = (total[n] - 1) * p
                for rank in {math.floor(spot), math.ceil(spot)}:
                    targets[n, rank] = _Target(n, rank, inside=total[n])
    _narrow(df, list(targets.values()), exact_rows)
    out: dict[str, list[float | None]] = {}
    for n in names:
        out[n] = []
        for p in wanted[n]:
            if not total[n]:
                out[n].append(None)
                continue
            spot = (total[n] - 1) * p
            lo, hi = targets[n, math.floor(spot)].value, targets[n, math.ceil(spot)].value
            out[n].append(lo + (hi - lo) * (spot - math.floor(spot)))
    return out


def _inside(t: _Target) -> Column:
    return c(t.col).between(t.low, t.high)


def _narrow(df: DataFrame, targets: list[_Target], exact_rows: int) -> None:
    """Shrink every interval until its rows are few enough to sort, then pick."""
    while True:
        wide = [t for t in targets if t.value is None and t.inside > exact_rows]
        if not wide:
            break
        probes = []
        for i, t in enumerate(wide):
            here = (t.rank - t.below) / max(1, t.inside - 1)
            slack = 2 / ACCURACY
            probes.append(
                F.percentile_approx(
                    F.when(_inside(t), c(t.col)), [max(0.0, here - slack), min(1.0, here + slack)], ACCURACY
                ).alias(f"b{i}")
            )
        brackets = df.agg(*probes).first()
        checks = []
        for i, t in enumerate(wide):
            low, high = brackets[i]
            checks += [
                F.count_if(c(t.col) < low).alias(f"l{i}"),
                F.count_if(c(t.col).between(low, high)).alias(f"m{i}"),
            ]
        counted = df.agg(*checks).first()
        for i, t in enumerate(wide):
            low, high = brackets[i]
            below, inside = counted[2 * i], counted[2 * i + 1]
            if below <= t.rank < below + inside:
                if low == high:
                    t.value = low
                elif inside == t.inside:
                    # No progress: few distinct values left, each very common.
                    _pick_by_value(df, t)
                t.low, t.high, t.below, t.inside = low, high, below, inside
            elif t.rank < below:
                t.high, t.inside = math.nextafter(low, -math.inf), below - t.below
            else:
                t.low, t.inside, t.below = math.nextafter(high, math.inf), t.below + t.inside - below - inside, below + inside
    rest = [t for t in targets if t.value is None]
    if rest:
        row = df.agg(
            *[
                F.percentile(F.when(_inside(t), c(t.col)), (t.rank - t.below) / max(1, t.inside - 1)).alias(f"v{i}")
                for i, t in enumerate(rest)
            ]
        ).first()
        for i, t in enumerate(rest):
            t.value = row[i]


def _pick_by_value(df: DataFrame, t: _Target) -> None:
    per_value = df.where(_inside(t)).groupBy(c(t.col).alias("v")).agg(F.count("*").alias("n"))
    per_value, _ = order_ranges(per_value, [F.col("v")])
    seen = t.below
    for row in per_value.groupBy(RANGE).agg(F.sum("n").alias("n")).orderBy(RANGE).collect():
        if t.rank < seen + row["n"]:
            inside = per_value.where(F.col(RANGE) == row[RANGE])
            run = Window.partitionBy(RANGE).orderBy("v")
            t.value = (
                inside.withColumn("u", F.sum("n").over(run) + F.lit(seen)).where(F.col("u") > t.rank).agg(F.min("v")).first()[0]
            )
            return
        seen += row["n"]


def group_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], parts: int | None = None
) -> DataFrame:
    """Exact quantiles per group: one row per group, one column per name in ``probs``.

    Large tables are collapsed to (group, value, count) first, then counted per
    value range; only the ranges that hold a wanted order statistic are sorted.
    """
    parts = parts or split_count(df)
    names = list(probs)
    if parts <= 1:
        return df.groupBy(*[c(k) for k in keys]).agg(
            *[F.expr(f"percentile({q(value)}, {probs[n]!r}D)").alias(n) for n in names]
        )
    picks = []
    for i, n in enumerate(names):
        mine = F.col("_w.i") == i
        low = F.max(F.when(mine & (F.col("_w.side") == 0), F.col("_v")))
        high = F.max(F.when(mine & (F.col("_w.side") == 1), F.col("_v")))
        frac = F.max(F.when(mine, F.col("_w.frac")))
        picks.append((low + (high - low) * frac).alias(n))
    ranked = _order_statistics(df, keys, value, [probs[n] for n in names], parts)
    found = ranked.groupBy(*[c(k) for k in keys]).agg(*picks)
    # Groups whose values are all missing still get a row.
    found = join_keys(df.select(*[c(k) for k in keys]).distinct(), found, keys) if keys else found
    return sized(found, "quantiles", parts)


def many_quantiles(df: DataFrame, col: str, probs: list[float], parts: int | None = None) -> list[float]:
    """A long list of exact quantiles of one column."""
    parts = parts or split_count(df)
    if parts <= 1:
        return list(df.agg(F.percentile(c(col).cast("double"), probs)).first()[0] or [])
    rows = _order_statistics(df, [], col, probs, parts).select("_w.*", "_v").collect()
    ends = {(r["i"], r["side"]): (r["_v"], r["frac"]) for r in rows}
    out = []
    for i in range(len(probs)):
        (low, frac), (high, _) = ends[i, 0], ends[i, 1]
        out.append(low + (high - low) * frac)
    return out


def _order_statistics(df: DataFrame, keys: list[str], value: str, probs: list[float], parts: int) -> DataFrame:
    """Rows (keys, _v, _w = wanted order statistic): two per probability and group."""
    counted = (
        df.where(c(value).isNotNull())
        .groupBy(*[c(k) for k in keys], c(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    counted, _ = order_ranges(counted, [F.col("_v")], parts)
    cols = [*keys, RANGE]
    sizes = counted.groupBy(*[c(k) for k in cols]).agg(F.sum("_n").alias("_size"))
    by_key = Window.partitionBy(*[c(k) for k in keys])
    before = by_key.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn(
        "_total", F.sum("_size").over(by_key)
    )
    # One entry per wanted order statistic: its rank, and which quantile it serves.
    index = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    spot = lambda x: (F.col("_total") - 1) * x.getField("p")
    entry = lambda x, side, at: F.struct(
        x.getField("i").alias("i"), at(spot(x)).cast("long").alias("rank"), (spot(x) - F.floor(spot(x))).alias("frac"), F.lit(side).alias("side")
    )
    wanted = F.concat(F.transform(index, lambda x: entry(x, 0, F.floor)), F.transform(index, lambda x: entry(x, 1, F.ceil)))
    here = lambda w: (w.getField("rank") >= F.col("_offset")) & (w.getField("rank") < F.col("_offset") + F.col("_size"))
    hits = sizes.withColumn("_ws", F.filter(wanted, here)).where(F.size("_ws") > 0).select(*[c(k) for k in cols], "_offset", "_ws")
    hits = sized(hits, "order-statistics", parts)
    run = Window.partitionBy(*[c(k) for k in cols]).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_keys(counted, hits, cols, "inner")
        .withColumn("_upto", F.sum("_n").over(run) + F.col("_offset"))
        .withColumn("_w", F.explode("_ws"))
        .where((F.col("_w.rank") < F.col("_upto")) & (F.col("_w.rank") >= F.col("_upto") - F.col("_n")))
    )


def rank_average(df: DataFrame, value: str, out: str, parts: int | None = None) -> DataFrame:
    """One row per distinct value with its count and tie-averaged 1-based rank."""
    from tabella.functions.ordering import add_running

    counted = df.where(c(value).isNotNull()).groupBy(c(value).alias(value)).agg(F.count("*").alias("_n"))
    parts = parts or split_count(df)
    counted = add_running(counted, [], value, None, F.col("_n"), "_upto", parts)
    return counted.select(c(value), F.col("_n"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
