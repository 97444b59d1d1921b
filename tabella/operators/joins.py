"""Joins on keys compared as trimmed text, and what matched."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabella.functions.scalar import all_of, as_text, c

HOW = ("left", "inner", "outer", "right")


def _keyed(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    return df.withColumns({f"_{tag}{i}": F.trim(as_text(df, k)) for i, k in enumerate(keys)})


def _check(left_on: list[str], right_on: list[str], how: str) -> None:
    if len(left_on) != len(right_on) or not left_on:
        raise ValueError("Give the same number of key columns on both sides.")
    if how not in HOW:
        raise ValueError(f"Use one of {', '.join(HOW)}.")


def _equal(pairs: list[tuple[str, str]], match_missing: bool):
    return all_of([F.col(a).eqNullSafe(F.col(b)) if match_missing else F.col(a) == F.col(b) for a, b in pairs])


def join_tables(
    left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], how: str = "left", suffix: str = "_2", match_missing: bool = False
) -> DataFrame:
    """Join two tables; clashing right columns get a suffix.

    A row with a missing key is a row without a partner. ``match_missing`` pairs missing keys with each other, which gives
    all pairs of them. The strategy (broadcast or sort-merge, skew splits) is left to Spark's own sizes.
    """
    _check(left_on, right_on, how)
    l, r = _keyed(left, left_on, "l"), _keyed(right, right_on, "r")
    shared = [b for a, b in zip(left_on, right_on) if a == b]
    new = {}
    for x in right.columns:
        clash = x in left.columns and x not in shared
        new[x] = x + suffix if clash else x
    r = r.select(
        *[c(x).alias(f"_v_{x}") for x in right.columns if x not in shared],
        *[F.col(f"_r{i}") for i in range(len(right_on))],
    )
    on = _equal([(f"_l{i}", f"_r{i}") for i in range(len(left_on))], match_missing)
    both = l.join(r, on, {"outer": "full"}.get(how, how))
    out = []
    for x in left.columns:
        if x in left_on:
            i = left_on.index(x)
            same = left_on[i] == right_on[i]
            out.append((F.coalesce(F.col(f"_l{i}"), F.col(f"_r{i}")) if same else F.col(f"_l{i}")).alias(x))
        else:
            out.append(c(x))
    for x in right.columns:
        if x in shared:
            continue
        value = F.col(f"_r{right_on.index(x)}") if x in right_on else c(f"_v_{x}")
        out.append(value.alias(new[x]))
    return both.select(*out)


def join_report(
    left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], how: str = "left", match_missing: bool = False
) -> DataFrame:
    """Row counts of a join without building it: each side is counted per key first."""
    _check(left_on, right_on, how)
    cols = [f"k{i}" for i in range(len(left_on))]
    l = left.select(*[F.trim(as_text(left, k)).alias(x) for k, x in zip(left_on, cols)]).groupBy(*cols).agg(F.count("*").alias("l"))
    r = right.select(*[F.trim(as_text(right, k)).alias("r" + x) for k, x in zip(right_on, cols)])
    r = r.groupBy(*["r" + x for x in cols]).agg(F.count("*").alias("r"))
    both = l.join(r, _equal([(x, "r" + x) for x in cols], match_missing), "full")
    zero = lambda x: F.coalesce(x, F.lit(0))
    matched = zero(F.sum(F.col("l") * F.col("r")))
    left_only = zero(F.sum(F.when(F.col("r").isNull(), F.col("l")))) if how in ("left", "outer") else F.lit(0)
    right_only = zero(F.sum(F.when(F.col("l").isNull(), F.col("r")))) if how in ("right", "outer") else F.lit(0)
    return both.agg(
        zero(F.sum("l")).alias("left_rows"),
        zero(F.sum("r")).alias("right_rows"),
        (matched + left_only + right_only).cast("long").alias("result_rows"),
        matched.cast("long").alias("matched"),
        left_only.cast("long").alias("left_only"),
        right_only.cast("long").alias("right_only"),
        zero(F.sum(F.col("r") - 1)).alias("duplicate_right_keys"),
    )
