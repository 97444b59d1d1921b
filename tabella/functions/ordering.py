"""Positions, running state and neighbours over data too large for one sort task.

A plain window puts a whole group into one task. Here a table is first cut into
ranges of the ordered values themselves (order column, then tie column) by a
range partitioning, so a window only ever sorts (group, range); what crosses a
range is a small table with one row per (group, range). A value so common that
it would fill whole ranges is cut by the tie column, which tells its rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabella.functions.scalar import c, join_keys
from tabella.session import sized, split_count, stage

RANGE = "_range"
CHUNK_ROWS = 200_000


def order_ranges(df: DataFrame, sort: list[Column], parts: int | None = None) -> tuple[DataFrame, bool]:
    """Add a range number that grows along ``sort``. Returns (df, was it cut).

    Rows equal in all sort columns share a range. The cut table is written once:
    the numbers belong to one partitioning and must not be drawn again.
    """
    parts = parts or split_count(df)
    if parts <= 1:
        return df.withColumn(RANGE, F.lit(0)), False
    return stage(df.repartitionByRange(parts, *sort).withColumn(RANGE, F.spark_partition_id()), "ranges"), True


def add_running(
    df: DataFrame, keys: list[str], order: str, tie: str | None, amount: Column, out: str, parts: int | None = None
) -> DataFrame:
    """Running sum of ``amount`` inside each group, in (order, tie) order."""
    sort = [c(order)] + ([c(tie)] if tie else [])
    df, cut = order_ranges(df.withColumn("_amount", amount), sort, parts)
    groups = [c(k) for k in keys] + [F.col(RANGE)]
    here = Window.partitionBy(*groups).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(out, F.sum("_amount").over(here))
    if cut:
        cols = [*keys, RANGE]
        sizes = df.groupBy(*[c(k) for k in cols]).agg(F.sum("_amount").alias("_size"))
        before = (
            Window.partitionBy(*[c(k) for k in keys])
            .orderBy(RANGE)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
        offsets = sized(offsets, "offsets", 2)
        df = join_keys(df, offsets, cols).withColumn(out, F.col(out) + F.col("_offset")).drop("_offset")
    return df.drop("_amount", RANGE)


def add_position(
    df: DataFrame, keys: list[str], order: str, tie: str | None, out: str = "_pos", parts: int | None = None
) -> DataFrame:
    """1-based row position inside each group, in (order, tie) order."""
    return add_running(df, keys, order, tie, F.lit(1).cast("long"), out, parts)


def neighbourhoods(
    df: DataFrame,
    keys: list[str],
    order: str,
    tie: str | None,
    before: int,
    after: int,
    parts: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Prepare windows that look at most ``before`` / ``after`` rows away.

    Adds ``_pos``, ``_chunk`` and ``_own``. Windows over (keys, _chunk) ordered
    by ``_pos`` see every neighbour they need; keep the ``_own`` rows afterwards.
    A long group is cut into equal chunks and only the rows at a chunk's edge are
    copied to the next one.
    """
    parts = parts or split_count(df)
    df = add_position(df, keys, order, tie, "_pos", parts)
    if parts <= 1:
        return df.withColumn("_chunk", F.lit(0).cast("long")).withColumn("_own", F.lit(True))
    chunk_rows = max(chunk_rows, before, after)
    home = F.floor((F.col("_pos") - 1) / chunk_rows).cast("long")
    offset = (F.col("_pos") - 1) % chunk_rows
    copies = F.array_compact(
        F.array(
            home,
            F.when(offset >= chunk_rows - before, home + 1),
            F.when((offset < after) & (home > 0), home - 1),
        )
    )
    return (
        df.withColumn("_home", home)
        .withColumn("_chunk", F.explode(copies))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )


def carry(
    df: DataFrame, cols: list[str], order: str, tie: str | None, keys: list[str] | None = None, parts: int | None = None,
    backward: bool = False,
) -> DataFrame:
    """Fill gaps with the last known value before (or the next one after) a row."""
    keys = keys or []
    way = (lambda x: x.desc_nulls_last()) if backward else (lambda x: x.asc_nulls_last())
    sort = [way(c(order))] + ([way(c(tie))] if tie else [])
    df, cut = order_ranges(df, sort, parts)
    in_order = Window.partitionBy(*[c(k) for k in keys], F.col(RANGE)).orderBy(*sort)
    here = in_order.rowsBetween(Window.unboundedPreceding, 0)
    for name in cols:
        df = df.withColumn(f"_f_{name}", F.last(c(name), ignorenulls=True).over(here))
    if cut:
        # One row per (group, range): the value a later range inherits.
        df = df.withColumn("_nth", F.row_number().over(in_order))
        edge_cols = [*keys, RANGE]
        edge = df.groupBy(*[c(k) for k in edge_cols]).agg(
            *[F.max_by(c(n), F.when(c(n).isNotNull(), F.col("_nth"))).alias(f"_e_{n}") for n in cols]
        )
        past = Window.partitionBy(*[c(k) for k in keys]).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        edge = edge.select(
            *[c(k) for k in edge_cols],
            *[F.last(F.col(f"_e_{n}"), ignorenulls=True).over(past).alias(f"_i_{n}") for n in cols],
        )
        df = join_keys(df, edge, edge_cols)
        for n in cols:
            df = df.withColumn(f"_f_{n}", F.coalesce(F.col(f"_f_{n}"), F.col(f"_i_{n}")))
        df = df.drop("_nth", *[f"_i_{n}" for n in cols])
    for n in cols:
        df = df.withColumn(n, F.col(f"_f_{n}"))
    return df.drop(RANGE, *[f"_f_{n}" for n in cols])


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int | None = None) -> DataFrame:
    """The first ``n`` rows of each group; a hot group is thinned per salt first."""
    if not keys:
        return df.orderBy(*order).limit(n)
    salts = salts or 64
    groups = [c(k) for k in keys]
    salted = Window.partitionBy(*groups, F.col("_salt")).orderBy(*order)
    whole = Window.partitionBy(*groups).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(*[c(x) for x, kind in df.dtypes if "map<" not in kind]), F.lit(salts)))
        .withColumn("_rn", F.row_number().over(salted))
        .where(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(whole))
        .where(F.col("_rn") <= n)
        .drop("_salt", "_rn")
    )

