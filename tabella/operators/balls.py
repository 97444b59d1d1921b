"""Nearest rows by metric balls: pivots, radii, and only the balls that a row's distance found so far can reach."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tabella.functions.ordering import top_rows
from tabella.session import stage

#: Rows of a ball, about; a larger one is cut into cells of this size.
BALL_ROWS = 1_000
#: Pivots at most; all of them, as points, are what tasks hold of the tree.
MOST_PIVOTS = 65_536
#: Distances held at once while a block of rows meets a cell.
BLOCK = 250_000
_SLACK = 1 + 1e-9


@dataclass
class Tree:
    """Two levels of balls. ``outer`` are the centres of the upper ones, ``centres`` of the lower; ``above`` names a lower one's upper."""

    outer: np.ndarray
    centres: np.ndarray
    above: np.ndarray

    def place(self, points: np.ndarray) -> np.ndarray:
        """The ball of every point: the nearest upper centre, then the nearest centre below it. Equal distances: the first."""
        top = _distances(points, self.outer).argmin(axis=1)
        out = np.zeros(len(points), np.int64)
        for t in np.unique(top):
            rows, below = np.flatnonzero(top == t), np.flatnonzero(self.above == t)
            out[rows] = below[_distances(points[rows], self.centres[below]).argmin(axis=1)]
        return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed one dimension after another."""
    far = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        far += (a[:, i, None] - b[None, :, i]) ** 2
    return far


def plant(points: DataFrame, cols: list[str], rows: int) -> Tree:
    """A tree over pivots drawn by a hash of the points; there are rows / ``BALL_ROWS`` of them, ``MOST_PIVOTS`` at most."""
    wanted = max(1, min(MOST_PIVOTS, math.ceil(rows / BALL_ROWS)))
    drawn = points.select(*cols).distinct().orderBy(F.xxhash64(*cols), *cols).limit(wanted).collect()
    centres = np.array([tuple(r) for r in drawn], float).reshape(-1, len(cols))
    outer = centres[: max(1, math.isqrt(len(centres)))]
    above = np.concatenate([_distances(part, outer).argmin(axis=1) for part in np.array_split(centres, max(1, len(centres) // 1024))])
    return Tree(outer, centres, above)


def placed(df: DataFrame, cols: list[str], tree: Tree) -> DataFrame:
    """``df`` with the ball of every row and its distance to the centre."""
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(tree)
    schema = T.StructType([*df.schema.fields, T.StructField("ball", T.LongType()), T.StructField("off", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            points = pdf[cols].to_numpy(float)
            ball = held.value.place(points) if len(pdf) else np.zeros(0, np.int64)
            yield pdf.assign(ball=ball, off=np.sqrt(((points - held.value.centres[ball]) ** 2).sum(axis=1)))

    return df.mapInPandas(run, schema)


def _reached(asked: DataFrame, cols: list[str], tree: Tree, sizes: pd.DataFrame) -> DataFrame:
    """(asked row, ball) for every other ball that can hold a row nearer than ``far``."""
    n = len(tree.centres)
    radius, count = np.zeros(n), np.zeros(n, np.int64)
    radius[sizes["ball"]], count[sizes["ball"]] = sizes["radius"] * _SLACK, sizes["rows"]
    # An upper ball reaches to the far side of every lower one.
    wide = np.zeros(len(tree.outer))
    apart = np.sqrt(((tree.centres - tree.outer[tree.above]) ** 2).sum(axis=1))
    np.maximum.at(wide, tree.above[count > 0], (apart + radius)[count > 0] * _SLACK)
    held = asked.sparkSession.sparkContext.broadcast((tree, radius, count, wide))
    fields = [f for f in asked.schema.fields if f.name not in ("ball", "far", "off")]
    schema = T.StructType([*fields, T.StructField("ball", T.LongType())])

    def run(batches):
        tree, radius, count, wide = held.value
        filled = count > 0
        for pdf in batches:
            points, own, far = pdf[cols].to_numpy(float), pdf["ball"].to_numpy(), pdf["far"].to_numpy(float)
            rows, balls = [], []
            for lo in range(0, len(pdf), 1024):
                some = slice(lo, lo + 1024)
                near = np.sqrt(_distances(points[some], tree.outer)) - wide <= far[some, None] * _SLACK
                for t in np.flatnonzero(near.any(axis=0)):
                    below, ask = np.flatnonzero((tree.above == t) & filled), np.flatnonzero(near[:, t]) + lo
                    hit = np.sqrt(_distances(points[ask], tree.centres[below])) - radius[below] <= far[ask, None] * _SLACK
                    hit &= own[ask, None] != below[None, :]
                    a, b = np.nonzero(hit)
                    rows.append(ask[a])
                    balls.append(below[b])
            rows = np.concatenate(rows) if rows else np.zeros(0, int)
            out = pdf.iloc[rows][[f.name for f in fields]]
            yield out.assign(ball=np.concatenate(balls) if balls else np.zeros(0, int))

    return asked.mapInPandas(run, schema)


def nearest_rows(known: DataFrame, asked: DataFrame, cols: list[str], k: int, seen: list | None = None) -> DataFrame:
    """(``_key``, ``_y``, ``far``): the ``k`` nearest rows of ``known`` (``_y``, cols) to each row of ``asked`` (``_key``, cols); exact.

    ``far`` is the squared distance; equally near rows count by the order of ``_y``. Of equal points only the first ``k`` can
    matter, so a point that many rows share costs as much as ``k``. Known rows are dealt to metric balls around pivots; an
    asked row first meets its own ball, and then every ball that reaches nearer than its k-th distance so far. With fewer
    than ``k`` rows in its own ball the bound is the far side of the nearest ball that holds ``k``. ``seen``, if given,
    receives for tests how many pairs met.
    """
    known = stage(top_rows(known, cols, [F.col("_y")], k), "balls-distinct")
    total = known.count()
    if not total:
        return asked.sparkSession.createDataFrame([], T.StructType([asked.schema["_key"], known.schema["_y"], T.StructField("far", T.DoubleType())]))
    tree = plant(known, cols, total)
    known = stage(placed(known, cols, tree), "balls-known")
    sizes = known.groupBy("ball").agg(F.count(F.lit(1)).alias("rows"), F.max("off").alias("radius")).toPandas()  # a row a pivot
    cells = known.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / BALL_ROWS).alias("cells"))
    known = stage(known.join(cells, "ball").withColumn("cell", F.pmod(F.xxhash64(*cols, "_y"), F.col("cells"))).drop("cells", "off"), "balls-cells")
    asked = stage(placed(asked, cols, tree).drop("off"), "balls-asked")
    first = stage(_meet(asked, known, cells, cols, k), "balls-first")
    found = top_rows(first, ["_key"], [F.col("far"), F.col("_y")], k).groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"))
    bound = F.when(F.col("n") >= k, F.sqrt("far")).otherwise(F.lit(math.inf))
    wide = asked.join(found, "_key", "left").withColumn("far", F.coalesce(bound, F.lit(math.inf))).drop("n")
    more = stage(_reached(_tightened(wide, cols, tree, sizes, k), cols, tree, sizes), "balls-reached")
    if seen is not None:
        held = known.groupBy("ball").agg(F.count(F.lit(1)).alias("rows"))
        seen.append(asked.select("ball").unionAll(more.select("ball")).join(held, "ball").agg(F.sum("rows")).first()[0])
    every = first.unionByName(_meet(more, known, cells, cols, k))
    return top_rows(every, ["_key"], [F.col("far"), F.col("_y")], k)


def _tightened(asked: DataFrame, cols: list[str], tree: Tree, sizes: pd.DataFrame, k: int) -> DataFrame:
    """Rows without a bound of their own get the far side of the nearest ball of ``k`` rows or more, where there is one."""
    full = sizes[sizes["rows"] >= k]
    if full.empty:
        return asked
    held = asked.sparkSession.sparkContext.broadcast((tree.centres[full["ball"].to_numpy()], full["radius"].to_numpy() * _SLACK))

    def run(batches):
        centres, radius = held.value
        for pdf in batches:
            far = pdf["far"].to_numpy(float).copy()
            for i in np.flatnonzero(np.isinf(far)):
                far[i] = (np.sqrt(_distances(pdf[cols].iloc[[i]].to_numpy(float), centres)[0]) + radius).min()
            yield pdf.assign(far=far)

    return asked.mapInPandas(run, asked.schema)


def _meet(asked: DataFrame, known: DataFrame, cells: DataFrame, cols: list[str], k: int) -> DataFrame:
    """(_key, _y, far): the k nearest rows in each cell of the ball that a row asks in; groups are bounded on both sides."""
    slices = asked.groupBy("ball").agg(F.ceil(F.count("*") / BALL_ROWS).alias("slices"))
    left = asked.select("_key", *cols, "ball").join(slices, "ball").withColumn("slice", F.pmod(F.xxhash64("_key"), F.col("slices"))).drop("slices")
    left = left.join(cells, "ball").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).drop("cells")
    right = known.join(slices, "ball").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"_key": a["_key"].iloc[:0], "_y": b["_y"].iloc[:0], "far": np.zeros(0)})
        b = b.sort_values("_y", kind="stable")
        points, answers, keys = b[cols].to_numpy(float), b["_y"].to_numpy(), a["_key"].to_numpy()
        asks, step, out = a[cols].to_numpy(float), max(1, BLOCK // len(b)), []
        for lo in range(0, len(a), step):
            far = _distances(asks[lo : lo + step], points)
            if len(b) > k:
                edge = np.partition(far, k - 1, axis=1)[:, k - 1]
                row, at = np.nonzero(far <= edge[:, None])
                order = np.lexsort((at, far[row, at], row))
                row, at = row[order], at[order]
                first = np.searchsorted(row, row, side="left")
                taken = np.arange(len(row)) - first < k
                row, at = row[taken], at[taken]
            else:
                row, at = np.divmod(np.arange(far.size), len(b))
            out.append((keys[lo + row], answers[at], far[row, at]))
        return pd.DataFrame({"_key": np.concatenate([o[0] for o in out]), "_y": np.concatenate([o[1] for o in out]), "far": np.concatenate([o[2] for o in out])})

    schema = T.StructType([asked.schema["_key"], known.schema["_y"], T.StructField("far", T.DoubleType())])
    group = ["ball", "cell", "slice"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(meet, schema)
