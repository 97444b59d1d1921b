"""Centroid clustering on integers, with every vector's exact dot products kept from round to round.

A vector's squared distance to centroid j is |v|^2 - 2 v.c_j + |c_j|^2. The products v.c_j are stored beside the vector; when
centroids move, only the components that changed are multiplied by their change and added, and the nearest centroid is read
off anew. All arithmetic is on integers and exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabella.llm.common import forget, pick, saved

K, DIM, SCALE, ROUNDS, SEED = 40, 64, 256, 5, "2"
#: Largest integer component; four times its square, summed over 64 components, still fits a long.
LARGEST = 1 << 27
_EXACT_FLOAT = 1 << 53


def grid(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def integers(df: DataFrame, id: str, vector: str, dim: int, scale: int) -> DataFrame:
    """``id``, ``v`` (ints) of the rows whose vector has ``dim`` components, none null or not finite. Repeated rows all count."""
    rows = pick(df, id=id, v=vector)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") == dim)).filter(finite).withColumn("v", grid(F.col("v"), scale))
    wide = F.exists("v", lambda x: F.abs(x) > LARGEST)
    checked = F.when(wide, F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling: its distances don't fit a long"))).otherwise(F.col("v"))
    return rows.select("id", checked.cast("array<int>").alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``, in that order; rows without an id come last, equal ids by vector."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = rows.select("v", told.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in chosen], np.int64)


def _column(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))


def add_changes(dots: np.ndarray, v: np.ndarray, change: np.ndarray) -> None:
    """``dots`` += v . change, by the components that changed and no others. Products that fit a double exactly use one."""
    bound = int(np.abs(v).max(initial=0)) * int(np.abs(change).max(initial=0)) * v.shape[1]
    kind = np.float64 if bound < _EXACT_FLOAT else np.int64
    columns = v.astype(kind, order="F")
    for j, moved in enumerate(change):
        at = np.flatnonzero(moved)
        if len(at):
            dots[:, j] += (columns[:, at] @ moved[at].astype(kind)).astype(np.int64)


def _advance(centroids: np.ndarray, change: np.ndarray, first: bool):
    """Rows with their products brought up to date, the nearest centroid (ties: smallest number) and its squared distance."""
    lengths = (centroids * centroids).sum(axis=1)
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _column(batch, "v", dim)
            dots = np.zeros((len(v), k), np.int64) if first else _column(batch, "dots", k).copy()
            add_changes(dots, v, change)
            far = lengths - 2 * dots
            cluster = far.argmin(axis=1)
            distance = far[np.arange(len(v)), cluster] + (v * v).sum(axis=1)
            ids = batch.column(batch.schema.get_field_index("id"))
            columns = [ids, _lists(v, pa.int32()), _lists(dots, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "dots", "cluster", "distance"])

    return run


def _sums(k: int, dim: int):
    """One row per cluster, task and a few batches: how many vectors, and their sums by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            if batch.num_rows:
                cluster = batch.column(batch.schema.get_field_index("cluster")).to_numpy()
                v = _column(batch, "v", dim)
                order = np.argsort(cluster, kind="stable")
                held, at = np.unique(cluster[order], return_index=True)
                total[held] += np.add.reduceat(v[order], at)
                count += np.bincount(cluster, minlength=k)
        held = np.flatnonzero(count)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(count[held]), _lists(total[held], pa.int64())], ["cluster", "n", "total"])

    return run


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid at floor(sum / count) of its vectors; one without vectors stays. k x dim sums come to the driver, no rows."""
    k, dim = centroids.shape
    parts = state.select("cluster", "v").mapInArrow(_sums(k, dim), "cluster int, n long, total array<long>")
    wide = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dim)]
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dim)]
    return out


def cluster(df: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = K, dim: int = DIM, scale: int = SCALE, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """``id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of every kept vector.

    Kept are vectors of ``dim`` components without null, NaN or infinity; others, null vectors and empty ones have no row.
    Repeated rows count each and have a row each. A row without an id takes part, but starts no centroid unless fewer than
    ``k`` rows have one. With fewer kept vectors than ``k`` there are so many centroids; without any the result is empty.
    Equal distances go to the smaller number. Components beyond ``LARGEST`` after scaling raise an error, as their distances
    would not fit a long. Other columns are not read, whatever their names.

    Each round reads and writes one table of (id, vector, products, cluster); the table before it is deleted.
    """
    rows = integers(df, id, vector, dim, scale)
    centroids = first_centroids(rows, k, seed)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, v array<int>, dots array<long>, cluster int, distance long"
    if not len(centroids):
        empty = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return df.sparkSession.createDataFrame([], f"id {rows.schema['id'].dataType.simpleString()}, {empty}")
    before, state = None, rows
    change = centroids  # from centroids at zero, so the first products are built by the same step
    for turn in range(rounds + 1):
        state = saved(state.mapInArrow(_advance(centroids, change, turn == 0), schema), f"centroids-{turn}")
        if before is not None:
            forget(before)
        before = state
        if turn < rounds:
            after = moved(state, centroids)
            centroids, change = after, after - centroids
    sums = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = {r["cluster"]: r["cluster_inertia"] for r in sums.collect()}  # k rows
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = F.array([F.struct(F.lit(inertia.get(j, 0)).cast("long").alias("inertia"), F.lit(t).alias("sha")) for j, t in enumerate(told)])
    own = by_cluster[F.col("cluster")]
    return state.select("id", "cluster", "distance", own["inertia"].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), own["sha"].alias("centroid_sha256"))
