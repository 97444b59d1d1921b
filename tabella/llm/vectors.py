"""Vectors in panels: what the exact and the approximate search share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabella.llm.common import pick, saved

PANEL_ROWS = 8_192
QUERY_ROWS = 1_024


def sound(df: DataFrame, id: str, vector: str) -> DataFrame:
    """``id``, ``v`` (doubles) of rows whose vector is not null or empty and has only finite components.

    Of several such rows of one id the smallest vector counts; rows without an id take no part.
    """
    rows = pick(df, id=id, v=vector).withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite).groupBy("id").agg(F.min("v").alias("v"))


def panels(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of about ``size`` vectors of one dimension each: panel number, ids, vectors. The hash of the id deals evenly."""
    of = F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(rows.count() / size)))).cast("int")
    return rows.groupBy(of.alias(name), F.size("v").alias("dim")).agg(F.collect_list(F.struct("id", "v")).alias("rows")).select(name, "dim", F.col("rows.id").alias(f"{name}_ids"), F.col("rows.v").alias(f"{name}_vs"))


def matrix(batch: pa.RecordBatch, name: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one panel."""
    ids = batch.column(batch.schema.get_field_index(f"{name}_ids"))[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
    vs = batch.column(batch.schema.get_field_index(f"{name}_vs"))[i].values
    return ids, vs.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def search(rows: DataFrame, is_query: Column | str, k: int, cell: Callable, score: str, label: str) -> DataFrame:
    """Each query's ``k`` best: ``query_id``, ``rank``, ``vec_id``, ``score``.

    A cell is one panel of queries and one of candidates of the same dimension; ``cell(query ids, vectors, candidate ids,
    vectors)`` gives its best as (query id, candidate id, score) arrays, at most k a query and ties to the smaller id. Cells
    are spread over tasks by their two numbers; what they find is merged by rank.
    """
    rows = saved(rows, label)
    asked = saved(panels(rows.filter(is_query), QUERY_ROWS, "q"), f"{label}-queries")
    there = saved(panels(rows, PANEL_ROWS, "c"), f"{label}-panels")
    grid = asked.select("q", "dim").join(there.select("c", "dim"), "dim")  # numbers only, one row a cell
    left = asked.join(grid.withColumnRenamed("dim", "_d"), "q").filter("dim = _d").select("q", "c", "dim", "q_ids", "q_vs")
    cells = left.join(there, ["c", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, c, s = cell(*matrix(batch, "q", i), *matrix(batch, "c", i))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s)], ["query_id", "vec_id", "score"])

    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = cells.select("q", "c", "q_ids", "q_vs", "c_ids", "c_vs").repartition(parts, "q", "c").mapInArrow(run, f"query_id long, vec_id long, score {score}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(q: np.ndarray, c: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best entries: highest score, then smallest id."""
    order = np.lexsort((ids[c], -s, q))
    sorted_q = q[order]
    first = np.searchsorted(sorted_q, sorted_q, side="left")
    return order[np.arange(len(order)) - first < k]
