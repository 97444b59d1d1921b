"""Best-fit packing into sequences of several permitted lengths.

The plan is made on the histogram of piece lengths, which has at most as many rows as the longest permitted length, whatever
the size of the data. Lengths go from long to short; each piece goes into the open bin with the least room that holds it, and
where none does, a new bin of the least-cost permitted size is opened. Several opening rules are planned to the end, every bin
is cut down to the smallest permitted length that holds its contents, and the cheapest plan is kept. Every piece then finds
its bin by its length and its position among pieces of that length. Where texts have an order, these positions follow it and
bins are numbered by their first piece.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabella.llm.common import RANK_ROWS, pick, ranked, saved

LENGTHS = (512, 1024, 2048, 4096)
START_COST = 16.0


def sequence_cost(length: int) -> float:
    """What a sequence costs: its length, and a fixed start."""
    return START_COST + length


@dataclass
class Plan:
    """Runs of pieces: those of ``length`` at positions lo <= p < hi go ``each`` to a bin, from bin ``bin`` at ``offset`` on.
    Groups: bins from ``first`` on up to the next group's hold ``used`` of ``capacity``."""

    runs: list[tuple[int, int, int, int, int, int]]
    groups: list[tuple[int, int, int]]
    bins: int
    cost: float


def pack_histogram(sizes: dict[int, int], open_size: Callable[[int], int], lengths: Sequence[int], cost: Callable[[int], float]) -> Plan:
    """Best fit, longest first, on counts of equal pieces; ``open_size`` says how large a bin a piece opens."""
    rooms: list[int] = []
    opened: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, bins, used)

    def put(room: int, first: int, n: int, used: int) -> None:
        if room not in opened:
            insort(rooms, room)
            opened[room] = []
        opened[room].append((first, n, used))

    runs, bins = [], 0
    for length in sorted(sizes, reverse=True):
        at, left = 0, sizes[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n, used = opened[room].pop()
                if not opened[room]:
                    del opened[room], rooms[i]
            else:
                room = open_size(length)
                n, first, used = -(-left // (room // length)), bins, 0
                bins += n
            each = room // length
            whole = min(n, left // each)
            if whole:
                runs.append((length, at, at + whole * each, each, first, used))
                put(room - each * length, first, whole, used + each * length)
                at, left = at + whole * each, left - whole * each
            if whole < n and left:  # fewer than ``each`` pieces are left: they share one bin
                runs.append((length, at, at + left, left, first + whole, used))
                put(room - left * length, first + whole, 1, used + left * length)
                whole, at, left = whole + 1, at + left, 0
            if whole < n:
                put(room, first + whole, n - whole, used)
    groups, total = [], 0.0
    for first, n, used in sorted(g for held in opened.values() for g in held):
        capacity = lengths[bisect_left(lengths, used)]
        groups.append((first, used, capacity))
        total += n * cost(capacity)
    return Plan(runs, groups, bins, total)


def best_plan(sizes: dict[int, int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = sequence_cost) -> Plan:
    """The cheapest of the plans that open: the size with the least cost for each unit if filled with like pieces, or the
    smallest that fits of the permitted sizes from each one on."""
    lengths = sorted(lengths)

    def alike(length: int) -> int:
        fit = lengths[bisect_left(lengths, length) :]
        return min(fit, key=lambda c: (cost(c) / (c // length * length), c))

    rules = [alike] + [lambda length, low=low: max(low, lengths[bisect_left(lengths, length)]) for low in lengths]
    return min((pack_histogram(sizes, rule, lengths, cost) for rule in rules), key=lambda p: p.cost)


def _placed(plan: Plan):
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    key = runs[:, 0] << 44 | runs[:, 1]
    groups = np.array(plan.groups, np.int64).reshape(-1, 3)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for length, position in batches:
            n, p = length.to_numpy(np.int64), position.to_numpy(np.int64)
            r = runs[np.searchsorted(key, n << 44 | p, side="right") - 1]
            nth = p - r[:, 1]
            bins = r[:, 4] + nth // r[:, 3]
            g = groups[np.searchsorted(groups[:, 0], bins, side="right") - 1]
            yield pd.DataFrame({"bin": bins, "offset": r[:, 5] + nth % r[:, 3] * n, "capacity": g[:, 2], "used": g[:, 1]})

    return F.pandas_udf(run, "struct<bin: long, offset: long, capacity: long, used: long>")


def words(text: str):
    """The length of a text in words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\t-\r]+")), F.lit(0))


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = sequence_cost, id: str = "doc_id", text: str = "text", size: Callable = words, order: str | None = None) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``bin``, ``offset``, ``capacity``, ``used``: where every piece of every text lies.

    ``size`` gives a text's length (words by default; any column expression does). A text longer than the longest permitted
    length is cut into whole sequences and a rest, so nothing is lost. A text without length (null, empty) has one row of length
    0 without a bin. Equal rows are packed one by one; a null id is packed under null. ``order`` names a column with the place of
    each row, a number of its own from 0 on: of pieces of one length those of earlier rows come into earlier bins of the plan, and
    bins are numbered by the place of their earliest piece. Without it pieces of one length come in an order fixed by a hash.
    """
    if not lengths or min(lengths) < 1:
        raise ValueError("Permitted lengths must be positive.")
    most = max(lengths)
    at = ["at"] if order else []
    rows = pick(docs, id=id, text=text, **({"at": order} if order else {})).select("id", size("text").cast("long").alias("n"), *at)
    pieces = rows.select("id", "n", *at, F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / most) - 1, F.lit(0)))).alias("piece"))
    start = F.col("piece") * most
    pieces = saved(pieces.select("id", F.col("piece").cast("int").alias("piece"), start.cast("long").alias("start"), F.least(F.col("n") - start, F.lit(most)).alias("length"), *at), "pack-pieces")
    some = pieces.filter("length > 0")
    sizes = {r["length"]: r["n"] for r in some.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    empty = pieces.filter("length = 0").drop(*at).select("*", *[F.lit(None).cast("long").alias(c) for c in ("bin", "offset", "capacity", "used")])
    if not sizes:
        return empty
    plan = best_plan(sizes, lengths, cost)
    stretch = F.floor(F.col("at") / RANK_ROWS) if order else None
    placed = ranked(some, ["length"], ["at", "piece"] if order else ["id", "piece"], "position", by=stretch).withColumn("to", _placed(plan)("length", "position"))
    placed = placed.select("id", "piece", "start", "length", "to.bin", "to.offset", "to.capacity", "to.used", *at)
    if order:
        placed = saved(placed, "pack-places")
        first = placed.groupBy("bin").agg(F.min(F.struct("at", "piece")).alias("first")).select(F.col("bin").alias("_bin"), "first.at", "first.piece")
        numbers = ranked(first, [], ["at", "piece"], "number", by=stretch).select("_bin", "number")
        placed = placed.join(numbers, F.col("bin") == F.col("_bin")).withColumn("bin", F.col("number")).select(*empty.columns)
    return placed.unionByName(empty)
