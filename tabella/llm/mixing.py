"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are dealt into blocks. Picture all sources being read at once, each at its share of the weights of
those that still have documents: block j of a source is then read between two times that follow exactly from the weights.
Their floor is the block's release, their ceiling its deadline; every slot runs the released block with the earliest deadline.
Each slot's worth of that reading goes to blocks whose windows hold the slot, so all deadlines are met, and after any number of
slots each source has had its share to within less than one block. Weights are used as they are given, as exact fractions.

The driver holds a few numbers a source and goes through the blocks once, a stretch of slots at a time; names, rows and the
schedule stay in tables.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabella.llm.common import pick, ranked, saved, spare
from tabella.session import new_path

#: Slots of the schedule that the driver holds at a time.
STRETCH = 1_000_000


@dataclass(frozen=True)
class Phase:
    """``slots`` slots from ``start`` on run ``counts[s]`` blocks of source s from ``first[s]`` on, in the order of ``pattern``."""

    start: int
    slots: int
    first: dict[str, int]
    counts: dict[str, int]
    pattern: list[str]


def slots(blocks: Sequence[int], weights: Sequence[float]) -> Iterator[tuple[int, int]]:
    """(source, block) of each slot, sources by their place in ``blocks``, until all blocks have had theirs."""
    exact = [Fraction(w) for w in weights]
    whole = math.lcm(*(w.denominator for w in exact))
    parts = [int(w * whole) for w in exact]
    # In virtual time v, source s has read min(parts[s] * v, blocks[s]): it runs out at blocks[s] / parts[s].
    out: dict[Fraction, tuple[int, int]] = {}
    for n, w in zip(blocks, parts):
        was = out.get(Fraction(n, w), (0, 0))
        out[Fraction(n, w)] = was[0] + n, was[1] + w
    ends = sorted(out)
    near = [float(v) for v in ends]
    gone = list(accumulate((out[v][0] for v in ends), initial=0))
    rate = list(accumulate((-out[v][1] for v in ends), initial=sum(parts)))

    def read(j: int, w: int) -> tuple[int, int]:
        """All blocks read by the time that the first ``j`` of a source of weight ``w`` are: whole ones, and whether there is a rest."""
        i = bisect_right(near, j / w)
        while i < len(ends) and ends[i].numerator * w <= j * ends[i].denominator:
            i += 1
        while i and ends[i - 1].numerator * w > j * ends[i - 1].denominator:
            i -= 1
        n, rest = divmod(rate[i] * j, w)
        return gone[i] + n, rest > 0

    def due(j: int, w: int) -> int:
        return sum(read(j + 1, w))

    ready = [(due(0, w), -w, s, 0) for s, (n, w) in enumerate(zip(blocks, parts)) if n]
    waiting: list[tuple[int, int, int]] = []
    heapq.heapify(ready)
    for slot in range(sum(blocks)):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(j, parts[s]), -parts[s], s, j))
        last, _, s, j = heapq.heappop(ready)
        if slot >= last:
            raise AssertionError("a block missed its deadline")
        yield s, j
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (read(j + 1, parts[s])[0], s, j + 1))


def whole_parts(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Weights as whole parts of the period by largest remainder, one part at least."""
    total = sum(weights.values())
    exact = {s: w * period / total for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (parts[s] - exact[s], s))
    for i in range(period - sum(parts.values())):
        parts[order[i % len(order)]] += 1
    while sum(parts.values()) > period:
        big = max(parts, key=lambda s: (parts[s], s))
        parts[big] -= 1
    return parts


def pfair(parts: Mapping[str, int]) -> list[str]:
    """One period: the source of each slot, earliest deadline first among released blocks.

    Ties in the deadline go to the block whose window overlaps the next one's, then to the heavier source, then by name.
    """
    period = sum(parts.values())
    waiting = [(0, s, 0) for s in sorted(parts)]
    ready: list[tuple] = []
    out = []
    heapq.heapify(waiting)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            due = -(-(j + 1) * period // parts[s])
            overlaps = (j + 1) * period % parts[s] != 0
            heapq.heappush(ready, (due, not overlaps, -parts[s], s, j))
        due, _, _, s, j = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a block missed its deadline")
        out.append(s)
        if j + 1 < parts[s]:
            heapq.heappush(waiting, ((j + 1) * period // parts[s], s, j + 1))
    return out


def plan(blocks: Mapping[str, int], weights: Mapping[str, float], period: int) -> list[Phase]:
    """Phases until every source's blocks have had their slot; at most one phase a source, and a rest of single periods.

    A schedule that repeats, for weights that are whole parts of a short period; ``mix`` takes exact weights from ``slots``.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    start, phases = 0, []
    while left:
        size = max(period, len(left))
        parts = whole_parts({s: weights[s] for s in left}, size)
        pattern = pfair(parts)
        whole = min(left[s] // parts[s] for s in left)
        used = {s: whole * parts[s] for s in left}
        slots = whole * size
        seen = dict.fromkeys(left, 0)
        for s in pattern:  # the part of a period up to the slot whose source has no block left
            if seen[s] + used[s] == left[s]:
                break
            seen[s] += 1
            slots += 1
        counts = {s: used[s] + seen[s] for s in left}
        phases.append(Phase(start, slots, {s: done[s] for s in left}, counts, pattern))
        for s, n in counts.items():
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        start += slots
    return phases


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = 100, period: int = 1_000, id: str = "doc_id", source: str = "source", smooth: float = 0.5) -> DataFrame:
    """``id``, ``source``, ``block``, ``slot``, ``position`` of every row: the order in which the mixture is read.

    ``weights`` gives each source's target; a source it doesn't name gets none of its own and follows after all others have
    run out. Without ``weights`` a source weighs its number of rows to the power ``smooth``. Weights must be positive.
    Each row has exactly one position; none is dropped or repeated. Positions go by slot and, in a slot, through its block; a
    source's last block may leave positions free. Within a source rows come in an order fixed by a hash of the id (rows with
    equal ids in any order). A null source is a source of its own, named ``""`` as an empty one is.
    Sources may be any in number. Weights aren't rounded, so ``period`` has no effect; it stays for callers that give it.
    """
    if weights is not None and not all(0 < w < math.inf for w in weights.values()):
        raise ValueError("Target weights must be positive.")
    spark = docs.sparkSession
    rows = pick(docs, id=id, source=source).withColumn("source", F.coalesce("source", F.lit("")))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("n", F.lit(float(smooth))))
    else:
        told = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "named string, weight double")
        sizes = sizes.join(told, F.col("source") == F.col("named"), "left").drop("named")
    sizes = saved(ranked(saved(sizes, "mix-sizes"), [], ["source"], "of"), "mix-sources")
    numbers = sizes.select("of", F.ceil(F.col("n") / block).cast("long").alias("blocks"), "weight").toArrow().sort_by("of").to_pydict()
    path, start = new_path(spark, "mix-schedule"), 0
    spark.createDataFrame([], "of long, block long, slot long").write.parquet(path)
    for named in (True, False):
        here = [i for i, w in enumerate(numbers["weight"]) if (w is not None) == named]
        blocks = [numbers["blocks"][i] for i in here]
        turns = slots(blocks, [numbers["weight"][i] if named else numbers["blocks"][i] for i in here])
        while stretch := list(islice(turns, STRETCH)):
            table = pa.table({"of": pa.array([numbers["of"][here[s]] for s, _ in stretch], pa.int64()), "block": pa.array([j for _, j in stretch], pa.int64()), "slot": pa.array(range(start, start + len(stretch)), pa.int64())})
            spark.createDataFrame(table).write.mode("append").parquet(path)
            start += len(stretch)
    schedule = spark.read.schema("of long, block long, slot long").parquet(path)
    schedule = schedule.join(sizes.select("of", "source"), "of").select(F.col("source").alias("_source"), F.col("block").alias("_block"), "slot")
    placed = ranked(rows.withColumn("_mix", F.xxhash64("id")), ["source"], ["_mix", "id"], "rank")
    placed = placed.select("id", "source", "rank", F.floor(F.col("rank") / block).cast("long").alias("block"))
    out = placed.join(schedule, (F.col("source") == F.col("_source")) & (F.col("block") == F.col("_block")))
    return out.select("id", "source", "block", "slot", (F.col("slot") * block + F.col("rank") % block).cast("long").alias("position"))


def in_mixed_order(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = 100, id: str = "doc_id", source: str = "source") -> DataFrame:
    """Whole rows, each once, cut into files by position and sorted within them: reading the files by name reads the mixture.

    Rows that repeat an id stand together at the first of its positions; rows with a null id come first.
    """
    places = saved(mix(docs, weights, block, id=id, source=source).groupBy(F.col("id").alias("_mix_id")).agg(F.min("position").alias("_mix_at")), "mix-places")
    at = spare(docs, "_mix_position")
    joined = docs.join(places, F.col(id) == F.col("_mix_id"), "left")
    joined = joined.withColumn(at, F.coalesce("_mix_at", F.lit(-1))).drop("_mix_id", "_mix_at")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return joined.repartitionByRange(parts, at, id).sortWithinPartitions(at, id).drop(at)


def with_reading_order(docs: DataFrame, out: str) -> DataFrame:
    """``docs`` with each row's place, from 0 on, if its files are read by name.

    Anything but a plain read of files is written first, in the order of its partitions: files that it was made from may have another.
    """
    name, row = spare(docs, "_file"), spare(docs, "_row_index")
    told = lambda df: df.select("*", F.col("_metadata.file_name").alias(name), F.col("_metadata.row_index").alias(row))
    rows = told(docs if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" else saved(docs, "reading-order"))
    files = rows.groupBy(name).agg((F.max(row) + 1).alias("_n"))
    number = F.regexp_extract(name, r"^part-(\d+)", 1)
    before = Window.orderBy(F.length(number), number, name).rowsBetween(Window.unboundedPreceding, -1)
    starts = saved(files.select(F.col(name).alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "reading-starts")
    return rows.join(starts, F.col(name) == F.col("_of")).withColumn(out, F.col("_start") + F.col(row)).drop(name, row, "_of", "_start")
