"""Helpers shared by the operators of this folder: stages, ranks, text as byte arrays, sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabella.session import new_path

CHUNK_BYTES = 2 << 20
RANK_ROWS = 10_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_FOLD = np.uint64(0xD1B54A32D192ED03)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a stage below the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a stage that ``saved`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns an operator reads, under the names it uses; other columns can't clash with its own."""
    return df.select(*[df[old].alias(new) for new, old in names.items()])


def spare(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_fold(key: Column, parts: int) -> Column:
    """crc32 of the value as text, modulo ``parts``."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def ranked(df: DataFrame, key: list[str], order: list[str], out: str, rows: int = RANK_ROWS, by: Column | None = None) -> DataFrame:
    """Positions from 0 within each key, spread over tasks even if one key holds most rows.

    Every key is dealt over slices by a hash of its order columns; a slice is numbered by itself and starts
    where the slices before it end. Rows equal in all order columns get positions in any order.
    With ``by``, a number that never falls along the order, slices are its values and positions follow the order.
    """
    cut = spare(df, "_slice")
    if by is None:
        slices = max(1, math.ceil(df.count() / rows))
        by = F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int") if slices > 1 else F.lit(0)
    df = df.withColumn(cut, by)
    sizes = df.groupBy(*key, cut).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(cut).alias("_cut"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = df.withColumn("_row", F.row_number().over(Window.partitionBy(*key, cut).orderBy(*order)) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)] + [F.col(cut) == F.col("_cut")]
    joined = inside.join(starts, on, "inner")
    return joined.withColumn(out, (F.col("_start") + F.col("_row")).cast("long")).drop("_row", "_start", "_cut", cut, *[f"_k{i}" for i in range(len(key))])


def strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column of an Arrow batch with null read as empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col, "") if col.null_count else col


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    wide = pa.types.is_large_string(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 64), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^ \\t-\\r]+`` after lower-casing A-Z, and the row of each word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[firsts] = inside[firsts]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held = np.flatnonzero(inside)
    begin = np.searchsorted(held, at)
    size = np.diff(np.append(begin, len(held)))
    rel = np.arange(len(held)) - np.repeat(begin, size)
    values = _BYTE[_LOWER[data[held]]] * _powers(int(size.max()) + 1)[rel]
    words = mixed(np.add.reduceat(values, begin) + size.astype(np.uint64) * _FOLD)
    return words, np.searchsorted(offsets, at, side="right") - 1


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``size`` words; a shorter text is one run, a text without words none."""
    words, row = word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    if len(words) >= size:
        runs = mixed(words[: len(words) - size + 1])
        for j in range(1, size):
            runs = mixed(runs * _FOLD + words[j : len(words) - size + 1 + j])
    else:
        runs = np.zeros(0, np.uint64)
    out = []
    for i in range(n):
        c = int(counts[i])
        if c >= size:
            out.append(np.unique(runs[first[i] : first[i] + c - size + 1]))
        elif c:
            h = mixed(words[first[i] : first[i] + 1])
            for j in range(1, c):
                h = mixed(h * _FOLD + words[first[i] + j : first[i] + j + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_shingles(text: str | None, size: int) -> np.ndarray:
    """The shingle hashes of one text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return shingle_hashes(raw, np.array([0, len(raw)], np.int64), size)[0]


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """``id``, ``component``: the smallest id reachable over the rows (a, b) of ``links``.

    Min labels travel along links and then jump along labels, so a chain of n links takes about log n rounds.
    Each round aggregates before it shuffles and is written to the shared folder.
    """
    both = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{label}-both")
    state = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), f"{label}-0")
    total, turn = None, 0
    while True:
        turn += 1
        heard = both.join(state.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        near = state.join(heard, "id", "left").select("id", F.least("component", "m").alias("component"))
        jump = state.select(F.col("id").alias("component"), F.col("component").alias("further"))
        state = saved(near.join(jump, "component", "left").select("id", F.least("component", "further").alias("component")), f"{label}-{turn}")
        now = state.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return state
        total = now
