"""Records of text files whose borders depend on everything before them, cut in parallel.

A line break inside quotes ends no CSV row, and a brace inside a string closes no JSON object, so a byte range alone doesn't
tell where its records begin. Here every task reads its range piece by piece (pieces end at a line break, or at a closing
brace) and states what it would mean under either assumption: the range begins inside quotes, or outside. Those few numbers
per range are added up from the start of the file, which settles the state at the start of every range, and with it every
border. Records that are one piece pass straight through; only those of several pieces are gathered by their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabella.session import stage

_ESCAPED = re.compile(r"\\.", re.S)
_KEY = r'"((?:[^"\\]|\\.)*)"\s*:\s*(\[?)\s*$'


def _pieces(spark: SparkSession, path: str, end: str, charset: str) -> DataFrame:
    """The pieces of all files with their file, the start of their byte range and a number that grows within it."""
    text = spark.read.option("lineSep", end).text(path)
    value = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    return text.select(value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"))


def _csv_piece(text: str) -> tuple[int, int, int]:
    """(quotes, depth gained if the piece starts outside quotes, and if inside): rows have no depth."""
    return text.count('"'), 0, 0


def _json_piece(text: str) -> tuple[int, int, int]:
    """The same for a piece up to a closing brace, which counts unless it is inside a string."""
    parts = _ESCAPED.sub("", text).split('"') if "\\" in text else text.split('"')
    quotes = len(parts) - 1
    opened = [sum(p.count("{") for p in parts[i::2]) for i in (0, 1)]
    return quotes, opened[0] - (quotes % 2 == 0), opened[1] - (quotes % 2 == 1)


def _stated(pieces: DataFrame, measure) -> DataFrame:
    """``nth`` piece of its range, ``odd``: quotes so far in the range, ``deep0``, ``deep1``: depth so far if the range starts
    outside or inside quotes, and the piece's own ``quotes``, ``gain0``, ``gain1`` under the same two assumptions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, nth, odd, deep = None, 0, 0, [0, 0]
        for batch in batches:
            out = []
            for text, file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (file, start) != here:
                    here, nth, odd, deep = (file, start), 0, 0, [0, 0]
                quotes, *gain = measure(text)
                gains = gain[odd], gain[1 - odd]
                out.append((nth, odd, *deep, quotes % 2, *gains))
                nth, odd, deep = nth + 1, (odd + quotes) % 2, [deep[0] + gains[0], deep[1] + gains[1]]
            made = [pa.array(column, pa.int64()) for column in (zip(*out) if out else [[]] * 7)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    names = ["nth", "odd", "deep0", "deep1", "quotes", "gain0", "gain1"]
    return pieces.mapInArrow(run, "value string, file string, range long, at long, " + ", ".join(f"{n} long" for n in names))


def _settled(pieces: DataFrame) -> DataFrame:
    """Every piece with whether it starts ``inside`` quotes, and the ``depth`` at its start and ``after`` it."""
    ranges = pieces.groupBy("file", "range").agg(F.sum("quotes").alias("q"), F.sum("gain0").alias("g0"), F.sum("gain1").alias("g1"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = ranges.withColumn("start", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
    ranges = ranges.withColumn("base", F.coalesce(F.sum(F.when(F.col("start") == 0, F.col("g0")).otherwise(F.col("g1"))).over(before), F.lit(0)))
    joined = pieces.join(ranges.select("file", "range", "start", "base"), ["file", "range"])
    pick = lambda out: F.when(F.col("start") == 0, F.col(f"{out}0")).otherwise(F.col(f"{out}1"))
    depth = F.col("base") + pick("deep")
    return joined.select(
        "file", "range", "at", "nth", "value", ((F.col("odd") + F.col("start")) % 2).alias("inside"), "quotes", depth.alias("depth"), (depth + pick("gain")).alias("after"),
    )


def _running(pieces: DataFrame, mark: Column, out: str) -> DataFrame:
    """How many marked pieces the file has up to each piece: counted per byte range, ranges added up."""
    marked = pieces.withColumn("_mark", mark.cast("long"))
    within = Window.partitionBy("file", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("file", "range").agg(F.sum("_mark").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return marked.join(starts, ["file", "range"]).withColumn(out, F.col("_start") + F.sum("_mark").over(within)).drop("_mark", "_start")


def _gathered(several: DataFrame, starts: Column, glue: str) -> DataFrame:
    """Records of several pieces as ``file``, ``range``, ``at`` (of their first piece) and ``value``."""
    numbered = _running(several, starts, "record")
    held = F.array_sort(F.collect_list(F.struct("range", "at", "value")))
    records = numbered.groupBy("file", "record").agg(held.alias("p"))
    return records.select("file", F.col("p")[0]["range"].alias("range"), F.col("p")[0]["at"].alias("at"), F.array_join(F.col("p.value"), glue).alias("value"))


def csv_records(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """``value``, ``first``: one row per record of delimited text, line breaks inside quotes kept; ``first`` marks each file's first record.

    Empty records are left out. Quotes inside quoted cells are doubled, as in the format. A carriage return before a line
    break belongs to the break.
    """
    pieces = stage(_settled(stage(_stated(_pieces(spark, path, "\n", charset), _csv_piece), "csv-pieces")), "csv-lines")
    starts, single = F.col("inside") == 0, (F.col("inside") == 0) & (F.col("quotes") == 0)
    records = pieces.where(single).select("file", "range", "at", "value").unionByName(_gathered(pieces.where(~single), starts, "\n"))
    records = records.withColumn("value", F.regexp_replace("value", "\r$", "")).where(F.length(F.trim("value")) > 0)
    firsts = records.groupBy("file").agg(F.min(F.struct("range", "at")).alias("_first"))  # one row a file
    return records.join(firsts, "file").select("value", (F.struct("range", "at") == F.col("_first")).alias("first"))


def json_start(spark: SparkSession, path: str, pieces: int = 200, chars: int = 5_000) -> str:
    """The first characters of a file; at most ``pieces`` x ``chars`` of them reach the driver."""
    some = _pieces(spark, path, "}", "UTF-8").where(F.col("range") == 0).select("file", "at", F.substring("value", 1, chars).alias("value")).limit(pieces).collect()
    first = some[0]["file"] if some else None
    return "}".join(r["value"] for r in sorted((r for r in some if r["file"] == first), key=lambda r: r["at"])).lstrip("﻿ \t\r\n")


def _outermost(stated: DataFrame) -> DataFrame:
    """The settled pieces of the outermost objects; ``_opens`` marks where one begins, ``_lead`` is what stands before it."""
    settled = _settled(stated)
    opens = (F.col("depth") == 0) & (F.col("inside") == 0) & F.col("value").contains("{") & (F.col("after") >= 0)
    settled = settled.withColumn("_opens", opens).where(F.col("_opens") | (F.col("depth") > 0))
    lead = F.when(F.col("_opens"), F.substring_index("value", "{", 1))
    rest = F.when(F.col("_opens"), F.expr("substr(value, instr(value, '{'))")).otherwise(F.col("value"))
    return stage(settled.withColumns({"_lead": lead, "value": rest}), "json-objects")


def _objects(pieces: DataFrame) -> DataFrame:
    """The text of every outermost object, with the place of its first piece."""
    single = F.col("_opens") & (F.col("after") == 0)
    whole = pieces.where(single).select("file", "range", "at", "value")
    return whole.unionByName(_gathered(pieces.where(~single), F.col("_opens"), "}")).withColumn("value", F.concat("value", F.lit("}")))


def _unrooted(stated: DataFrame) -> DataFrame:
    """The same pieces without the object around everything, so that what stands directly in it is outermost."""
    root = (F.col("range") == 0) & (F.col("nth") == 0)
    later = (F.col("range") == 0) & (F.col("nth") > 0)
    plain = {g: F.when(root, F.col(g) - 1).otherwise(F.col(g)) for g in ("gain0", "gain1")}
    plain |= {d: F.when(later, F.col(d) - 1).otherwise(F.col(d)) for d in ("deep0", "deep1")}
    return stated.withColumns({**plain, "value": F.when(root, F.regexp_replace("value", r"^[^{]*\{", " ")).otherwise(F.col("value"))})


def json_records(spark: SparkSession, path: str, start: str) -> DataFrame | None:
    """``value``: one row per object, in the order of the file, of a JSON array, of objects one behind the other, or of the longest list of objects in a
    file that is one object. None if that one object holds no list of objects. ``start`` is what ``json_start`` gives."""
    stated = stage(_stated(_pieces(spark, path, "}", "UTF-8"), _json_piece), "json-pieces")
    outer = _outermost(stated)
    if not start.startswith("{") or outer.where("_opens").limit(2).count() != 1:
        return _objects(outer).orderBy("file", "range", "at").select("value")
    # Objects of one list follow each other with commas between; the first of a list, and a single object, come behind a key.
    inner = _outermost(_unrooted(stated))
    keyed = F.col("_opens") & (F.regexp_extract("_lead", _KEY, 0) != "")
    inner = stage(_running(inner, keyed, "_list"), "json-lists")
    lists = inner.where("_opens").groupBy("file", "_list").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(keyed, F.regexp_extract("_lead", _KEY, 2))).alias("bracket")
    )
    longest = lists.where(F.col("bracket") == "[").orderBy(F.desc("n"), "_list").first()
    if longest is None:
        return None
    return _objects(inner.where(F.col("_list") == longest["_list"])).orderBy("file", "range", "at").select("value")
