"""A stream's gold table equals that of one batch, batches repeated or not; layers are counted while written."""

import pytest
from pyspark.sql import functions as F

from tabella.operators import layers
from tabella.operators.grouping import group_summary
from tabella.sources.sinks import write_counted
from tabella.streaming import streams
from tabella.streaming.gold import Gold, advance, gold_table, states

GOLD = Gold(["k"], ["v", "w"], ["sum", "mean", "count", "min", "max"], "at", "Month")


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i % 4 if i % 9 else None, None if i % 5 == 0 else float(i % 37) / 4, i, f"2024-0{1 + i % 3}-1{i % 7}") for i in range(600)]
    return spark.createDataFrame(rows, "k int, v double, w long, at string").withColumn("at", F.col("at").cast("date"))


def told(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_state_after_three_batches_and_a_repeated_one(spark, events, tmp_path):
    folder = str(tmp_path / "state")
    assert gold_table(spark, folder, GOLD) is None
    parts = [events.where(f"w % 3 = {i}") for i in range(3)]
    for i, part in enumerate(parts):
        advance(part, i, folder, GOLD)
        if i == 1:
            advance(part, i, folder, GOLD)
    advance(parts[2], 2, folder, GOLD)
    assert states(spark, folder) == [1, 2]
    want = group_summary(events, ["k"], ["v", "w"], list(GOLD.funcs), "at", "Month")
    got = gold_table(spark, folder, GOLD)
    assert got.columns == want.columns and told(got) == told(want)


def test_an_unfinished_state_is_not_read(spark, events, tmp_path):
    folder = tmp_path / "state"
    advance(events.where("w % 3 = 0"), 0, str(folder), GOLD)
    (folder / "batch=1").mkdir()
    assert states(spark, str(folder)) == [0]
    advance(events.where("w % 3 > 0"), 1, str(folder), GOLD)
    assert told(gold_table(spark, str(folder), GOLD)) == told(group_summary(events, ["k"], ["v", "w"], list(GOLD.funcs), "at", "Month"))


def test_functions_that_do_not_merge_are_refused():
    with pytest.raises(ValueError, match="median"):
        Gold(["k"], ["v"], ["median"])
    with pytest.raises(ValueError, match="group"):
        Gold([], ["v"], ["sum"])


def test_stream_writes_gold_checks_and_one_log_row_a_batch(spark, events, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        events.where(f"w % 3 = {i}").coalesce(1).write.mode("append").parquet(path)
    kinds = {"k": "categorical", "v": "numeric", "w": "numeric", "at": "datetime"}
    run = lambda chk: streams.stream_layers(streams.file_stream(spark, path, events.schema, max_files=1), kinds, {}, out, chk, gold=GOLD)
    run(str(tmp_path / "chk"))
    first = told(gold_table(spark, f"{out}/gold_state", GOLD))
    assert first == told(group_summary(spark.read.parquet(f"{out}/silver"), ["k"], ["v", "w"], list(GOLD.funcs), "at", "Month"))
    run(str(tmp_path / "chk-lost"))  # all batches again, as after a lost checkpoint
    assert told(gold_table(spark, f"{out}/gold_state", GOLD)) == first
    log = spark.read.parquet(f"{out}/run_log")
    assert log.count() == 3 and log.agg(F.sum("rows")).first()[0] == 600
    assert spark.read.parquet(f"{out}/quality_checks").select("batch").distinct().count() == 3


def test_layers_are_counted_while_they_are_written(spark, events, tmp_path, monkeypatch):
    assert write_counted(events, str(tmp_path / "a")) == 600 and write_counted(events.where("w < 0"), str(tmp_path / "b")) == 0
    rows = {}
    checks = spark.createDataFrame([("x", "PASS")], "check string, result string")
    layers.write_layers({"bronze": events, "silver": events.where("w < 100"), "gold": None}, str(tmp_path / "run"), checks, {}, rows)
    assert rows == {"bronze": 600, "silver": 100}
    monkeypatch.setattr(type(events), "count", lambda self: pytest.fail("a count job"))
    got = {r["layer"]: r["rows"] for r in layers.lineage_table({"bronze": events, "silver": events, "gold": None}, "x", 1, rows=rows).collect()}
    assert got == {"bronze": 600, "silver": 100, "gold": 0}
