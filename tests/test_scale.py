"""What keeps the large jobs in bounds: batches built whole, real sizes before joins, permutations without a sort."""

import json
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import Observation, functions as F

from tabella.operators import models, prepare, standardize, text
from tabella.operators.sampling import ColumnShuffle, permuted
from tabella.plans import flow, registry


def query(name):
    registry.load_all()
    return registry.QUERIES[name]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_arrays_are_built_a_batch_at_a_time():
    class Rows:
        def mapInPandas(self, run, schema):
            return run

    rows = [json.dumps({"id": i, "name": "a}, {"}) for i in range(500)]
    batches = [pd.DataFrame({"value": part}) for part in (rows[:300], [], rows[300:])]
    run = flow._as_arrays(Rows())
    made = list(run(iter(batches)))
    assert len(made) == 3 and json.loads("\n".join(pd.concat(made)["value"])) == [json.loads(r) for r in rows]
    assert list(next(run(iter([])))["value"]) == ["[]"]


def test_fingerprint_moves_rows_in_as_many_parts_as_they_fill(spark, small_data, monkeypatch):
    spark.conf.set("tabella.splits", "9")
    frame = type(spark.range(1))
    asked, real = [], frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: asked.append(a) or real(self, *a))
    try:
        assert list(query("fingerprint")(spark, small_data).first())[1] is True
    finally:
        spark.conf.unset("tabella.splits")
    assert (9,) in asked


def test_permutations_hit_every_place_once():
    for n in (1, 2, 3, 10, 1000, 4097, 99_999):
        one, two = (permuted(np.arange(n), n, key) for key in (1, 2))
        assert sorted(one) == sorted(two) == list(range(n))
        if n > 100:
            assert (one == two).mean() < 0.02 and (one == np.arange(n)).mean() < 0.02
            assert abs(np.corrcoef(one, np.arange(n))[0, 1]) < 5 / math.sqrt(n) and abs(np.corrcoef(one, two)[0, 1]) < 5 / math.sqrt(n)
    parts = [permuted(part, 4097, 7) for part in np.array_split(np.arange(4097), 5)]
    assert np.array_equal(np.concatenate(parts), permuted(np.arange(4097), 4097, 7))
    assert len(permuted(np.zeros(0, np.int64), 0, 1)) == 0


def test_draws_sort_no_values(split, spark):
    drawn = ColumnShuffle(spark.range(3000).select((F.col("id") % 7).alias("a"), "id"), ["a", "id"]).draw(3)
    assert "rangepartitioning" not in plan(drawn) and "Window" not in plan(drawn)


def test_exponents_are_summed_where_values_are_read(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(size=3000), -rng.random(500)])
    df = spark.createDataFrame(pd.DataFrame({"v0": x, "v1": np.abs(x) + 1000})).repartition(7)
    grids = {0: ([-2.0, 0.0, 0.7, 2.0], False), 1: ([-2.0, 0.0, 1.5], True)}
    got = prepare._power_sums(df, grids)
    for i, (grid, box) in grids.items():
        v = x if not i else np.abs(x) + 1000
        for j, g in enumerate(grid):
            want = prepare._powers(v, g, box).var()
            assert got[i, j]["n"] == len(v) and math.isclose(got[i, j]["s2"], want, rel_tol=1e-7)
            plain = spark.createDataFrame(pd.DataFrame({"v": v[:50]}))
            col = (prepare.box_cox_value if box else prepare.yeo_johnson_value)(F.col("v"), F.lit(g))
            assert np.allclose([r[0] for r in plain.select(col).collect()], prepare._powers(v[:50], g, box), rtol=1e-9)


def test_scores_come_once_per_row_where_keys_repeat(spark, tmp_path):
    rows = [(i // 2, float(i % 50)) for i in range(400)] + [(None, 3.0), (7, None)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = query("quantile_to_normal")(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r["in_order"] and r["in_bounds"] for r in got) and sum(r["is_missing"] for r in got) == 1


def test_standardizing_collects_no_summary_and_shuffles_rows_for_no_median(split, spark, monkeypatch):
    spark.conf.set("tabella.singleTaskRows", "100")
    rows = [(i, f"s{i % 4}", 1.0 + (i * 37) % 101) for i in range(600)]
    df = spark.createDataFrame(rows, "i long, s string, v double").withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("i") / 4).cast("int")))
    monkeypatch.setattr(type(df), "first", lambda self: pytest.fail("the summary was worked out unasked"))
    out = standardize.standardize(df, "s", "d", "v", tie="i")
    monkeypatch.undo()
    assert "SortMergeJoin" not in plan(out.rows)
    assert out.rows.count() == 600
    got = out.summary.first()
    assert got["rows_in"] == got["rows_used"] == 600 and got["series"] == got["sources"] == 4 and got["log_advised"] is False
    assert [t for _, t in out.summary.dtypes] == ["bigint"] * 8 + ["double", "bigint", "boolean"]


def test_models_reach_the_tasks_after_an_observation(spark):
    spark.range(3).observe(Observation("seen"), F.count("*").alias("n")).collect()
    rows = [(float(i % 2), Vectors.dense([float(i % 2), float(i % 3)])) for i in range(60)]
    df = spark.createDataFrame(rows, ["label", "features"]).withColumn("weight", F.lit(1.0))
    made = models.classifiers(2, 2, 3)
    for model in (made["logistic"], made["forest"], made["linear svm"], models._forest(True, 3, 2)):
        assert all(r["label"] == r["prediction"] for r in model.fit(df).transform(df).select("label", "prediction").collect())


def test_two_classes_stay_two_for_every_model(spark):
    x = np.random.default_rng(3).standard_normal((200, 2))
    df = spark.createDataFrame(pd.DataFrame({"kind": np.where(x[:, 0] > 0, "yes", "no"), "x": x[:, 0], "z": x[:, 1]}))
    got = models.compare_classifiers(df, "kind", ["x", "z"], trees=3, folds=2, only=["linear svm", "naive bayes", "neural network"]).collect()
    assert len(got) == 3 and all(r["accuracy"] > 0.8 and r["cv_accuracy"] > 0.8 for r in got)


def test_phrases_are_counted_in_more_parts_as_texts_grow(spark, monkeypatch):
    texts = ["green apple pie", "Green apple, apple pie", None, "", "pie"] * 300 + [f"rare{'abcdefghij'[i % 10]} word{'klmnopqrst'[i // 10]}" for i in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    want = [("apple pie", 600), ("green apple", 600), ("apple apple", 300)]
    made = []
    for size in (1 << 30, 300):
        monkeypatch.setattr(text, "PART_BYTES", size)
        got = text.phrase_counts(df, "t")
        shown = got._jdf.queryExecution().executedPlan().toString()
        made.append(max(int(n) for n in re.findall(r"hashpartitioning\(phrase#\d+, (\d+)\)", shown)))
        assert shown.count("hashpartitioning") == shown.count("rangepartitioning") == 1  # counts by phrase, texts by part
        assert [tuple(r) for r in got.collect()] == want
    assert made[1] > 4 * made[0]
