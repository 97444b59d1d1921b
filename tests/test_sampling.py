"""Stratified splits, class weights, column shuffles and nearest rows against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabella.operators import balls, models
from tabella.operators.sampling import ColumnShuffle, class_weights, stratified_folds, stratified_split


@pytest.fixture
def classes(spark):
    """One class with most rows, small ones, one of two rows, one of one row, and missing labels."""
    sizes = {"hot": 700, "b": 100, "c": 11, "two": 2, "one": 1, None: 7}
    rows = [(k, float(i)) for k, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "label string, x double").repartition(3), sizes


def counts(df):
    return {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}


def check_split(classes):
    df, sizes = classes
    train, test = stratified_split(df, "label", 0.3)
    want = {k: max(int(n * 0.3 + 0.5), min(1, n - 1)) for k, n in sizes.items()}
    assert counts(test) == {k: n for k, n in want.items() if n}
    assert counts(train) == {k: sizes[k] - n for k, n in want.items()}
    both = train.unionByName(test)
    assert both.columns == df.columns and sorted(map(str, both.collect())) == sorted(map(str, df.collect()))


def test_split_keeps_the_share_of_every_class(classes):
    check_split(classes)


def test_split_of_a_hot_class_over_many_ranges(split, classes):
    check_split(classes)


def test_split_by_an_order_and_on_empty_tables(classes):
    df, _ = classes
    _, test = stratified_split(df, "label", 0.1, order=F.col("x"))
    assert sorted(r["x"] for r in test.where("label = 'hot'").collect()) == list(map(float, range(70)))
    assert [part.count() for part in stratified_split(df.where("x < 0"), "label")] == [0, 0]


def test_folds_differ_by_one_row(classes):
    df, sizes = classes
    got = stratified_folds(df, "label", 5).groupBy("label", "_fold").count().collect()
    for label, n in sizes.items():
        held = sorted(r["count"] for r in got if r["label"] == label)
        assert sum(held) == n and max(held) - min(held) <= 1 and len(held) == min(5, n)


def test_weights_even_out_the_classes(classes):
    df, sizes = classes
    got = class_weights(df, "label").groupBy("label").agg(F.sum("weight").alias("w"), F.countDistinct("weight").alias("d")).collect()
    assert len(got) == len(sizes)
    assert all(r["d"] == 1 and abs(r["w"] - sum(sizes.values()) / len(sizes)) < 1e-6 for r in got)


def test_forest_weighs_classes_alike(spark):
    """Nine of ten rows are of one class and the input says nothing: weighted votes are even, unweighted ones are not."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"label": ["a"] * 900 + ["b"] * 100, "x": rng.random(1000)}))
    flat, n = models._labelled(df, "label", ["x"], True)
    assert n == 2 and flat.columns == ["label", "x", "weight"]
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=["x"], outputCol="features").transform(flat)
    share = models._forest(True, 20, 2).fit(ready).transform(ready).agg(F.avg(vector_to_array("probability")[1])).first()[0]
    assert 0.4 < share < 0.6


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_shuffle_breaks_the_link_on_sorted_tables(spark, parts):
    n = 200_000
    df = spark.range(n).select(F.col("id").cast("double").alias("x"), F.floor(F.col("id") / 1000).cast("double").alias("y")).repartitionByRange(parts, "x").sortWithinPartitions("x")
    got = ColumnShuffle(df, ["x", "y"]).draw(5).cache()
    a = got.agg(F.corr("x", "_p0").alias("a"), F.corr("y", "_p1").alias("b"), F.corr("_p0", "_p1").alias("c"), F.count("*").alias("n"), F.countDistinct("_p0").alias("d"), F.sum("_p1").alias("s"), F.sum("y").alias("t")).first()
    assert max(abs(a["a"]), abs(a["b"]), abs(a["c"])) < 0.01
    assert a["n"] == a["d"] == n and a["s"] == a["t"]


def test_shuffle_over_ranges_keeps_values_and_gaps(split, spark):
    rows = [(i, float(i % 7) if i % 5 else None, "z") for i in range(3000)]
    shuffle = ColumnShuffle(spark.createDataFrame(rows, "id long, v double, _column string").drop("_column").repartition(6), ["v", "id"])
    one, two = shuffle.draw(1).toPandas(), shuffle.draw(2).toPandas()
    for got in (one, two):
        assert sorted(got["id"]) == sorted(got["_p1"].astype(int)) == list(range(3000))
        assert got["_p0"].fillna(-1).value_counts().to_dict() == got["v"].fillna(-1).value_counts().to_dict()
        assert (got["_p1"] != got["id"]).mean() > 0.99
    assert (one.sort_values("id")["_p1"].to_numpy() != two.sort_values("id")["_p1"].to_numpy()).mean() > 0.99


def brute(known, asked, k):
    out = []
    for key, q in asked:
        far = sorted((sum((a - b) ** 2 for a, b in zip(q, p)), y) for y, p in known)[:k]
        out += [(key, y, round(d, 9)) for d, y in far]
    return sorted(out)


def nearest(spark, known, asked, dim, k, seen=None):
    cols = [f"_f{i}" for i in range(dim)]
    kinds = ", ".join(f"{x} double" for x in cols)
    a = spark.createDataFrame([(y, *p) for y, p in known], f"_y double, {kinds}")
    b = spark.createDataFrame([(key, *q) for key, q in asked], f"_key long, {kinds}")
    return sorted((r["_key"], r["_y"], round(r["far"], 9)) for r in balls.nearest_rows(a, b, cols, k, seen).collect())


def test_nearest_rows_where_the_first_input_is_two_valued(spark, monkeypatch):
    monkeypatch.setattr(balls, "BALL_ROWS", 40)
    rng = np.random.default_rng(2)
    points = np.column_stack([rng.integers(0, 2, 4000), rng.standard_normal((4000, 2))])
    known = [(float(i), tuple(map(float, p))) for i, p in enumerate(points[:3000])]
    asked = [(i, tuple(map(float, p))) for i, p in enumerate(points[3000:])]
    seen = []
    assert nearest(spark, known, asked, 3, 5, seen) == brute(known, asked, 5)
    assert seen[0] < 0.25 * 3000 * 1000


def test_nearest_rows_with_ties_copies_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(balls, "BALL_ROWS", 8)
    grid = [(float(i), (float(i % 5), float(i // 5 % 5))) for i in range(300)]  # every point twelve times
    hot = [(1000.0 + i, (2.0, 2.0)) for i in range(400)]
    asked = [(i, (i / 7, 2.5)) for i in range(30)] + [(100 + i, (2.0, 2.0)) for i in range(50)] + [(500, (1e6, -1e6))]
    for k in (1, 4, 9):
        assert nearest(spark, grid + hot, asked, 2, k) == brute(grid + hot, asked, k)
    assert nearest(spark, grid[:3], asked, 2, 5) == brute(grid[:3], asked, 5)
    assert nearest(spark, [], asked, 2, 5) == [] and nearest(spark, grid, [], 2, 5) == []


def test_nearest_rows_meet_few_of_a_plain_table(spark):
    rng = np.random.default_rng(8)
    known = [(float(i), tuple(map(float, p))) for i, p in enumerate(rng.random((12_000, 2)))]
    asked = [(i, tuple(map(float, p))) for i, p in enumerate(rng.random((60, 2)))]
    seen = []
    assert nearest(spark, known, asked, 2, 5, seen) == brute(known, asked, 5)
    assert seen[0] < 0.35 * 12_000 * 60


def test_importance_of_two_classes_uses_the_curve(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 2))
    df = spark.createDataFrame(pd.DataFrame({"y": np.where(x[:, 0] > 1, "yes", "no"), "x": x[:, 0], "noise": x[:, 1]}))
    got = {r["column_name"]: r for r in models.model_importance(df, "y", ["x", "noise"], True, trees=10, repeats=2).collect()}
    assert got["x"]["permutation_drop"] > 0.3 and abs(got["noise"]["permutation_drop"]) < 0.1


def test_normal_quantiles_of_a_whole_array():
    from statistics import NormalDist

    from tabella.functions.distributions import normal_quantile

    p = np.concatenate([np.linspace(0.0001, 0.9999, 2001), [1e-7, 1e-12, 1e-300, 1 - 1e-12, 0.075, 0.925, 0.5]])
    want = np.array([NormalDist().inv_cdf(x) for x in p])
    assert np.allclose(normal_quantile(p), want, rtol=1e-13, atol=1e-14)
    assert np.isnan(normal_quantile(np.array([0.0, 1.0, -1.0, np.nan]))).all()


def test_comparisons_with_few_trees(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 2))
    df = spark.createDataFrame(pd.DataFrame({"kind": np.where(x[:, 0] > 0.5, "yes", "no"), "cost": 3 * x[:, 0] + 0.1 * x[:, 1], "x": x[:, 0], "z": x[:, 1]}))
    got = models.compare_regressors(df, "cost", ["x", "z"], trees=5, penalties=3, folds=2).collect()
    assert len(got) == 7 and [r["best"] for r in got] == [True] + [False] * 6 and got[0]["model"] == "linear" and got[0]["cv_rmse"] < 0.01
    assert [r["rmse"] for r in got] == sorted(r["rmse"] for r in got)
    got = models.compare_classifiers(df, "kind", ["x", "z"], trees=5, folds=3, only=["logistic", "tree", "forest", "boosting"]).collect()
    assert len(got) == 4 and sum(r["best"] for r in got) == 1 and all(r["cv_accuracy"] > 0.9 and r["f1"] > 0.9 for r in got)
    one = df.withColumn("kind", F.when(F.col("x") == df.agg(F.max("x")).first()[0], "rare").otherwise("usual"))
    got = models.compare_classifiers(one, "kind", ["x", "z"], only=["tree"]).collect()
    assert got[0]["cv_accuracy"] is None
