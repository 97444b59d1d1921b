"""The algorithms for large tables agree with brute force, hot keys and ties included."""

import random
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tabella.functions.ordering import add_position, add_running, carry, neighbourhoods, top_rows
from tabella.functions.quantiles import column_quantiles, group_quantiles, many_quantiles, rank_average


@pytest.fixture(scope="module")
def skewed():
    """One key with most rows, one value with a third of them, gaps, and ties."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        value = None if rng.random() < 0.05 else 7.0 if rng.random() < 0.35 else round(rng.gauss(0, 50), 1)
        rows.append((key, i, float(rng.randint(0, 400)) if rng.random() > 0.3 else 100.0, value))
    return pd.DataFrame(rows, columns=["key", "id", "at", "value"])


@pytest.fixture
def table(spark, skewed):
    rows = [tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in skewed.itertuples(index=False)]
    return spark.createDataFrame(rows, "key string, id long, at double, value double").repartition(3)


def keyed(pdf):
    return pdf.assign(key=pdf["key"].fillna("-"))


def test_position(split, table, skewed):
    got = add_position(table, ["key"], "at", "id").toPandas()
    want = keyed(skewed).sort_values(["key", "at", "id"])
    want["pos"] = want.groupby("key").cumcount() + 1
    merged = got[["id", "_pos"]].merge(want[["id", "pos"]], on="id")
    assert len(got) == len(skewed) and (merged["_pos"] == merged["pos"]).all()


def test_running_sum(split, table, skewed):
    got = add_running(table, [], "at", "id", F.col("id"), "run").select("id", "run").toPandas()
    want = skewed.sort_values(["at", "id"]).assign(want=lambda d: d["id"].cumsum())
    merged = got.merge(want[["id", "want"]], on="id")
    assert (merged["run"] == merged["want"]).all() and len(merged) == len(skewed)


@pytest.mark.parametrize("backward", [False, True])
def test_carry(split, table, skewed, backward):
    got = carry(table, ["value"], "at", "id", ["key"], backward=backward).select("id", "value").toPandas()
    want = keyed(skewed).sort_values(["key", "at", "id"])
    fill = "bfill" if backward else "ffill"
    want["want"] = getattr(want.groupby("key")["value"], fill)()
    merged = got.merge(want[["id", "want"]], on="id")
    assert np.allclose(merged["value"], merged["want"], equal_nan=True)


def test_neighbourhoods(spark, split, table, skewed):
    d = neighbourhoods(table, ["key"], "at", "id", 3, 3, chunk_rows=10)
    w = Window.partitionBy("key", "_chunk").orderBy("_pos").rowsBetween(-3, 3)
    got = d.withColumn("s", F.sum("id").over(w)).where("_own").select("id", "s").toPandas()
    want = keyed(skewed).sort_values(["key", "at", "id"])
    want["want"] = want.groupby("key")["id"].transform(lambda s: s.rolling(7, center=True, min_periods=1).sum())
    merged = got.merge(want[["id", "want"]], on="id")
    assert len(got) == len(skewed) and (merged["s"] == merged["want"]).all()


def test_group_quantiles(split, table, skewed):
    got = group_quantiles(table, ["key"], "value", {"a": 0.25, "b": 0.5, "c": 0.75}).fillna("-", ["key"]).toPandas().set_index("key").sort_index()
    want = keyed(skewed).groupby("key")["value"].quantile([0.25, 0.5, 0.75]).unstack()
    assert np.allclose(got.to_numpy(), want.loc[got.index].to_numpy()) and len(got) == len(want)


def test_many_quantiles(split, table, skewed):
    probs = [i / 20 for i in range(21)]
    assert np.allclose(many_quantiles(table, "value", probs), skewed["value"].quantile(probs))


@pytest.mark.parametrize("exact_rows", [1, 50, 5000])
def test_column_quantiles_by_narrowing(table, skewed, exact_rows):
    got = column_quantiles(table, {"value": [0.0, 0.1, 0.5, 0.9, 1.0], "at": [0.5]}, exact_rows, small=False)
    assert np.allclose(got["value"], skewed["value"].quantile([0, 0.1, 0.5, 0.9, 1]))
    assert np.allclose(got["at"], [skewed["at"].median()])


def test_rank_average(split, table, skewed):
    got = rank_average(table, "value", "r").toPandas().set_index("value")["r"].sort_index()
    want = skewed.assign(r=skewed["value"].rank()).dropna(subset=["value"]).groupby("value")["r"].first()
    assert np.allclose(got.to_numpy(), want.to_numpy())


def test_top_rows(table, skewed):
    got = top_rows(table, ["key"], [F.col("at").desc(), F.col("id")], 4).toPandas()
    want = keyed(skewed).sort_values(["at", "id"], ascending=[False, True]).groupby("key").head(4)
    assert set(got["id"]) == set(want["id"])


def test_quantiles_of_nothing(spark, split):
    empty = spark.createDataFrame([], "v double")
    assert column_quantiles(empty, {"v": [0.5]}, small=False) == {"v": [None]}
    assert column_quantiles(empty, {"v": [0.5]}, small=True) == {"v": [None]}


def test_operators_agree_when_split(spark, small_data):
    """Whole operators give the same rows by either route."""
    from compare import rows_of

    import __spark_entry__ as entry

    queries = entry.queries()
    for name in ["fill_forward", "group_summary", "pivot_table", "flag_gaps", "vs_others", "series_quality", "box_stats", "correlation_matrix_spearman", "ordinal_encode", "clean_table"]:
        spark.conf.unset("tabella.singleTaskRows")
        a = queries[name](spark, small_data)
        want = rows_of(a.columns, [tuple(r) for r in a.collect()])
        spark.conf.set("tabella.singleTaskRows", "0")
        spark.conf.set("tabella.splits", "4")
        try:
            b = queries[name](spark, small_data)
            got = rows_of(b.columns, [tuple(r) for r in b.collect()])
        finally:
            spark.conf.unset("tabella.singleTaskRows")
            spark.conf.unset("tabella.splits")
        assert got == want, name


ORDERS = {
    "text dates": ("string", lambda i: f"2024-{1 + i // 28 % 12:02d}-{1 + i % 28:02d}"),
    "long keys": ("long", lambda i: 2**60 + i // 3),
    "decimals": ("decimal(30,10)", lambda i: Decimal(i // 2) / 1000 + Decimal(10) ** 18),
    "dates": ("date", lambda i: date(2000, 1, 1) + timedelta(days=i // 4)),
    "mostly one value": ("string", lambda i: "same value in most rows" if i % 10 else f"z{i}"),
}


@pytest.mark.parametrize("name", ORDERS)
def test_ranges_are_cut_on_real_values(spark, split, name):
    kind, make = ORDERS[name]
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.05 else make(i), i, None if rng.random() < 0.5 else i * 1.0) for i in range(2000)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, f"at {kind}, id long, value double").repartition(3)
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1]))
    gaps = sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
    place = {r[1]: i for i, r in enumerate([*gaps, *known], 1)}
    got = add_position(table, [], "at", "id").select("id", "_pos").collect()
    assert {r["id"]: r["_pos"] for r in got} == place
    for backward in (False, True):
        last, want = None, {}
        for r in [*(known[::-1] if backward else known), *(gaps[::-1] if backward else gaps)]:
            last = r[2] if r[2] is not None else last
            want[r[1]] = last
        filled = carry(table, ["value"], "at", "id", backward=backward).select("id", "value").collect()
        assert {r["id"]: r["value"] for r in filled} == want
