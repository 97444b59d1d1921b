"""What reaches the scan, and where the shuffles are."""

import pytest
from pyspark.sql import functions as F

from tabella.operators import basket, describe, grouping, kpi, prepare, wrangle
from tabella.session import load


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, small_data):
    events = load(spark, small_data, "events")
    text = plan(wrangle.filter_dates(events, "ts", "2024-01-05", "2024-01-12").select("event_id"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text
    lines = load(spark, small_data, "lineitem")
    text = plan(wrangle.filter_range(lines, "l_quantity", 10, 20).select("l_orderkey"))
    assert "GreaterThanOrEqual(l_quantity" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_grouping_is_one_shuffle_of_partial_results(spark, small_data):
    df = grouping.group_summary(load(spark, small_data, "orders"), ["o_orderstatus"], ["o_totalprice"], ["sum", "mean", "min"], sort=False)
    text = plan(df)
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text


def test_churn_reduces_rows_before_the_window(spark, small_data):
    text = plan(kpi.churn_trend(load(spark, small_data, "orders"), "o_custkey", "o_orderdate", 180))
    assert text.index("Window") < text.index("partial_min")


def test_baskets_read_two_columns(spark, small_data):
    text = plan(basket.baskets(load(spark, small_data, "lineitem"), "l_orderkey", "l_partkey"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text


def test_rollup_is_one_scan(spark, small_data):
    text = plan(grouping.rollup_min_mean_max(load(spark, small_data, "orders"), "o_orderdate", ["o_totalprice"]))
    assert text.count("FileScan") == 1 and F is not None


def test_long_and_sparse_forms_collect_no_categories(spark, monkeypatch):
    """A thousand categories and more in both columns: no form brings them to the driver; a wide table takes named columns only."""
    df = spark.range(5000).select((F.col("id") % 1700).cast("string").alias("a"), (F.col("id") % 2100).cast("string").alias("b"), F.col("id").cast("double").alias("v"))
    frame = type(df)
    for name in ("collect", "toPandas", "toLocalIterator", "take", "head"):
        monkeypatch.setattr(frame, name, lambda *_a, **_k: pytest.fail("rows came to the driver"))
    long = grouping.pivot_long(df, "a", "b", "v", "sum"), describe.crosstab_long(df, "a", "b"), grouping.pivot_table(df, "a", "b", "v", ["1", "2"]), describe.crosstab(df, "a", "b", ["7"])
    sparse = prepare.one_hot_sparse(df, "a", "x")
    monkeypatch.undo()
    assert long[0].count() == 1 + 1700 + 2100 + 5000 and long[1].count() == 1 + 1700 + 2100 + 5000
    assert long[2].columns == ["a", "1", "2", "All"] and long[3].columns == ["a", "7", "Total"]
    row = sparse.where("a = '10'").first()["x"]
    assert row.size == 1700 and list(row.values) == [1.0]
    with pytest.raises(ValueError, match="more than"):
        grouping.column_heads(df, "a")
    assert grouping.column_heads(df.where("v < 3"), "a") == ["0", "1", "2"]


def test_sparse_vector_of_missing_values(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "i int, c string")
    got = {r["i"]: list(r["c_vector"].toArray()) for r in prepare.one_hot_sparse(df, "c").collect()}
    assert got == {1: [0, 1], 2: [0, 0], 3: [1, 0], 4: [0, 1]}


def test_chi_square_query_on_given_rows(spark, tmp_path):
    from tabella.plans import registry

    registry.load_all()
    rows = [(p, s) for p, s, n in [("1", "F", 10), ("1", "O", 20), ("2", "F", 30), ("2", "O", 5), ("3", "P", 1), (None, "F", 4)] for _ in range(n)]
    spark.createDataFrame(rows, "o_orderpriority string, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    got = registry.QUERIES["chi_square_independence"](spark, str(tmp_path)).first()
    table = [[10, 20, 0], [30, 5, 0], [0, 0, 1]]
    right, down, n = [sum(r) for r in table], [sum(r) for r in zip(*table)], sum(map(sum, table))
    want = sum((table[i][j] - right[i] * down[j] / n) ** 2 / (right[i] * down[j] / n) for i in range(3) for j in range(3))
    assert abs(got["statistic"] - want) < 1e-5 and got["dof"] == 4
