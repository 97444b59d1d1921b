"""Every registered query against its SQL; those without SQL must return rows."""

import pytest

import __spark_entry__ as entry
from compare import database, difference
from tabella.plans import registry

DATA = "/root/testdata/sf0.01"
registry.load_all()
QUERIES, SQL = registry.QUERIES, registry.SQL
# Hundreds of boosted trees over many folds, minutes each: compared by ``check_all.py`` and the correctness run. Here their
# operators are tested with fewer trees (test_edges.py, test_sampling.py).
LONG = {"compare_regressors", "compare_classifiers", "boruta_select", "model_importance"}


@pytest.fixture(scope="module")
def con():
    return database(DATA)


@pytest.mark.parametrize("name", sorted(set(SQL) - LONG))
def test_matches_sql(spark, con, name):
    spark.catalog.clearCache()
    df = QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert difference(df, con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_returns_rows(spark, small_data, name):
    spark.catalog.clearCache()
    df = QUERIES[name](spark, small_data)
    assert df.columns and not df.isEmpty()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert not [n for n in QUERIES if n == "pipeline" or n.startswith("op")]
