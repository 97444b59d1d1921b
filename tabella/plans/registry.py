"""Registered queries: a name, a Spark function of (spark, folder), and its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator's name, with the SQL it must agree with."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Query '{name}' is registered twice.")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"tabella.plans.{module}")


MODULES = ["tables", "flow", "numbers", "business", "learning"]
