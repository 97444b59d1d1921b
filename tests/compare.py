"""Run a registered query and its SQL check side by side."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float) and math.isnan(v):
        return (0, "")
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return (2, round(float(v), 6) + 0.0)
    return (3, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=str), [columns[i] for i in order]


def difference(spark_df, con, sql: str) -> str:
    """Empty text when both sides agree, else a short description."""
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    want, wcols = rows_of(dcols, cur.fetchall())
    pdf = spark_df.collect()
    got, gcols = rows_of(spark_df.columns, [tuple(r) for r in pdf])
    if wcols != gcols:
        return f"columns: spark {gcols} sql {wcols}"
    if len(got) != len(want):
        return f"rows: spark {len(got)} sql {len(want)}; spark first {got[:1]} sql first {want[:1]}"
    for g, w in zip(got, want):
        if g != w:
            bad = [(gcols[i], g[i][1], w[i][1]) for i in range(len(g)) if g[i] != w[i]]
            return f"first difference (column, spark, sql): {bad[:4]} in {g}"
    return "" if got else "no rows on either side"
