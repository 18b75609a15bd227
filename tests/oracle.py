"""Runs a query in Spark and its SQL in DuckDB on the same tables, and compares the rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET threads = 4")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return c


def _value(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, dict)):
        return str(x)
    return x


def rows(names: list[str], values) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_value(r[i]) for i in order) for r in values)


def spark_rows(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(c: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), rows(names, cur.fetchall())


def difference(spark_df, connection, sql: str) -> str:
    """Empty if both agree."""
    (a, x), (b, y) = spark_rows(spark_df), duck_rows(connection, sql)
    if a != b:
        return f"columns {a} and {b}"
    if x != y:
        return f"{sum(x.values())} and {sum(y.values())} rows; only Spark {list((x - y).items())[:3]}; only SQL {list((y - x).items())[:3]}"
    return ""
