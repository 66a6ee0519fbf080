"""Holds a query's rows against its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 8; SET memory_limit = '8GB'")
    for table in sorted(Path(sf_dir).glob("*.parquet")):
        at = f"{table}/*.parquet" if table.is_dir() else table
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    return value


def differences(result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list:
    names = sorted(result.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in result.collect()), key=repr)
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    if sorted(found) != names:
        return [("columns", names, sorted(found))]
    order = [found.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    if len(got) != len(want):
        return [("rows", len(got), len(want))]
    return [(a, b) for a, b in zip(got, want, strict=True) if a != b]
