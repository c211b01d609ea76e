"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([cell(x) for x in v])
    if isinstance(v, (str, bool)):
        return str(v)
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return str(v)


def rows(df: pd.DataFrame) -> list:
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


def in_duckdb(folder: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con.execute(sql).df()


def same(spark, folder: str, query, sql: str) -> None:
    a, b = query(spark, folder).toPandas(), in_duckdb(folder, sql)
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
