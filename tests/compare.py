"""Holds a query's rows against DuckDB's for the SQL that says the same."""

from __future__ import annotations

from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def plain(v) -> str:
    """One text for equal values of either engine."""
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return "null" if v is None else str(v)


def assert_same(got: DataFrame, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    have = sorted(tuple(map(plain, r)) for r in got.select(*names).collect())
    assert have == want
