"""Compare a query with its SQL on DuckDB."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in Path(folder).iterdir():
        con.execute(f"create view {p.name.split('.')[0]} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def same(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    found = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    places = [found.columns.index(c) for c in columns]
    ours = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(norm(r[i]) for i in places) for r in found.fetchall()), key=repr)
    assert ours == theirs
