"""Spark's rows against DuckDB's, as the driver compares them: columns by name, rows as a bag, values as text."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{d}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return c


def value(v: object) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v) + 0.0)
    return str(v)


def bag(columns: list[str], rows: list) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def differences(df, c: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    got = c.execute(sql)
    names, theirs = [x[0] for x in got.description], got.fetchall()
    ours = df.collect()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = bag(df.columns, ours), bag(names, theirs)
    if a == b:
        return None
    bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return f"{len(a)} and {len(b)} rows; {bad}"
