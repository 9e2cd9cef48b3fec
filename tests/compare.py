"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    found = duckdb.connect()
    found.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 1 << 52 else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (bytes, bytearray)):
        return value.hex()
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


def sorted_rows(names: list[str], found: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Nothing if rows and column names agree, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = sorted_rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} but {sorted(names)} in SQL"
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return ""
    extra, lacking = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
    return f"{len(got)} rows, {len(want)} in SQL; only here: {extra}; only in SQL: {lacking}"


def rows(df, *order: str) -> list[tuple]:
    """All rows as tuples, sorted by the columns named or by their text."""
    found = [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
    return found if order else sorted(found, key=str)
