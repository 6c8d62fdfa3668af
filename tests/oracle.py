"""Side-by-side comparison of a registered query and its SQL."""

from __future__ import annotations

import datetime
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.date()
    return value


def _counted(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str]]:
    """Number of rows, and what differs (empty when both sides agree)."""
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    expected = _counted(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return 0, [f"columns {sorted(df.columns)} != {sorted(names)}"]
    actual = _counted(df.columns, df.collect())
    found = []
    if actual != expected:
        found.append(f"{sum(actual.values())} rows, expected {sum(expected.values())}")
        found += [f"only in Spark: {row}" for row in list((actual - expected))[:3]]
        found += [f"only in SQL: {row}" for row in list((expected - actual))[:3]]
    return sum(actual.values()), found
