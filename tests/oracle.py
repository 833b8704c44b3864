"""Spark query against DuckDB text on the same tables: names, row count and values, whatever the order."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return float(x) if type(x).__name__ == "Decimal" else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir: str):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def same(df, sql: str, sf_dir: str) -> int:
    """Asserts that both give the same; the number of rows."""
    cursor = connect(sf_dir).execute(sql)
    names = [x[0] for x in cursor.description]
    expected = rows_of(names, cursor.fetchall())
    got = rows_of(df.columns, df.collect())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    assert len(got) == len(expected), (len(got), len(expected))
    for a, b in zip(got, expected):
        assert a == b, (a, b)
    return len(got)
