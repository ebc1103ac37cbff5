"""Runs a query on Spark and its SQL on DuckDB, and tells how their rows differ."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(x):
    """Values of both engines in one form; doubles to 9 digits."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return int(x) if x == int(x) and abs(x) < 1e15 else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if isinstance(x, (list, tuple)):
        if hasattr(x, "asDict"):
            return tuple((k, plain(v)) for k, v in sorted(x.asDict().items()))
        return tuple(map(plain, x))
    return x


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, df.collect()), rows_of(names, found.fetchall())
    return "" if a == b else f"{sum(a.values())} and {sum(b.values())} rows; only Spark: {list((a - b).items())[:3]}; only SQL: {list((b - a).items())[:3]}"
