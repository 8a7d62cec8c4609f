"""Runs a registered query and its SQL side by side and compares all rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t)}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "is_integer") or value.__class__.__name__ == "Decimal":
        return round(float(value), 9)
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return float(value)
    return value


def bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    rows = df.collect()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} expected {sorted(names)}"
    got, want = bag(df.columns, rows), bag(names, expected)
    if got != want:
        return (
            f"{len(rows)} rows, expected {len(expected)}; only here {list((got - want).items())[:3]};"
            f" only there {list((want - got).items())[:3]} (columns {sorted(names)})"
        )
    return None
