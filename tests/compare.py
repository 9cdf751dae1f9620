"""Side-by-side check of a Spark query and its SQL twin in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, name)}.parquet')")
    return con


def cell(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"f{value + 0.0!r}"
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{cell(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("\x1f".join(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a short account of the difference."""
    df = fn(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    theirs = cursor.fetchall()
    names = [d[0] for d in cursor.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = lines(df.columns, mine), lines(names, theirs)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    odd = [(x, y) for x, y in zip(a, b) if x != y]
    if odd:
        return f"{len(odd)} of {len(a)} rows differ, first {odd[0][0][:300]!r} against {odd[0][1][:300]!r}"
    return None
