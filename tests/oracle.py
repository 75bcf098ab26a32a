"""Runs a query and its DuckDB oracle over the same tables and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 9) + 0.0
    return str(v)


def difference(query, sql: str, spark, sf_dir: str, con=None) -> str:
    """What differs; empty if nothing does."""
    con = con or connect(sf_dir)
    want = con.sql(sql)
    df = query(spark, sf_dir)
    names = sorted(want.columns)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} against {names}"
    key = lambda r: tuple((x is None, type(x).__name__, x) for x in r)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    at = [want.columns.index(n) for n in names]
    exp = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
    if len(got) != len(exp):
        return f"{len(got)} rows against {len(exp)}"
    bad = [(g, e) for g, e in zip(got, exp) if g != e]
    return f"{len(bad)} of {len(got)} rows, such as {bad[0]}" if bad else ""
