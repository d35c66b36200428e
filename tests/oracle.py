"""Run a query and its SQL side by side, as the driver does."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def rows(columns: list[str], data) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both sides agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf_dir).execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        left, right = set(got[1]), set(want[1])
        extra, missing = sorted(left - right, key=repr)[:2], sorted(right - left, key=repr)[:2]
        return f"{len(got[1])} and {len(want[1])} rows; only in Spark {extra}, only in SQL {missing}"
    return ""
