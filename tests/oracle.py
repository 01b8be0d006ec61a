"""Compares a query's rows with those of its SQL, value by value."""

from __future__ import annotations

import os

import duckdb


def normal(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, dict):
        return normal(list(v.values()))
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return "[" + ",".join(normal(x) for x in v) + "]"
    return str(v)


def connection(folder: str):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def same(spark, folder: str, fn, sql: str) -> None:
    df = fn(spark, folder)
    cols = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in cols) for r in df.collect())
    rel = connection(folder).sql(sql)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    want = sorted(tuple(normal(r[k]) for k in at) for r in rel.fetchall())
    assert got == want
