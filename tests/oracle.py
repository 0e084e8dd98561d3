"""Run a registered query on Spark and its SQL oracle on DuckDB and compare the rows."""

from __future__ import annotations

import math

import duckdb

from regspark.plans import derive as D


def connect(sf: str):
    con = duckdb.connect()
    for t in D.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, int):
        return v
    if hasattr(v, "asDict"):
        return tuple(normal(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, normal(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, fn, sql):
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    want = rows_of(cols, res.fetchall())
    assert sorted(df.columns) == sorted(cols), (sorted(df.columns), sorted(cols))
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want):
        assert repr(a) == repr(b), f"\nspark  {a}\noracle {b}"
    return len(got)
