"""Runs a query on Spark and its SQL on DuckDB over the same small tables."""

from __future__ import annotations

import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(folder=SMALL):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, int | float):
        return float(x)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in data), key=repr)


def check(spark, con, query, sql, folder=SMALL):
    df = query(spark, folder)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())
