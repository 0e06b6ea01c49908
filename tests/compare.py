"""Run a query in Spark and its SQL in DuckDB over the same files and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, dt.datetime) and v.hour == v.minute == v.second == 0:
        return v.date()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=lambda r: tuple((x is None, str(x)) for x in r))


def differences(spark_df, con, sql, limit=3):
    got = spark_df.collect()
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    data = want.fetchall()
    assert sorted(spark_df.columns) == sorted(names), (sorted(spark_df.columns), sorted(names))
    a, b = rows(spark_df.columns, got), rows(names, data)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return len(a), len(b), wrong[:limit], len(wrong)
