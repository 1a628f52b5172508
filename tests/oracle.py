"""Rows of a query beside those of its SQL in DuckDB."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect():
    c = duckdb.connect()
    for t in TABLES.split():
        path = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return [plain(x) for x in v] if isinstance(v, list | tuple) else str(v)


def check(spark, run, sql):
    got = run(spark, SF)
    want = connect().sql(sql)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    ours = sorted(str([plain(r[n]) for n in names]) for r in got.collect())
    theirs = sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())
    assert ours and ours == theirs
