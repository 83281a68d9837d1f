"""Spark rows against DuckDB rows, whatever their order."""

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float | Decimal):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def assert_same(spark, query, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    df = query(spark, FOLDER)
    columns = sorted(df.columns)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in cur.fetchall())
    got = Counter(tuple(plain(row[c]) for c in columns) for row in df.collect())
    assert got == want
