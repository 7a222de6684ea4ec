"""Comparison of a registered query with its SQL on the smallest test data."""

import datetime
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

DATA = "/root/testdata/sf0.001"


def database(folder=DATA):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in os.listdir(folder):
        p = f"{folder}/{t}"
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float, Decimal)):
        return round(float(x), 5) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return str(x) if not isinstance(x, datetime.date) else x


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def same(spark, query, sql, db, folder=DATA):
    df = query(spark, folder)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    want = db.sql(sql)
    assert got == bag(want.columns, want.fetchall())
