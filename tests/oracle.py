"""Holds a query's rows against those of its SQL in DuckDB."""

import os
from collections import Counter

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def rows_of(df, order):
    return Counter(tuple(plain(r[c]) for c in order) for r in df.collect())


def assert_same(df, db, sql):
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall())
    assert rows_of(df, order) == want
