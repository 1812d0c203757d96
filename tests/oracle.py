"""Runs a query and its SQL over the same tables and compares the rows."""

import math

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if isinstance(v, (bool, int)) else str(v)


def same(spark, c, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    found = c.execute(sql)
    have = [d[0] for d in found.description]
    assert sorted(have) == names
    want = sorted(repr(tuple(plain(r[have.index(n)]) for n in names)) for r in found.fetchall())
    assert got == want
