"""Compares a query with its SQL on the same tables."""

import math
import os

import duckdb

ROOT = os.environ.get("TEST_DATA", "/root/testdata")


def connect(sf_dir):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            at = f"{sf_dir}/{f}"
            c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    return float(v) if isinstance(v, int) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = rows([d[0] for d in rel.description], rel.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    for g, w in zip(got[1], want[1]):
        assert g == w, (g, w)
    return len(got[1])
