"""Registered queries against their SQL on the smallest tables, and that both sides keep and drop rows."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else float("%.9g" % v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_queries(spark):
    from noteloom.plans.registry import ORACLE, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert set(QUERIES) == set(ORACLE)
    wrong = []
    for name, f in QUERIES.items():
        df = f(spark, DATA)
        cols = sorted(df.columns)
        got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
        cur = con.execute(ORACLE[name])
        names = [c[0] for c in cur.description]
        want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
        if sorted(names) != cols or got != want or not got:
            wrong.append(name)
    assert not wrong
