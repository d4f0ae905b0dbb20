"""Every query runs on the smallest tables; those with SQL agree with it."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def shown(v):
    return repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def names():
    from tessera.catalogue import QUERIES

    return list(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, db, name):
    from tessera.catalogue import QUERIES, SQL

    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    if name in SQL:
        cur = db.execute(SQL[name])
        theirs = [d[0] for d in cur.description]
        assert sorted(theirs) == cols
        at = [theirs.index(c) for c in cols]
        assert got == sorted(tuple(shown(r[i]) for i in at) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "message", "path"]
    assert set(e.oracle_sql()) <= set(e.queries())
