"""Every query that has SQL gives the same rows as DuckDB on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DIR):
        c.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{DIR}/{name}')")
    return c


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


def canon(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == canon(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    df = entry.queries()[name](spark, DIR)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
