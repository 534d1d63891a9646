"""Queries against their SQL on the smallest tables, where these are there."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    base = duckdb.connect()
    for name in os.listdir(SF):
        base.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return base


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall())
    assert got == want
