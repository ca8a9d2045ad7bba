"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from clonoscope.plans import catalogue, more

QUERIES, SQL = catalogue.QUERIES | more.QUERIES, catalogue.SQL | more.SQL

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{TABLES}/{f}'")
    return con


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(repr(plain(r[i])) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    ours = QUERIES[name](spark, TABLES)
    theirs = duck.execute(SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    assert bag(ours.columns, ours.collect()) == bag(names, theirs.fetchall())
