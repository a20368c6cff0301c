"""Every query with SQL gives the rows of that SQL in another engine."""

import os

import duckdb
import pytest

from ridgeline.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def norm(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if v is None else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, folder, name):
    got = QUERIES[name](spark, folder)
    want = duck.sql(SQL[name])
    assert norm(got.columns, [tuple(r) for r in got.collect()]) == norm(want.columns, want.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
