"""All queries of the library that have SQL against it, over the smallest tables."""

import os

import duckdb
import pytest

from plumeline.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
NAMES = sorted(ORACLE_SQL)
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def canonical(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted(tuple("" if r[i] is None else repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns, order) == canonical(cursor.fetchall(), columns, order)
