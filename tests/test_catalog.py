"""Every query with SQL equals it on a small table; every other one gives rows."""

import os

import pytest

import __spark_entry__ as entry
from lumenframe.plans.catalog import QUERIES
from lumenframe.plans.oracle import SQL
from verify import duck, rows_hash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the standard tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows_hash(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        r = con.sql(SQL[name])
        want = rows_hash(r.columns, r.fetchall())
        assert sorted(df.columns) == sorted(r.columns) and got[:2] == want[:2]
    else:
        assert got[0] > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
