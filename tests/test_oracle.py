"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from oracle_util import compare, duck

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()
NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    q = E.queries()[name]
    if name not in SQL:
        rows = q(spark, SF)
        assert rows.columns and rows.count() > 0
        return
    a, b, _, _ = compare(spark, con, name, q, SQL[name], SF)
    assert a == b and a[0] > 0


def test_entry(spark):
    assert E.entry(spark).count() > 0
