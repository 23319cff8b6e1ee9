"""Every query with SQL gives the same rows as DuckDB; every other one has rows, and the same ones again."""

import pytest

from oratorio.plans import registry
from tests.oracle import connect, rows_of, rows_of_sql

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    assert rows_of(QUERIES[name](spark, sf)) == rows_of_sql(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_agree(spark, sf, name):
    rows = rows_of(QUERIES[name](spark, sf))
    assert rows[0] and rows[1]
    assert rows == rows_of(QUERIES[name](spark, sf))
