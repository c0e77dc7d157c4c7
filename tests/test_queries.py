"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, oracle_connection

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return oracle_connection(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, duck, name):
    problem, _, _ = compare(spark, duck, small, name, QUERIES[name], ORACLES.get(name))
    assert problem is None or problem == "no rows", problem


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
