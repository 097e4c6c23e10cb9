"""Queries that SQL can express, in whole or in part, against it."""

import pytest

from compare import compare, tables
from tesserae.llm import queries

ORACLES = queries.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return tables(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, queries.queries()[name], ORACLES[name]) is None
