import pytest

from compare import compare, tables
from tesserae.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return tables(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, QUERIES[name], ORACLES[name]) is None
