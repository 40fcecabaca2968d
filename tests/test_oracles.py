import pytest

from docquarry.plans import catalog, index_catalog

from .oracle import compare

QUERIES = catalog.QUERIES | index_catalog.QUERIES
ORACLE_SQL = catalog.ORACLE_SQL | index_catalog.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
