import pytest

from tallyforge import catalog
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(tables):
    return connect(tables)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, con, tables, name):
    compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], tables)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, tables, name):
    assert catalog.QUERIES[name](spark, tables).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
