import pytest

from tallyforge.llm import registry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(tables):
    return connect(tables)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, con, tables, name):
    compare(spark, con, registry.queries()[name], registry.oracle_sql()[name], tables)
