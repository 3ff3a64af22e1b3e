import pytest

from quillon.llm import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, small, name):
    compare(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], small)
