"""The operators' queries against their SQL."""

import pytest

from loomrank.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, same, data, name):
    assert same(registry.QUERIES[name](spark, data), registry.ORACLE_SQL[name], data) > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
