"""Every query of the engine against its SQL, and that those without SQL run."""

import pytest

from loomrank.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, same, data, name):
    same(registry.QUERIES[name](spark, data), registry.ORACLE_SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0
