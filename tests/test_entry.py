from pathlib import Path

import pytest
from against_sql import SF, same

import __spark_entry__
from quire.plans import registry

needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.queries()) <= set(__spark_entry__.queries())


@needs_tables
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name])


@needs_tables
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
