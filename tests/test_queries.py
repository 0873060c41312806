"""Every registered query against its SQL, and the others for rows."""

import pytest
from oracle import rows_of_spark, rows_of_sql

from voxelmill.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert rows_of_spark(registry.QUERIES[name](spark, sf_dir)) == rows_of_sql(registry.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_has_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
