"""Registered queries against their SQL, and row checks for those that SQL can't express."""

import pytest

from sparkseek.plans import registry
from tests.oracle import compare, database


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    assert compare(spark, con, registry.QUERIES[name], registry.ORACLES[name], sf_dir) == ""


@pytest.mark.parametrize("name", ["scalar_clusters", "birch", "agglomerative", "kmeans", "lsa"])
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry_module_lists_all_queries(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
