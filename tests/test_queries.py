"""Every query runs on the smallest tables, and equals its SQL where there is any."""

import pytest

from factorloom.plans import registry
from tests.conftest import SF
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    assert_same(registry.QUERIES[name](spark, SF), con, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - {"m1_ridge", "m2_forest", "m3_boosted"}))
def test_query_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns
    df.toPandas()


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
