"""Every core query gives the rows of its DuckDB statement; those without one run."""

import pytest

from sluicebed.plans import registry

from .duck import DATA, assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    sql = registry.oracle_sql().get(name)
    if sql:
        assert_same(df, con, sql)
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
