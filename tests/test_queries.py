"""Every registered query of the library against its SQL over the smallest tables."""

from __future__ import annotations

import pytest

from corpusforge.plans import catalog
from tests.oracle import both, connection

SF = "/root/testdata/sf0.001"
catalog.register()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got, want = both(spark, con, SF, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
