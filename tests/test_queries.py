"""Every query with SQL gives the SQL's rows, and some."""

import pytest
from oracle import DATA, check, views

from momentquery import registry


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_rows_match_sql(spark, con, name):
    assert check(registry.QUERIES[name](spark, DATA), registry.ORACLE[name], con) > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_rows_without_sql(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(registry.QUERIES) <= set(entry.queries())
