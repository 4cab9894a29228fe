"""Every registered query runs, and gives the rows of its SQL."""

import pytest
from oracle import connect, rows_of_spark, rows_of_sql

from sessionloom.plans import oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    assert rows_of_spark(queries()[name](spark, sf)) == rows_of_sql(con, oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
