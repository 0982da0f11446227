"""Every library query against its SQL, on the smallest tables."""

import pytest

from cadaster.plans import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
