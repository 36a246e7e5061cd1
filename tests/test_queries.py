"""Every query with SQL gives the rows of its SQL on the smallest tables, and some; every other one gives rows."""

import pytest
from compare import compare
from methframe.plans import general, reference

QUERIES, SQL = general.QUERIES | reference.QUERIES, general.SQL | reference.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, name):
    found = compare(spark, QUERIES[name], SQL[name], small)
    if found.startswith("no rows"):
        found = compare(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.01")
    assert found == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
