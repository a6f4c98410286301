"""Every registered query against its SQL, or for its rows when there is none."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, con, name):
    df = entry.queries()[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert differences(df, con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(ORACLES)))
def test_has_rows(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
