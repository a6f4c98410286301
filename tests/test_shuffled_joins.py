"""The same rows when nothing is small enough to be broadcast."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

NAMES = ["join_left_dim", "join_qualifying", "join_right_preserve", "join_full_outer_week", "join_null_safe",
         "zscore_by_group", "stratified_split", "interval_quantiles", "rank_trials", "best_so_far", "entity_sizing",
         "baseline_change", "cluster_similar"]


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql_without_broadcast(no_broadcast, data, name):
    df = entry.queries()[name](no_broadcast, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert differences(df, connect(data), entry.oracle_sql()[name]) is None
