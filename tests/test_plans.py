"""How Spark joins tables of all cells: never through the driver."""

from oracle import SF

from rillwork.plans import catalog


def test_counts_and_ends_are_not_broadcast(spark):
    plan = catalog._class_counts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
