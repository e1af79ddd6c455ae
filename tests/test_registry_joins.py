"""Joins of the registry at sizes that estimates do not see."""

from terncove.plans import catalogue
from terncove.sources import registry


def test_no_growing_side_is_broadcast(spark):
    """An exploded small file looks small to the planner: divisions and entities have to be shuffled all the same."""
    t = catalogue.Tables(spark, "/root/testdata/sf0.001")
    plan = registry.places(*catalogue._registry(t))._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 3
