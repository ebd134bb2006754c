"""Ridges as lines: many small zones share a task's Python calls, and one over several batches stays whole."""

from rillwork.operators import vector


def test_no_group_for_each_zone(spark):
    zones = spark.createDataFrame([(7, 0, 2), (7, 0, 0), (7, 0, 1), (9, 5, 5)], "zone long, r int, c int")
    out = vector.ordered_pixels(zones)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    assert sorted(map(tuple, out.collect())) == [(7, 0, 0, 0), (7, 1, 0, 1), (7, 2, 0, 2), (9, 0, 5, 5)]


def test_zones_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        zones = spark.createDataFrame([(z, z, c) for z in range(40) for c in range(1 + z % 11)], "zone long, r int, c int")
        got = sorted(map(tuple, vector.ordered_pixels(zones).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(z, c, z, c) for z in range(40) for c in range(1 + z % 11)]
