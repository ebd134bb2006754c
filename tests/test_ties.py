"""Stores of one height: the storm queries follow their SQL, in the order of names; what is told of a storm may be less than all."""

import shutil

import pytest
from oracle import SF, same
from pyspark.sql import functions as F

from rillwork.operators import cascade
from rillwork.plans import catalog, site


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Tables in which many stores of a site stand at one place: their keys differ by the grid's side."""
    at = tmp_path_factory.mktemp("tied") / "sf"
    shutil.copytree(SF, at)
    (at / "supplier.parquet").chmod(0o644)
    k = F.col("s_suppkey")
    rows = spark.range(120).select(F.col("id").alias("s_suppkey")).select(k, F.format_string("S%03d", k).alias("s_name"), (k % 2).cast("int").alias("s_nationkey"), (k % 38 * 1.5).alias("s_acctbal"))
    rows.toPandas().to_parquet(at / "supplier.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["q56_site_storm", "q57_compare_storms"])
def test_ties_as_in_sql(spark, tied, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE[name], tied)


def test_orders_of_ties(spark):
    """Two of one height and one below: side by side both go to the third, by name the first goes to the second."""
    stores = spark.createDataFrame([(1, n, z, 10.0, 1000.0, 0.0) for n, z in (("a", 2.0), ("b", 2.0), ("c", 1.0))], "site int, name string, elevation double, capacity double, area double, rate double")
    feed = spark.createDataFrame([(60, 1.0, 0.0), (120, 1.0, 0.0)], "time_min int, hours double, mm double")
    volumes = F.when(F.col("name") == "c", F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(15.0), F.lit(1.0)))
    told = lambda **kw: {(r.name, r.time_min): (r.stored, r.overflow, r.exit) for r in cascade.simulate(stores, feed, volumes, **kw).collect()}
    level, named = told(), told(by_name=True)
    assert level["b", 60] == (10.0, 5.0, 0.0) and level["c", 60] == (10.0, 0.0, 0.0)
    assert named["b", 60] == (10.0, 10.0, 0.0) and named["c", 60] == (10.0, 0.0, 0.0)
    assert level["c", 120] == named["c", 120] == (10.0, 2.0, 2.0)
    assert told(leaving=True) == {k: v for k, v in level.items() if k[0] == "c"}
    assert told(frames=feed.where("time_min = 120")) == {k: v for k, v in level.items() if k[1] == 120}
