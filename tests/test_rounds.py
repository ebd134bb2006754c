"""How often tiles are written while something spreads over them."""

from pyspark.sql import functions as F

from rillwork.operators import terrain


def test_uphill_over_few_tiles(spark, monkeypatch):
    calls, plain = [], terrain.written
    monkeypatch.setattr(terrain, "written", lambda df, *by: calls.append(1) or plain(df, *by))
    strip = spark.range(800).select((F.col("id") / 2).cast("int").alias("r"), (F.col("id") % 2).cast("int").alias("c")).withColumn("z", 400.0 - F.col("r"))
    assert terrain.uphill(strip, F.col("r") == 399, F.lit(False)).where("w >= 0.5").count() == 800
    assert len(calls) <= 5  # one round, and one of empty tiles beyond the edge
