"""Tables, and what is derived from them: a terrain grid, rainfall, stores and earthworks."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL = 5.0
SMOOTH, ROUGH = 0.3, 1.0  # noise of the drainage surface and of the ponding surface


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, *by: str) -> DataFrame:
    """The same rows from a table in the shared folder, so that lineage ends there; with a folder for each value of ``by``."""
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not at.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = at.get() if at.isDefined() else tempfile.mkdtemp(prefix="rillwork-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("table-"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def side(spark: SparkSession, sf_dir: str) -> int:
    """Rows and columns of the grid: the root of the orders, counted from file footers."""
    return math.isqrt(table(spark, sf_dir, "orders").count())


def grid(spark: SparkSession, sf_dir: str, noise: float = SMOOTH) -> DataFrame:
    """cell(r, c, z, cn): a valley that falls to the last row, roughened by order prices; five curve numbers."""
    n = side(spark, sf_dir)
    k = F.col("o_orderkey")
    r, c = F.floor(k / n).cast("int"), (k % n).cast("int")
    z = F.lit(200.0) - 0.4 * r + 0.3 * F.abs(c - n / 2.0) + F.col("o_totalprice") / 500000.0 * noise
    return table(spark, sf_dir, "orders").where(k < n * n).select(r.alias("r"), c.alias("c"), z.alias("z"), (40 + F.col("o_custkey") % 5 * 10).cast("int").alias("cn"))


def daily_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, hour, time_min, mm) of all events: every hour of every day from the first to the last, an hour without an event has none.

    time_min is the end of the hour, counted from the start of the first day. No event gives no row.
    """
    at = F.date_trunc("hour", "ts")
    rain = table(spark, sf_dir, "events").where("ts is not null").groupBy(F.to_date(at).alias("day"), F.hour(at).alias("hour")).agg((F.avg("value") / 10).alias("mm"))
    days = rain.agg(F.min("day").alias("first"), F.max("day").alias("last")).where("first is not null")
    days = days.select("first", F.explode(F.sequence("first", "last")).alias("day"))
    hours = days.select("day", F.datediff("day", "first").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return hours.join(rain, ["day", "hour"], "left").select("day", "hour", ((F.col("n") * 24 + F.col("hour") + 1) * 60).alias("time_min"), F.coalesce("mm", F.lit(0.0)).alias("mm"))


def hyetograph(rain: DataFrame) -> DataFrame:
    """(time_min, cum_mm) from depths (time_min, mm), from time 0. One row an hour: a window of all of them is small."""
    cum = rain.select("time_min", F.sum("mm").over(Window.orderBy("time_min").rowsBetween(Window.unboundedPreceding, 0)).alias("cum_mm"))
    zero = rain.sparkSession.range(1).select(F.lit(0).alias("time_min"), F.lit(0.0).alias("cum_mm"))
    return zero.unionAll(cum)


def read_hyetograph(spark: SparkSession, path: str) -> DataFrame:
    """(time_min, cum_mm) from a CSV with time_min and rainfall_mm, in any order and case, maybe with a byte-order mark.

    Rows that are no numbers are skipped. Depths that never fall are cumulative already, others are summed, negative
    ones as none. A row at time 0 is put in front. Missing columns, or no valid row, are an error.
    """
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*[x.lstrip("﻿").strip().lower() for x in raw.columns])
    if not {"time_min", "rainfall_mm"} <= set(raw.columns):
        raise ValueError("the file must have the columns time_min and rainfall_mm")
    rows = raw.selectExpr("cast(round(try_cast(trim(time_min) as double)) as int) time_min", "try_cast(trim(rainfall_mm) as double) mm").dropna()
    order = Window.orderBy("time_min", "mm")
    step = F.col("mm") - F.lag("mm").over(order)
    falls = rows.withColumn("step", step).agg(F.count("*").alias("n"), F.coalesce(F.max((F.col("step") < -1e-6).cast("int")), F.lit(0)).alias("falls")).first()
    if not falls["n"]:
        raise ValueError("the file has no valid row")
    depth = F.sum(F.greatest(F.col("mm"), F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0)) if falls["falls"] else F.col("mm")
    out = rows.select("time_min", depth.alias("cum_mm"))
    zero = out.agg(F.min("time_min").alias("m")).where("m != 0").select(F.lit(0).alias("time_min"), F.lit(0.0).alias("cum_mm"))
    return zero.unionAll(out)


def uniform_storms(storms: DataFrame, hours: float, step_min: int) -> DataFrame:
    """The columns of ``storms`` but rain_mm, with time_min and cum_mm: each storm's depth rain_mm spread evenly over so many hours.

    One step at least; a null depth gives null depths.
    """
    n = max(1, int(hours * 60 / step_min))
    t = (F.col("k") * step_min).cast("int")
    rest = [c for c in storms.columns if c != "rain_mm"]
    each = storms.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return each.select(*rest, t.alias("time_min"), (F.col("rain_mm") * t / (hours * 60)).alias("cum_mm"))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earthworks from parts: kind, depth, width, length, area, companion berm, gradient."""
    kinds = F.array(*[F.lit(k) for k in ("swale", "berm", "basin", "dam", "diversion")])
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k, F.element_at(kinds, (k % 5 + 1).cast("int")).alias("kind"), (F.col("p_size") / 10.0).alias("depth"), (1 + F.col("p_size") % 7 / 2.0).alias("width"),
        (F.col("p_retailprice") / 10.0).alias("length"), (F.col("p_retailprice") / 5.0).alias("area"), (k % 2 == 0).alias("companion"), (1 + k % 4).cast("double").alias("gradient"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storages from suppliers, one site for each nation."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("site"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("elevation"), (50.0 + k % 50).alias("capacity"), (1000.0 + 100 * F.col("s_nationkey")).alias("area"), F.lit(4.0).alias("rate"), (1 + k % 3).cast("double").alias("feed"),
    )
