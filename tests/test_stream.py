"""The rain stream goes on from its checkpoint, and equals a batch over whatever order files come in."""

import random

import pytest
from pyspark.sql import functions as F

from rillwork.functions import labels as L
from rillwork.streaming import storm

SCHEMA = "ts timestamp, gauge long, mm double"


def put(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "ts string, gauge long, mm double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(folder / name))


def drain(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    q = storm.running_runoff(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_restart_from_a_checkpoint(spark, tmp_path):
    r = random.Random(3)
    readings = [(f"2024-05-01 {h:02d}:{m:02d}:00", g, round(r.random() * 20, 1)) for g in (1, 2) for h in range(8, 20) for m in (0, 20, 40)]
    late = sorted(readings, key=lambda x: (x[0][:13], r.random()))  # out of order within the hour
    put(spark, tmp_path, "in0", late[:30] + [(None, 1, 9.0), ("2024-05-01 08:05:00", None, 9.0), ("2024-05-01 08:05:00", 1, None)])
    drain(spark, tmp_path)
    put(spark, tmp_path, "in1", late[30:])
    put(spark, tmp_path, "in2", [("2024-05-03 00:00:00", 3, 1.0)])
    drain(spark, tmp_path)
    got = spark.read.parquet(str(tmp_path / "out")).where("gauge < 3").collect()
    s = 25400 / 61 - 254
    q = lambda p: 0.0 if p <= 0.2 * s else (p - 0.2 * s) ** 2 / (p + 0.8 * s)
    assert len(got) == len(readings)
    for g in (1, 2):
        total = 0.0
        own = sorted((x for x in got if x.gauge == g), key=lambda x: x.ts)
        for x, (t, _, mm) in zip(own, sorted(x for x in readings if x[1] == g), strict=True):
            before, total = q(total), total + mm
            assert x.ts.strftime("%Y-%m-%d %H:%M:%S") == t and x.cum_mm == pytest.approx(total) and x.runoff_mm == pytest.approx(q(total) - before)


def test_direction_text(spark):
    got = spark.createDataFrame([("dinf",), ("d8",), (None,)], "k string").select(L.direction_text("k").alias("t")).collect()
    assert got[0].t == L.DIRECTIONS["dinf"] and got[1].t == got[2].t == L.DIRECTIONS["d8"]
