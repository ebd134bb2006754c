"""Raster and feature files, and the report."""

import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillwork.operators import cascade, vector
from rillwork.plans import report
from rillwork.sources import features, geotiff, rasters


def cells_of(spark, z):
    r, c = np.mgrid[0 : z.shape[0], 0 : z.shape[1]]
    return spark.createDataFrame(pd.DataFrame({"r": r.ravel().astype(np.int32), "c": c.ravel().astype(np.int32), "v": z.ravel()})).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def test_geotiff_source(spark, tmp_path):
    """Written as tiles by tasks, read by blocks, with a window pushed down."""
    z = 100 - 2.0 * np.arange(150)[:, None] - 0.5 * np.arange(130)[None, :]
    z[:3, :3] = np.nan
    for _ in range(2):  # files of the same name are replaced
        geotiff.save(cells_of(spark, z).repartition(3), "v", str(tmp_path), "dem", 5.0, 1000.0, 9000.0, tile=64, epsg=32632, note="Elevation")
    assert len(list(tmp_path.iterdir())) == 9
    meta = {tuple(r.path.rsplit("_", 2)[1:]): r for r in rasters.read_meta(spark, str(tmp_path)).collect()}
    m = meta["1", "2.tif"]
    assert (m.width, m.height, m.cell_w, m.x0, m.y0, m.nodata, m.epsg) == (2, 64, 5.0, 1000.0 + 640, 9000.0 - 320, -9999.0, 32632)
    for read in (rasters.read_raster, geotiff.read):
        got = read(spark, str(tmp_path)).toPandas()
        assert len(got) == z.size and got.v.isna().sum() == 9
        r, c = ((9000 - got.y) // 5).astype(int), ((got.x - 1000) // 5).astype(int)
        want = z[r, c]
        assert np.allclose(got.v[~got.v.isna()].astype(float), want[~np.isnan(want)], atol=1e-4)
    geotiff.save(cells_of(spark, z).limit(0), "v", str(tmp_path / "none"), "dem", 5.0, 0.0, 0.0)
    assert not list((tmp_path / "none").glob("*.tif"))


def test_geotiff_window(spark, tmp_path):
    """A raster of many strips in one file: few of its partitions hold the window, and only they are read."""
    z = np.arange(300.0)[:, None] * 1000 + np.arange(40.0)[None, :]
    (tmp_path / "one.tif").write_bytes(rasters.encode(z, 0.0, 300.0, 1.0))
    whole = geotiff.read(spark, str(tmp_path / "one.tif"), pixels=1)
    assert whole.rdd.getNumPartitions() == 5 and whole.count() == z.size
    part = whole.where("r >= 130 and r < 190 and c > 10 and c <= 12 and v > 0")
    assert part.rdd.getNumPartitions() == 1
    assert sorted((x.r, x.c, x.v) for x in part.collect()) == [(r, c, z[r, c]) for r in range(130, 190) for c in (11, 12)]
    assert whole.where("r = 299 and c = 39").collect()[0].v == z[299, 39] and whole.where("r > 300").count() == 0


def test_geotiff_forms():
    """Big-endian, integers with a predictor, LZW, tiles, and what is no raster."""
    v = np.arange(12, dtype=">i2").reshape(3, 4)
    fields = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, 8), (278, 3, 1, 3), (279, 4, 1, 24), (317, 3, 1, 2), (339, 3, 1, 2)]
    steps = np.diff(v, axis=1, prepend=np.zeros((3, 1), ">i2")).astype(">i2")
    head = struct.pack(">2sHI", b"MM", 42, 32) + steps.tobytes()
    body = struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHI", t, k, n) + (struct.pack(">HH", x, 0) if k == 3 else struct.pack(">I", x)) for t, k, n, x in fields) + struct.pack(">I", 0)
    assert (rasters.band(head + body) == v).all()
    # codes of 9 bits: clear, 'a', 'b', the pair just made, end
    bits = "".join(f"{x:09b}" for x in (256, 97, 98, 258, 257))
    assert rasters.unlzw(int(bits.ljust(48, "0"), 2).to_bytes(6, "big")) == b"abab"
    with pytest.raises(ValueError, match="TIFF"):
        rasters.describe(b"GIF89a")
    meta, values = rasters.ascii_grid("ncols 2\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -1\n1 2\n3 -1\n")
    assert meta["y0"] == 30 and values.tolist() == [[1, 2], [3, -1]]


def test_frames_are_replaced(spark, tmp_path):
    for steps in (3, 2):
        rasters.save_frames(spark.range(steps).select(F.col("id").alias("step"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(1.0).alias("v")), str(tmp_path / "frames"))
    assert spark.read.parquet(str(tmp_path / "frames")).select("step").distinct().count() == 2


def test_features(spark, tmp_path):
    ring = [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]]
    whole = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "a", "ELEV": 5}, "geometry": {"type": "Polygon", "coordinates": ring}}, {"type": "Feature", "properties": {}, "geometry": None}, {"type": "Feature", "properties": {"ELEV": "7.5"}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}}]}
    (tmp_path / "x.geojson").write_text(json.dumps(whole))
    got = features.read_features(spark, str(tmp_path / "x.geojson")).orderBy("seq").collect()
    assert [len(r.parts) for r in got] == [1, 2] and got[0].props["name"] == "a"
    lines = features.read_contours(spark, str(tmp_path / "x.geojson"))
    assert sorted(r.elevation for r in lines.collect()) == [5.0, 7.5, 7.5]
    features.as_features(lines, "pts", "elevation").write.text(str(tmp_path / "out"))
    back = features.read_contours(spark, str(tmp_path / "out"), "elevation").collect()
    assert sorted((r.elevation, len(r.pts)) for r in back) == [(5.0, 5), (7.5, 2), (7.5, 2)]


def test_report(spark):
    stores = spark.createDataFrame([(1, "low", 40.0, 200.0, 0.0, 4.0, 1.0), (1, "high", 80.0, 50.0, 0.0, 4.0, 1.0)], "site int, name string, elevation double, capacity double, area double, rate double, feed double")
    feed = spark.createDataFrame([(60, 1.0, 0.0), (120, 1.0, 0.0)], "time_min int, hours double, mm double")
    simulated = cascade.simulate(stores, feed, F.when(F.col("name") == "high", F.array(F.lit(100.0), F.lit(200.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0))))
    got = {(r.name, r.time_min): r for r in simulated.collect()}
    # the upper store keeps 50 and spills into the lower one in the same step
    assert got["high", 60].stored == 50 and got["low", 60].stored == 50 and got["low", 60].exit == 0
    assert got["low", 120].stored == 200 and got["low", 120].exit == pytest.approx(50) and got["low", 120].first_overflow_hr == 2
    runoff = spark.createDataFrame([(60, 1.0, 150.0), (120, 1.0, 250.0)], "time_min int, hours double, runoff_m3 double")
    steps = cascade.site_steps(simulated, runoff)
    compared = cascade.compare_sites(steps, spark.createDataFrame([(1, 120.0, 20.0)], "site int, cut_m3 double, fill_m3 double"))
    r = compared.first()
    assert (r.captured_pct, r.exit_reduction_pct, r.net_m3) == (87.5, 87.5, 100.0)
    assert r.peak_after_ls == pytest.approx(50 * 1000 / 3600) and r.peak_delay_hr == 0
    summary = simulated.groupBy("site", "name").agg(F.max("fill_pct").alias("peak_fill_pct"), F.min("first_overflow_hr").alias("first_overflow_hr"))
    page = report.report_html(compared, steps, simulated, summary, 1, "SCS runoff & cascades")
    assert page.count("<h2>") == 7 and page.count("<svg") == 2 and "87.5% of runoff captured" in page and "runoff &amp; cascades" in page
    assert "chart unavailable" in report.report_html(compared, steps, simulated, summary, 9)
    assert report.step_table(steps, simulated).orderBy("time_min").first().fills == "high: 100% | low: 25%"


def test_ridge_order_and_outline(spark):
    zone = spark.createDataFrame([(7, r, c) for r, c in [(0, 2), (1, 1), (1, 3), (2, 0), (0, 4)]], "zone long, r int, c int")
    got = [(r.r, r.c) for r in vector.ordered_pixels(zone).orderBy("seq").collect()]
    assert len(got) == 5 and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(got, got[1:]))
    square = spark.createDataFrame([(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)], "r int, c int")
    assert vector.outline(square).count() == 12 + 4
