import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import same
from rillwork.functions import geometry as G
from rillwork.functions import hydro as H
from rillwork.operators import cascade, terrain, vector
from rillwork.plans import catalog, site  # noqa: F401 - site adds its queries
from rillwork.sources import tables as T


def cells(spark, n, f):
    return spark.createDataFrame([(r, c, float(f(r, c))) for r in range(n) for c in range(n)], "r int, c int, z double")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE[name])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_formulas(spark):
    assert value(spark, H.runoff_mm(100.0, 75)) == pytest.approx(41.16, abs=0.05)
    assert value(spark, H.runoff_mm(50.0, 100)) == pytest.approx(50.0)
    assert value(spark, H.runoff_mm(50.0, 0)) == 0
    assert value(spark, H.runoff_mm(5.0, 60)) == 0
    flat = [F.lit(x) for x in ("swale", 0.5, 2.0, 100.0, 0.0, False)]
    assert value(spark, H.capacity_m3(*flat)) == pytest.approx(80.0)
    assert value(spark, H.cut_m3(*flat[:5])) == pytest.approx(100.0)
    assert value(spark, H.fill_m3(F.lit("dam"), 2.0, 3.0, 10.0, F.lit(False))) == pytest.approx(60.0)
    assert value(spark, H.fill_m3(F.lit("berm"), 0.5, 2.0, 100.0, F.lit(False))) == pytest.approx(25.0)
    assert value(spark, H.spillway_m(1.0, 0.5)) == pytest.approx(1 / (1.7 * 0.5**1.5))
    assert value(spark, H.swale_length_m(100.0, 0.5, 2.0)) == pytest.approx(125.0)
    assert value(spark, H.percent_drop(0.0, 5.0)) == 0
    with pytest.raises(Exception, match="unknown moisture"):
        value(spark, H.adjust_cn(60, F.lit("damp")))


def test_flat_and_bowl(spark):
    assert terrain.slope_deg(cells(spark, 6, lambda r, c: 50), 1.0).agg(F.max("slope")).first()[0] == 0
    bowl = cells(spark, 20, lambda r, c: 50 + 0.3 * ((r - 9.5) ** 2 + (c - 9.5) ** 2) - (5 if 8 <= r <= 11 and 8 <= c <= 11 else 0))
    whole = {(x.r, x.c): x.w for x in terrain.fill_depressions(bowl, 20).collect()}
    tiled = {(x.r, x.c): x.w for x in terrain.fill_depressions(bowl, 20, tile=6).collect()}
    assert whole == tiled
    assert whole[9, 9] == pytest.approx(min(50 + 0.3 * (9.5**2 + (c - 9.5) ** 2) for c in range(20)))


def test_accumulation_of_a_slope(spark):
    flow = terrain.d8(cells(spark, 8, lambda r, c: 100 - 2 * r), 1.0)
    acc = terrain.accumulate(flow, 8, {"acc": F.lit(1.0)}).agg(F.max("acc"), F.sum("acc")).first()
    assert tuple(acc) == (8.0, 8 * 36.0)
    reached = terrain.uphill(cells(spark, 8, lambda r, c: 100 - 2 * r), (F.col("r") == 7) & (F.col("c") == 0), F.lit(False), tile=3)
    assert reached.where("w >= 0.5").count() == 64


def test_split_flow_on_a_plane(spark):
    plane = cells(spark, 9, lambda r, c: 100 - c + 0.5 * r)
    inner = terrain.dinf(plane, 1.0).where("r between 1 and 7 and c between 1 and 7")
    assert [tuple(x) for x in inner.select(F.round("angle", 9), F.round(F.col("p1") + F.col("p2"), 9)).distinct().collect()] == [(round(math.atan(0.5), 9), 1.0)]
    flow = terrain.dinf(plane, 1.0).withColumn("weight", F.lit(1.0))
    whole = {(x.r, x.c): x.acc for x in terrain.accumulate_split(flow).collect()}
    tiled = {(x.r, x.c): x.acc for x in terrain.accumulate_split(flow, tile=4).collect()}
    assert whole == pytest.approx(tiled)
    none = {(x.r, x.c) for x in flow.where("angle is null").collect()}
    assert sum(v for k, v in whole.items() if k in none) == pytest.approx(81)
    faces = terrain.aspect(plane).agg(F.min("aspect"), F.max("aspect")).first()
    assert faces[0] == pytest.approx(faces[1]) == pytest.approx(90 - math.degrees(math.atan(0.5)))


def test_components_and_greedy(spark):
    some = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (5, 5), (4, 4), (7, 0)], "r int, c int")
    assert terrain.components(some, 8).select("zone").distinct().count() == 3
    assert terrain.components(some, 8, eight=False).select("zone").distinct().count() == 5
    top = vector.greedy_apart(spark.createDataFrame([(0, 0, 5.0), (0, 3, 4.0), (9, 9, 3.0)], "r int, c int, acc double"), "acc", 5.0, 5).collect()
    assert [(x.r, x.c) for x in top] == [(0, 0), (9, 9)]


def test_ridges_are_thinned_and_long_enough(spark):
    block = lambda r0, c0, h, w: {(r, c) for r in range(r0, r0 + h) for c in range(c0, c0 + w)}
    df = lambda mask: spark.createDataFrame([(r, c, 1.0) for r, c in sorted(mask)], "r int, c int, z double")
    got = lambda mask, **k: {tuple(x) for x in terrain.erode(df(mask), **k).collect()}
    assert got(block(2, 2, 9, 9)) == block(5, 5, 3, 3)
    assert got(block(0, 0, 5, 5)) == {(2, 2)}  # the third pass would leave nothing
    assert got(block(2, 2, 2, 9)) == block(2, 2, 2, 9)  # too thin for any pass
    # two wide crests joined by a neck, a small one and a line: the neck and what is small or thin go
    mask = block(2, 2, 7, 36) | block(20, 2, 7, 36) | block(9, 10, 11, 1) | block(40, 2, 7, 10) | block(50, 2, 1, 40)
    out = catalog._ridge_zones(df(mask), 60).collect()
    assert [(x.zone, x.cells) for x in out] == [(5 * 60 + 5, 30), (23 * 60 + 5, 30)]


def test_storm_takes_the_rain_of_all_days(spark, tmp_path):
    spark.sql("select timestamp'2024-03-01 05:10:00' ts, 900.0D value union all select timestamp'2024-03-03 23:59:59', 1000.0D union all select timestamp'2024-03-03 23:00:00', 800.0D").write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("select 1L s_suppkey, 'a' s_name, 0 s_nationkey, 5.0D s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    rain = {x.time_min: x.mm for x in T.daily_rain(spark, str(tmp_path)).collect()}
    assert len(rain) == 72 and {k: v for k, v in rain.items() if v} == {360: 90.0, 4320: 90.0}
    out = {x.time_min: x.inflow for x in catalog.q29_storm_simulation(spark, str(tmp_path)).collect()}
    runoff = value(spark, H.runoff_mm(90.0, 70))
    assert len(out) == 72 and {k: v for k, v in out.items() if v} == {k: pytest.approx(runoff / 1000 * 1000 * 2, abs=1e-6) for k in (360, 4320)}
    assert catalog.q30_store_summary(spark, str(tmp_path)).first().inflow == pytest.approx(2 * 2 * runoff, abs=1e-5)
    assert catalog.q40_fill_frames(spark, str(tmp_path)).count() == 72


def test_equal_stores_do_not_feed_each_other(spark):
    s = spark.createDataFrame([(1, "a", 5.0), (1, "b", 5.0), (1, "c", 2.0)], "site int, name string, elevation double")
    assert {(x.name, x.receiver) for x in cascade.receivers(s).collect()} == {("a", "c"), ("b", "c"), ("c", None)}


def test_hyetograph_file(spark, tmp_path):
    def read(text):
        p = tmp_path / f"{abs(hash(text))}.csv"
        p.write_text(text, encoding="utf-8-sig")
        return sorted((x.time_min, x.cum_mm) for x in T.read_hyetograph(spark, str(p)).collect())

    assert read("Time_min,Rainfall_mm\n10,5\n20,15\n30,30\n") == [(0, 0.0), (10, 5.0), (20, 15.0), (30, 30.0)]
    assert read("time_min,rainfall_mm\n30,8\nx,1\n10,5\n20,10\n")[-1] == (30, 23.0)
    with pytest.raises(ValueError):
        read("a,b\n1,2\n")


def _streamed(spark, tmp_path, files, run, name):
    """Feeds the files one a trigger, in their order, and returns what came out."""
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, "ts string, gauge long, mm double").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}{i}"))
        schema = df.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}[0-9]"))
    q = run(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


#: Out of order between files; one reading comes a day late; the last one moves the watermark past all others.
_READINGS = [[("2024-05-01 10:00:00", 1, 40.0), ("2024-05-01 10:40:00", 1, 30.0), ("2024-05-01 10:10:00", 2, 90.0)], [("2024-05-01 10:20:00", 1, 50.0), ("2024-05-01 12:30:00", 2, 5.0)], [("2024-04-30 10:00:00", 1, 99.0), ("2024-05-01 12:10:00", 1, -3.0)], [("2024-05-03 00:00:00", 3, 1.0)]]


def test_stream_waits_for_the_order_of_time(spark, tmp_path):
    from rillwork.streaming import storm

    got = _streamed(spark, tmp_path, _READINGS, storm.running_runoff, "runoff")
    s = 25400 / 61 - 254
    q = lambda p: 0.0 if p <= 0.2 * s else (p - 0.2 * s) ** 2 / (p + 0.8 * s)
    want = {1: [("10:00", 40.0), ("10:20", 50.0), ("10:40", 30.0), ("12:10", -3.0)], 2: [("10:10", 90.0), ("12:30", 5.0)]}
    for gauge, readings in want.items():
        own, cum = sorted((r for r in got if r.gauge == gauge), key=lambda r: r.ts), 0.0
        assert [(r.ts.strftime("%H:%M"), r.mm) for r in own] == readings
        for r, (_, mm) in zip(own, readings):
            before, cum = q(cum), cum + max(0.0, mm)
            assert r.cum_mm == pytest.approx(cum) and r.runoff_mm == pytest.approx(q(cum) - before)
    assert not [r for r in got if r.mm == 99.0]  # a day late


def test_stream_of_hours(spark, tmp_path):
    from rillwork.streaming import storm

    got = {(r.gauge, r.hour.strftime("%d %H")): r.mm for r in _streamed(spark, tmp_path, _READINGS, storm.hourly, "hours")}
    assert got == {(1, "01 10"): 120.0, (2, "01 10"): 90.0, (1, "01 12"): -3.0, (2, "01 12"): 5.0}


def test_conditioned_ground_has_a_way_out(spark):
    """Every inner cell of a rough ground with a flat and a pit leads off the grid, by D8 and by split flow."""
    n = 20
    rng = np.random.default_rng(4)
    z = np.round(rng.random((n, n)) * 3, 1)
    z[5:12, 5:12] = 1.0
    z[8, 8] = 0.2
    df = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(n) for c in range(n)], "r int, c int, z double")
    way = {(x.r, x.c): (x.to_r, x.to_c) for x in terrain.condition(df, n, 1.0).collect()}
    for start in way:
        at, steps = start, 0
        while way[at][0] is not None:
            at, steps = way[at], steps + 1
            assert steps <= n * n
        assert at[0] in (0, n - 1) or at[1] in (0, n - 1)
    acc = terrain.accumulate_split(terrain.condition_dinf(df, n, 1.0).withColumn("weight", F.lit(1.0))).collect()
    assert sum(x.acc for x in acc if way[x.r, x.c][0] is None) == pytest.approx(n * n)


def test_tiles_do_not_change_what_is_found(spark):
    n = 40
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(r, c, float(100 - r + rng.random() * 2)) for r in range(n) for c in range(n)], "r int, c int, z double")
    flow = terrain.d8(df, 1.0)
    one, many = ({x.id: x.a for x in terrain.accumulate(flow, n, {"a": F.lit(1.0)}, tile=t).collect()} for t in (64, 7))
    assert one == many
    whole, parts = ({(x.r, x.c): x.w for x in terrain.fill_depressions(df, n, tile=t).collect()} for t in (64, 7))
    assert whole == parts


def test_wkt_and_geojson(spark):
    text = [("LINESTRING (0 0, 3 4)", 1), ("POLYGON ((0 0, 4 0, 4 3, 0 0), (1 1, 2 1, 2 2, 1 1))", 2), ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", 2), ("POINT (1 -2.5e0)", 1), ("LINESTRING (0 0, x 1)", None), ("POLYGON ((0 0, 1 1)", None), ("", None), (None, None)]
    got = spark.createDataFrame(text, "w string, n int").select("n", G.from_wkt("w").alias("p")).collect()
    assert all((r.p is None) if r.n is None else len(r.p) == r.n for r in got)
    line = G.line((0, 0), (3, 4), (3, 10))
    r = spark.range(1).select(G.from_geojson(G.to_geojson(line)).alias("a"), G.from_wkt(G.to_wkt(line)).alias("b"), G.from_geojson(F.lit("nope")).alias("c")).first()
    assert r.a == r.b and len(r.a[0]) == 3 and r.c is None
    r = spark.range(1).select(G.substring(line, 8.0, 2.5).alias("s"), G.project(line, 5.0, 6.0).alias("p"), G.touches(line, 2.0, 2.0, 3.0, 3.0).alias("t"), G.touches(line, 9.0, 2.0, 12.0, 3.0).alias("u")).first()
    assert [(p.x, p.y) for p in r.s] == [(1.5, 2.0), (3.0, 4.0), (3.0, 7.0)] and r.p == 7 and r.t and not r.u


def test_greedy_in_rounds_equals_one_by_one(spark):
    rng = np.random.default_rng(2)
    cells = [(int(r), int(c), float(v)) for r, c, v in zip(rng.integers(0, 90, 400), rng.integers(0, 90, 400), rng.integers(0, 50, 400))]
    cells = list({(r, c): (r, c, v) for r, c, v in cells}.values())
    kept = []
    for r, c, v in sorted(cells, key=lambda x: (-x[2], x[0], x[1])):
        if all((r - a) ** 2 + (c - b) ** 2 >= 144 for a, b, _ in kept):
            kept.append((r, c, v))
    got = vector.all_apart(spark.createDataFrame(cells, "r int, c int, v double"), "v", 12.0)
    assert sorted(tuple(x) for x in got.collect()) == sorted(kept)


def test_pond_sites_and_their_fallback(spark):
    """A valley: the site lies downstream of the keypoint, narrow; where a row is cut at its left end, the keypoint stands."""
    n = 20
    cells = spark.createDataFrame([(r, c, 100 - r + 2.0 * abs(c - 10) + (5.0 if r == 8 and c != 10 else 0.0)) for r in range(n) for c in range(n)], "r int, c int, z double")
    acc = spark.createDataFrame([(r, c, 10.0 * (r + 1) if c == 10 else 1.0) for r in range(n) for c in range(n)], "r int, c int, acc double")
    key = spark.createDataFrame([(1, 5, 10)], "rank int, kr int, kc int")
    scan = vector.pond_sites(key, cells, acc, 6, n, 5.0, cut_left=False).first()
    assert (scan.r, scan.c, scan.width_m) == (8, 10, 5.0)
    kept = vector.pond_sites(key, cells, acc, 6, n, 5.0).first()
    assert (kept.r, kept.c, kept.width_m) == (5, 10, 50.0)
