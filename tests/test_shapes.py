"""Rings of masks, reprojection, scanlines, nearest lines and quantiles, each against a plain version."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.functions import geometry as G
from rillwork.functions import projection as P
from rillwork.operators import quantile, rings, vector
from rillwork.sources import features


def masks(spark, z):
    return spark.createDataFrame([(i, j, int(z[i, j])) for i in range(len(z)) for j in range(len(z)) if z[i, j]], "r int, c int, zone int")


@pytest.mark.parametrize("tile", [256, 7])
def test_rings_give_the_mask_back(spark, tile):
    rng = np.random.default_rng(3)
    z = (rng.random((24, 24)) < 0.62).astype(int)
    z[2:20, 2:20] = np.where(rng.random((18, 18)) < 0.9, 1, 0)
    z[4:9, 4:9] = 0
    z[6, 6] = 1  # an island in a hole
    z[12:16, 12:20] = 2  # another zone inside the first
    found = rings.polygons(masks(spark, z).union(masks(spark, z).limit(50)), 24, 2.0, x0=100.0, tile=tile)
    rows = found.collect()
    assert sum(r.area_m2 for r in rows if r.zone == 1) == 4 * (z == 1).sum() and sum(r.area_m2 for r in rows if r.zone == 2) == 4 * (z == 2).sum()
    cells = spark.createDataFrame([(i, j) for i in range(24) for j in range(24)], "r int, c int")
    shapes = found.select(F.col("zone").alias("id"), F.col("shell").alias("seq"), F.transform("parts", lambda ps: F.transform(ps, lambda p: F.struct((p["x"] - 100).alias("x"), p["y"].alias("y")))).alias("parts"))
    back = vector.in_polygons(cells, shapes, 24, 2.0).collect()
    assert sorted((x.r, x.c, x.id) for x in back) == sorted((i, j, int(z[i, j])) for i in range(24) for j in range(24) if z[i, j])
    assert sum(r.holes for r in rows) > 3 and all(len(r.parts) == r.holes + 1 for r in rows)
    # every hole lies in its own shell: alone, a shell with its holes is one connected piece of cells
    for r in rows:
        mine = {(x.r, x.c) for x in back if x.seq == r.shell}
        todo, seen = [min(mine)], {min(mine)}
        while todo:
            i, j = todo.pop()
            for k in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if k in mine and k not in seen:
                    seen.add(k)
                    todo.append(k)
        assert seen == mine and r.area_m2 == 4 * len(mine)
    text = found.select(F.col("area_m2"), G.from_wkt("wkt").alias("p")).collect()
    for t in text:
        area = sum(abs(sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:] + ring[:1]))) / 2 * (1 if k == 0 else -1) for k, ring in enumerate(t.p))
        assert area == pytest.approx(t.area_m2)


def test_rings_of_simple_masks(spark):
    z = np.zeros((6, 6), int)
    z[1:5, 1:5] = 7
    z[2:4, 2:4] = 0
    r = rings.polygons(masks(spark, z), 6, 1.0).first()
    assert (r.zone, r.area_m2, r.perimeter_m, r.holes) == (7, 12.0, 24.0, 1)
    assert len(r.parts[0]) == 4 and len(r.parts[1]) == 4
    z[:] = 0
    z[0, 0] = z[1, 1] = 3  # touching at a corner only
    assert sorted(x.area_m2 for x in rings.polygons(masks(spark, z), 6, 1.0).collect()) == [1.0, 1.0]
    assert rings.polygons(masks(spark, z).limit(0), 6, 1.0).count() == 0


def arc(lat):
    """Length of the meridian from the equator, by plain integration."""
    a, f = P.WGS84
    e2, k = f * (2 - f), 20000
    h = math.radians(lat) / k
    return sum(w * a * (1 - e2) / (1 - e2 * math.sin(i * h) ** 2) ** 1.5 for i, w in ((i, 1 if i in (0, k) else 4 if i % 2 else 2) for i in range(k + 1))) * h / 3


def test_projection(spark):
    one = lambda x, y, a, b: spark.range(1).select(P.transform(F.lit(x), F.lit(y), a, b).alias("p")).first().p
    for lat in (-75.0, 0.0, 12.5, 47.0, 84.0):  # on the middle meridian the northing is the arc
        p = one(9.0, lat, 4326, 32632)
        assert abs(p.x - 500000) < 1e-6 and abs(p.y - 0.9996 * arc(lat)) < 1e-3
    tower = one(-(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600, 4326, 32617)
    assert abs(tower.x - 630084) < 1 and abs(tower.y - 4833439) < 1
    assert abs(one(9.0, -10.0, 4326, 32732).y - (1e7 - 0.9996 * arc(10.0))) < 1e-3
    p = one(180.0, 85.0511287798, 4326, 3857)
    assert abs(p.x - 20037508.342789) < 1e-3 and abs(p.y - 20037508.34) < 0.1
    r = random.Random(1)
    points = [(r.uniform(3, 15), r.uniform(-80, 84)) for _ in range(300)] + [(None, 5.0), (9.0, 90.0)]
    df = spark.createDataFrame(points, "lon double, lat double")
    for code in (32632, 32732, 25832, 3857):
        back = df.withColumn("p", P.transform(F.col("lon"), F.col("lat"), 4326, code)).withColumn("q", P.transform(F.col("p.x"), F.col("p.y"), code, 4326)).collect()
        assert all(abs(x.q.x - x.lon) < 1e-8 and abs(x.q.y - x.lat) < 1e-8 for x in back[:300])
        assert back[300].q.x is None and back[301].p.x is None
    with pytest.raises(ValueError, match="EPSG:2056"):
        P.transform(F.lit(1.0), F.lit(1.0), 4326, 2056)


def test_features_of_another_system_burn_on_the_grid(spark, tmp_path):
    """A box of 40 x 20 m around a place in a UTM zone, read in degrees."""
    corners = [(500100.0, 5300020.0), (500140.0, 5300020.0), (500140.0, 5300040.0), (500100.0, 5300040.0)]
    box = spark.createDataFrame(corners, "x double, y double").select(P.transform(F.col("x"), F.col("y"), 32632, 4326).alias("p")).collect()
    ring = [[b.p.x, b.p.y] for b in box]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[*ring, ring[0]]]}}]}))
    read = features.read_features(spark, str(tmp_path / "a.geojson"), to_epsg=32632)
    shape = read.select(F.lit(1).alias("id"), "seq", F.transform("parts", lambda ps: F.transform(ps, lambda p: F.struct((p["x"] - 500000).alias("x"), (p["y"] - 5300000).alias("y")))).alias("parts"))
    cells = spark.range(40 * 40).select((F.col("id") / 40).cast("int").alias("r"), (F.col("id") % 40).cast("int").alias("c"))
    got = vector.in_polygons(cells, shape, 40, 5.0).collect()
    assert sorted((x.r, x.c) for x in got) == [(r, c) for r in range(32, 36) for c in range(20, 28)]


def test_scanlines(spark):
    """Random stars on a grid, some of them partly outside it, by centre and by touch, against every cell with every polygon."""
    r = random.Random(4)
    shapes = []
    for k in range(25):
        x, y, m = r.uniform(-20, 120), r.uniform(-20, 120), r.randint(3, 9)
        pts = [(x + d * math.cos(t), y + d * math.sin(t)) for t, d in ((2 * math.pi * i / m, r.uniform(1, 40)) for i in range(m))]
        shapes.append((k, k, [pts] if k % 3 else [pts, [(x - 2.5, y - 2.5), (x + 2.5, y - 2.5), (x, y + 2.5)]]))
    shapes.append((90, 90, [[(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0)]]))  # on the lines of the grid
    shapes.append((91, 91, []))
    polygons = spark.createDataFrame(shapes, "id int, seq int, parts array<array<struct<x: double, y: double>>>")
    cells = spark.createDataFrame([(i, j) for i in range(20) for j in range(20)], "r int, c int")
    x, y = (F.col("c") + 0.5) * 5.0, (19.5 - F.col("r")) * 5.0
    each = cells.crossJoin(polygons)
    odd = F.aggregate("parts", F.lit(0), lambda a, p: a + G.inside(p, x, y).cast("int")) % 2 == 1
    edge = F.exists("parts", lambda p: G.touches(G.closed(p), x - 2.5, y - 2.5, x + 2.5, y + 2.5))
    rows = lambda df: sorted((a.r, a.c, a.id) for a in df.collect())
    assert rows(vector.in_polygons(cells, polygons, 20, 5.0)) == rows(each.where(odd))
    assert rows(vector.in_polygons(cells, polygons, 20, 5.0, all_touched=True)) == rows(each.where(odd | edge))
    assert rows(vector.on_edges(cells, polygons, 20, 5.0)) == rows(each.where(edge))


def test_scanlines_follow_what_is_covered(spark):
    """A thousand small polygons on one row make a few candidate cells each, not a row each."""
    shapes = [(k, k, [[(k * 5 + 0.5, 1.0), (k * 5 + 4.5, 1.0), (k * 5 + 4.5, 4.0), (k * 5 + 0.5, 4.0)]]) for k in range(1000)]
    polygons = spark.createDataFrame(shapes, "id int, seq int, parts array<array<struct<x: double, y: double>>>")
    span = vector._spans(polygons, 1000, 5.0)
    assert span.count() == 1000 and span.withColumn("c", vector._columns(F.col("a"), F.col("b"), 1000, 5.0)).count() <= 3000


@pytest.mark.parametrize("few", [500, 0])
def test_nearest_with_odd_points(spark, few):
    nan = float("nan")
    points = spark.createDataFrame([(1, 0.0, 1.0), (2, None, 1.0), (3, nan, 2.0), (4, float("inf"), 0.0), (5, 900.0, 900.0), (6, 5.0, 5.0)], "pid int, x double, y double")
    lines = spark.createDataFrame([(7, [(0.0, 0.0), (10.0, 0.0)]), (8, [(0.0, 10.0), (10.0, 10.0)]), (9, [(nan, 0.0), (1.0, 1.0)])], "id int, pts array<struct<x: double, y: double>>")
    got = {r.pid: (r.id, r.distance) for r in vector.nearest(points, lines, 4.0, few=few).collect()}
    assert got == {1: (7, 1.0), 2: (None, None), 3: (None, None), 4: (None, None), 5: (8, pytest.approx(math.hypot(890, 890), abs=1e-6)), 6: (7, 5.0)}
    near = {r.pid: r.id for r in vector.nearest(points, lines, 1.0, 4.0, few=few).collect()}
    assert near == {1: 7, 2: None, 3: None, 4: None, 5: None, 6: None}
    assert {r.id for r in vector.nearest(points, lines.limit(0), 1.0, 4.0, few=few).collect()} == {None}


def test_quantiles(spark):
    r = random.Random(9)
    for values in ([r.gauss(0, 1) for _ in range(501)], [float(r.randrange(5)) for _ in range(400)], [1e300, -1e300, 3.0, 3.0, 1e-300], [7.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
        for q in (0.0, 0.25, 0.75, 1.0):
            assert quantile.quantile(df, "v", q) == pytest.approx(float(np.quantile(values, q)), rel=1e-12)
        k = len(values) // 2
        assert quantile.order_statistic(df.where("v is not null and not isnan(v)"), "v", k, buckets=3) == sorted(values)[k]
    assert quantile.quantile(df.limit(0), "v", 0.5) is None
