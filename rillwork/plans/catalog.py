"""The registered queries of the terrain engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwork.functions import geometry as G
from rillwork.functions import hydro as H
from rillwork.operators import cascade, quantile, terrain, vector
from rillwork.sources import tables as T

AREA = T.CELL * T.CELL
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in names})


def _grid_sql(noise: float) -> str:
    return f"""
n AS (SELECT floor(sqrt(count(*)))::BIGINT AS n FROM orders),
g AS (SELECT (o_orderkey // n)::INT AS r, (o_orderkey % n)::INT AS c,
  2e2 - 4e-1 * (o_orderkey // n) + 3e-1 * abs((o_orderkey % n) - n / 2e0) + o_totalprice / 5e5 * {noise:e} AS z,
  (40 + o_custkey % 5 * 10)::INT AS cn, n FROM orders, n WHERE o_orderkey < n * n)"""


GRID, ROUGH = _grid_sql(T.SMOOTH), _grid_sql(T.ROUGH)
SLOPE = GRID + """,
d AS (SELECT *, lag(z) OVER x AS w, lead(z) OVER x AS e, lag(z) OVER y AS no, lead(z) OVER y AS s FROM g
  WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)),
sl AS (SELECT r, c, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM (SELECT r, c,
  CASE WHEN w IS NULL THEN (e - z) / 5e0 WHEN e IS NULL THEN (z - w) / 5e0 ELSE (e - w) / 1e1 END AS gx,
  CASE WHEN no IS NULL THEN (s - z) / 5e0 WHEN s IS NULL THEN (z - no) / 5e0 ELSE (s - no) / 1e1 END AS gy FROM d))"""
_STEPS = ", ".join(f"({i}, {dr}, {dc}, {code}, {'5e0 * sqrt(2e0)' if dr and dc else '5e0'})" for i, (_, dr, dc, code) in enumerate(terrain.D8))
DIRS = GRID + f""",
st(i, dr, dc, code, dist) AS (VALUES {_STEPS}),
fl AS (SELECT a.r, a.c, i, code, b.r AS tr, b.c AS tc, (a.z - b.z) / dist AS f FROM g a, st, g b WHERE b.r = a.r + dr AND b.c = a.c + dc),
be AS (SELECT * FROM fl WHERE f > 0 QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY f DESC, i) = 1),
d8 AS (SELECT g.r, g.c, g.cn, g.z, coalesce(code, 0) AS dir, tr AS to_r, tc AS to_c FROM g LEFT JOIN be ON be.r = g.r AND be.c = g.c)"""
WALK = "WITH RECURSIVE " + DIRS + """,
walk AS (SELECT r AS sr, c AS sc, r, c, cn FROM d8 UNION ALL SELECT w.sr, w.sc, d.to_r, d.to_c, w.cn FROM walk w JOIN d8 d ON d.r = w.r AND d.c = w.c WHERE d.to_r IS NOT NULL)"""
RAIN = """
first AS (SELECT min(ts)::DATE AS d0, max(ts)::DATE AS d1 FROM events),
rain AS (SELECT day, h::INT AS hour, ((date_diff('day', d0, day) * 24 + h + 1) * 60)::INT AS time_min, coalesce(mm, 0e0) AS mm FROM
  (SELECT unnest(generate_series(d0, d1, INTERVAL 1 DAY))::DATE AS day, d0 FROM first), (SELECT unnest(range(24)) AS h) LEFT JOIN
  (SELECT ts::DATE AS dd, hour(ts) AS hh, avg(value) / 10 AS mm FROM events GROUP BY 1, 2) ON dd = day AND hh = h),
hy AS (SELECT 0 AS time_min, 0e0 AS cum_mm UNION ALL SELECT time_min, sum(mm) OVER (ORDER BY time_min) FROM rain),
storm AS (SELECT day, time_min, sum(mm) OVER (PARTITION BY day ORDER BY hour) AS cum_mm FROM rain)"""


def _q(p: str, cn: str) -> str:
    s = f"(254e2 / {cn} - 254e0)"
    return f"(CASE WHEN {p} <= 2e-1 * {s} THEN 0e0 ELSE ({p} - 2e-1 * {s}) * ({p} - 2e-1 * {s}) / ({p} - 2e-1 * {s} + {s}) END)"


@query(f"WITH {GRID} SELECT r, c, round(z, 6) AS z, cn FROM g")
def q01_dem_grid(spark, sf):
    return rounded(T.grid(spark, sf), "z")


@query(f"WITH {GRID} SELECT count(*)::BIGINT AS cells, (max(c) + 1)::INT AS width, (max(r) + 1)::INT AS height, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max, count(*) * 25 / 1e4 AS area_ha FROM g")
def q02_dem_metadata(spark, sf):
    out = T.grid(spark, sf).agg(F.count("*").alias("cells"), (F.max("c") + 1).alias("width"), (F.max("r") + 1).alias("height"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), (F.count("*") * AREA / 10000).alias("area_ha"))
    return rounded(out, "z_min", "z_max")


@query(f"WITH {SLOPE} SELECT r, c, round(slope, 6) AS slope FROM sl")
def q03_slope_deg(spark, sf):
    return rounded(terrain.slope_deg(T.grid(spark, sf), T.CELL).select("r", "c", "slope"), "slope")


@query(f"WITH {SLOPE} SELECT CASE WHEN slope < 3 THEN '0-3' WHEN slope < 8 THEN '3-8' WHEN slope < 13 THEN '8-13' WHEN slope < 18 THEN '13-18' WHEN slope < 25 THEN '18-25' ELSE 'over 25' END AS class, count(*)::BIGINT AS cells, count(*) * 25e0 AS area_m2 FROM sl GROUP BY 1")
def q04_slope_class_area(spark, sf):
    return terrain.slope_deg(T.grid(spark, sf), T.CELL).groupBy(H.slope_class("slope").alias("class")).agg(F.count("*").alias("cells"), (F.count("*") * AREA).alias("area_m2"))


def _mirror(k: int, src: str, by: str, order: str, value: str, out: str) -> str:
    other = "r" if order == "c" else "c"
    return f"""(SELECT {by}, {order}, {out} FROM (SELECT {by}, {order}, avg(v) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS {out} FROM (
  SELECT {other}, {order}, {value} AS v FROM {src} UNION ALL SELECT {other}, -1 - {order}, {value} FROM {src} WHERE {order} < {k}
  UNION ALL SELECT {other}, 2 * n - 1 - {order}, {value} FROM {src}, n WHERE {order} >= n - {k})) WHERE {order} >= 0 AND {order} < (SELECT n FROM n))"""


@query(f"WITH {_grid_sql(T.SMOOTH).replace(', n FROM orders', ' FROM orders')}, a AS {_mirror(7, 'g', 'r', 'c', 'z', 'm')}, b AS {_mirror(7, 'a', 'c', 'r', 'm', 'mean')} SELECT g.r, g.c, round(mean, 4) AS mean, round(z - mean, 4) AS tpi FROM g JOIN b ON b.r = g.r AND b.c = g.c")
def q05_position_index(spark, sf):
    out = terrain.box_mean(T.grid(spark, sf), T.side(spark, sf), 7, "z", "mean")
    return rounded(out.select("r", "c", "mean", (F.col("z") - F.col("mean")).alias("tpi")), "mean", "tpi", digits=4)


@query(f"WITH {DIRS} SELECT r, c, dir, to_r, to_c FROM d8")
def q06_d8_direction(spark, sf):
    return terrain.d8(T.grid(spark, sf), T.CELL).select("r", "c", "dir", "to_r", "to_c")


def _cells(df: DataFrame, n: int) -> DataFrame:
    return df.withColumns({"r": F.floor(F.col("id") / n).cast("int"), "c": (F.col("id") % n).cast("int")}).drop("id")


def _counted(spark, sf) -> DataFrame:
    n = T.side(spark, sf)
    return _cells(terrain.accumulate(terrain.d8(T.grid(spark, sf), T.CELL), n, {"acc": F.lit(1.0)}), n)


@query(WALK + " SELECT r, c, count(*)::BIGINT AS acc FROM walk GROUP BY r, c")
def q07_flow_accumulation(spark, sf):
    return _counted(spark, sf).select("r", "c", F.col("acc").cast("long").alias("acc"))


@query(WALK + f" SELECT r, c, round(sum({_q('65e0', 'cn')} / 1e3 * 25e0), 4) AS volume_m3 FROM walk GROUP BY r, c")
def q08_weighted_accumulation(spark, sf):
    n = T.side(spark, sf)
    out = terrain.accumulate(terrain.d8(T.grid(spark, sf), T.CELL), n, {"volume_m3": H.volume_m3(H.runoff_mm(65.0, "cn"), AREA)})
    return rounded(_cells(out, n), "volume_m3", digits=4)


@query(WALK + ", a AS (SELECT r, c, count(*)::BIGINT AS acc FROM walk GROUP BY r, c) SELECT CASE WHEN acc * 25 / 1e4 < 5e-1 THEN 'rills' WHEN acc * 25 / 1e4 < 5 THEN 'ephemeral' WHEN acc * 25 / 1e4 < 20 THEN 'permanent' ELSE 'river' END AS class, count(*)::BIGINT AS cells, max(acc) AS most FROM a WHERE acc > 40 GROUP BY 1")
def q09_stream_network(spark, sf):
    acc = F.col("acc").cast("long")
    return _counted(spark, sf).where(acc > 40).groupBy(H.channel_class(acc * AREA / 10000).alias("class")).agg(F.count("*").alias("cells"), F.max(acc).alias("most"))


_ADJ = "greatest(1e0, least(1e2, CASE c_custkey % 3 WHEN 0 THEN 42e-1 * cn / (1e1 - 58e-3 * cn) WHEN 1 THEN cn::DOUBLE ELSE 23e0 * cn / (1e1 + 13e-2 * cn) END))"


@query(f"WITH a AS (SELECT c_custkey, 1e1 + c_custkey % 90 AS p, 40 + c_custkey % 60 AS cn FROM customer), b AS (SELECT c_custkey, p, {_ADJ} AS cn FROM a) SELECT c_custkey, round(cn, 6) AS cn, round({_q('p', 'cn')}, 6) AS runoff_mm, round({_q('p', 'cn')} / p, 6) AS ratio, round({_q('p', 'cn')} / 1e3 * 5e3, 6) AS volume_m3 FROM b")
def q10_scs_runoff(spark, sf):
    k = F.col("c_custkey")
    moisture = F.when(k % 3 == 0, "dry").when(k % 3 == 1, "normal").otherwise("wet")
    a = T.table(spark, sf, "customer").select(k, (10.0 + k % 90).alias("p"), H.adjust_cn(40 + k % 60, moisture).alias("cn"))
    out = a.select(k, "cn", H.runoff_mm("p", "cn").alias("runoff_mm"), H.runoff_ratio("p", "cn").alias("ratio"), H.volume_m3(H.runoff_mm("p", "cn"), 5000.0).alias("volume_m3"))
    return rounded(out, "cn", "runoff_mm", "ratio", "volume_m3")


@query(f"WITH {GRID} SELECT cn, count(*)::BIGINT AS cells, round(avg({_q('65e0', 'cn')}), 6) AS runoff_mm, round(sum({_q('65e0', 'cn')} / 1e3 * 25e0), 4) AS volume_m3 FROM g GROUP BY cn")
def q11_runoff_zonal(spark, sf):
    q = H.runoff_mm(65.0, "cn")
    out = T.grid(spark, sf).groupBy("cn").agg(F.count("*").alias("cells"), F.avg(q).alias("runoff_mm"), F.sum(H.volume_m3(q, AREA)).alias("volume_m3"))
    return rounded(rounded(out, "runoff_mm"), "volume_m3", digits=4)


@query(f"WITH {RAIN} SELECT time_min::INT AS time_min, round(cum_mm, 6) AS cum_mm FROM hy")
def q12_hyetograph(spark, sf):
    return rounded(T.hyetograph(T.daily_rain(spark, sf)), "cum_mm")


def _increments(spark, sf) -> DataFrame:
    """(time_min, cn, mm): the runoff each step adds on each curve number, each day a storm of its own; a few classes by the hours."""
    cns = T.grid(spark, sf).select("cn").distinct()
    storm = Window.partitionBy("day").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    depths = T.daily_rain(spark, sf).withColumn("cum_mm", F.sum("mm").over(storm)).select("day", "time_min", "cum_mm")
    each = depths.join(F.broadcast(cns), F.lit(True)).withColumn("q", H.runoff_mm("cum_mm", "cn"))
    return each.withColumn("mm", F.greatest(F.lit(0.0), F.col("q") - F.lag("q", 1, 0.0).over(Window.partitionBy("day", "cn").orderBy("time_min")))).select("time_min", "cn", "mm")


_INC = f"{GRID}, {RAIN}, z AS (SELECT cn, count(*) AS k FROM g GROUP BY cn), i AS (SELECT time_min, cn, k, q - lag(q, 1, 0e0) OVER (PARTITION BY day, cn ORDER BY time_min) AS mm FROM (SELECT *, {_q('cum_mm', 'cn')} AS q FROM storm, z))"


@query(f"WITH {_INC} SELECT time_min::INT AS time_min, cn, round(greatest(0e0, mm), 6) AS mm FROM i")
def q13_incremental_runoff(spark, sf):
    return rounded(_increments(spark, sf), "mm")


@query(f"WITH {RAIN} SELECT day, (60 * i)::INT AS time_min, round(d.mm * (60 * i) / 72e1, 6) AS cum_mm FROM (SELECT day, sum(mm) AS mm FROM rain GROUP BY day) d, (SELECT unnest(range(13)) AS i)")
def q14_uniform_storm(spark, sf):
    """Each day's rain as a uniform storm of twelve hours."""
    days = T.daily_rain(spark, sf).groupBy("day").agg(F.sum("mm").alias("rain_mm"))
    return rounded(T.uniform_storms(days, 12, 60), "cum_mm")


FILL = "WITH RECURSIVE " + ROUGH + """,
f(r, c, w) USING KEY (r, c) AS (
  SELECT r, c, CASE WHEN r = 0 OR c = 0 OR r = n - 1 OR c = n - 1 THEN z ELSE 1e9 END FROM g
  UNION SELECT g.r, g.c, greatest(g.z, min(o.w)) FROM f JOIN g ON abs(g.r - f.r) <= 1 AND abs(g.c - f.c) <= 1 AND g.r > 0 AND g.c > 0 AND g.r < g.n - 1 AND g.c < g.n - 1
    JOIN recurring.f o ON o.r BETWEEN g.r - 1 AND g.r + 1 AND o.c BETWEEN g.c - 1 AND g.c + 1 JOIN recurring.f own ON own.r = g.r AND own.c = g.c
  GROUP BY g.r, g.c, g.z, own.w HAVING greatest(g.z, min(o.w)) < own.w)"""


def _filled(spark, sf) -> DataFrame:
    return terrain.fill_depressions(T.grid(spark, sf, T.ROUGH), T.side(spark, sf))


@query(FILL + " SELECT g.r, g.c, round(greatest(0e0, w - z), 6) AS depth FROM f JOIN g ON g.r = f.r AND g.c = f.c")
def q15_ponding_depth(spark, sf):
    return rounded(_filled(spark, sf).select("r", "c", F.greatest(F.lit(0.0), F.col("w") - F.col("z")).alias("depth")), "depth")


def _ponds(spark, sf) -> DataFrame:
    """(r, c, depth, zone) of wet cells."""
    wet = T.written(_filled(spark, sf).withColumn("depth", F.col("w") - F.col("z")).where(F.col("depth") >= H.POND_FLOOR).select("r", "c", "depth"))
    return wet.join(terrain.components(wet, T.side(spark, sf)), ["r", "c"])


PONDS = FILL + """,
wet AS (SELECT g.r, g.c, f.w - g.z AS depth, (g.r::BIGINT * g.n + g.c) AS id FROM f JOIN g ON g.r = f.r AND g.c = f.c WHERE f.w - g.z >= 1e-3),
lb(r, c, zone) USING KEY (r, c) AS (
  SELECT r, c, id FROM wet
  UNION SELECT w.r, w.c, min(o.zone) FROM lb JOIN wet w ON abs(w.r - lb.r) <= 1 AND abs(w.c - lb.c) <= 1
    JOIN recurring.lb o ON o.r BETWEEN w.r - 1 AND w.r + 1 AND o.c BETWEEN w.c - 1 AND w.c + 1 JOIN recurring.lb own ON own.r = w.r AND own.c = w.c
  GROUP BY w.r, w.c, own.zone HAVING min(o.zone) < own.zone),
pz AS (SELECT wet.r, wet.c, depth, zone FROM wet JOIN lb ON lb.r = wet.r AND lb.c = wet.c)"""


@query(PONDS + " SELECT zone, count(*)::BIGINT AS cells, count(*) * 25e0 AS area_m2, round(sum(depth * 25), 6) AS volume_m3, round(avg(depth), 6) AS mean_depth FROM pz GROUP BY zone")
def q16_pond_zones(spark, sf):
    out = _ponds(spark, sf).groupBy("zone").agg(F.count("*").alias("cells"), (F.count("*") * AREA).alias("area_m2"), F.sum(F.col("depth") * AREA).alias("volume_m3"), F.avg("depth").alias("mean_depth"))
    return rounded(out, "volume_m3", "mean_depth")


@query(PONDS + " SELECT count(*)::BIGINT AS cells, count(*) * 25e0 AS area_m2, round(sum(depth * 25), 6) AS volume_m3 FROM pz WHERE zone = (SELECT zone FROM pz ORDER BY depth DESC, r, c LIMIT 1)")
def q17_pond_query(spark, sf):
    """The pond at the deepest wet cell, as a click there would find it."""
    ponds = T.written(_ponds(spark, sf))
    deepest = ponds.agg(F.max_by("zone", F.struct("depth", -F.col("r"), -F.col("c"))).alias("zone"))
    out = ponds.join(F.broadcast(deepest), "zone").agg(F.count("*").alias("cells"), (F.count("*") * AREA).alias("area_m2"), F.sum(F.col("depth") * AREA).alias("volume_m3"))
    return rounded(out, "volume_m3")


@query("WITH RECURSIVE " + GRID + ", up AS (SELECT r, c, z FROM g WHERE r = n - 1 AND c BETWEEN n // 2 - 5 AND n // 2 + 5 UNION SELECT b.r, b.c, b.z FROM up JOIN g b ON abs(b.r - up.r) <= 1 AND abs(b.c - up.c) <= 1 AND b.z >= up.z) SELECT count(*)::BIGINT AS cells, count(*) * 25 / 1e4 AS area_ha FROM (SELECT DISTINCT r, c FROM up)")
def q18_uphill_area(spark, sf):
    n = T.side(spark, sf)
    start = (F.col("r") == n - 1) & F.col("c").between(n // 2 - 5, n // 2 + 5)
    out = terrain.uphill(T.grid(spark, sf), start, F.lit(False)).where("w >= 0.5")
    return out.agg(F.count("*").alias("cells"), (F.count("*") * AREA / 10000).alias("area_ha"))


def _outlets(spark, n: int) -> DataFrame:
    """Five cells down the valley."""
    return spark.range(1, 6).select((F.floor(F.col("id") * n / 6).cast("long") * n + n // 2).alias("id"))


_BEAR = "CASE dir WHEN 64 THEN 0 WHEN 128 THEN 45 WHEN 1 THEN 90 WHEN 2 THEN 135 WHEN 4 THEN 180 WHEN 8 THEN 225 WHEN 16 THEN 270 WHEN 32 THEN 315 END"


@query("WITH RECURSIVE " + DIRS + f""", o AS (SELECT (i * n // 6)::INT AS r, (n // 2)::INT AS c FROM n, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
own AS (SELECT r AS sr, c AS sc, r, c, dir FROM d8 UNION ALL SELECT w.sr, w.sc, d.to_r, d.to_c, w.dir FROM own w JOIN d8 d ON d.r = w.r AND d.c = w.c WHERE d.to_r IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o.r = w.r AND o.c = w.c)),
walk AS (SELECT r, c FROM d8 UNION ALL SELECT d.to_r, d.to_c FROM walk w JOIN d8 d ON d.r = w.r AND d.c = w.c WHERE d.to_r IS NOT NULL),
ac AS (SELECT r AS ar, c AS ac, count(*) AS acc FROM walk GROUP BY r, c),
hit AS (SELECT own.*, acc, coalesce({_BEAR}, 0) AS b FROM own JOIN o ON o.r = own.r AND o.c = own.c JOIN ac ON ar = sr AND ac.ac = sc)
SELECT r::BIGINT * (SELECT n FROM n) + c AS outlet, count(*)::BIGINT AS cells, count(*) * 25e0 AS area_m2,
  round(((degrees(atan2(round(sum(acc * sin(radians(b))), 6), round(sum(acc * cos(radians(b))), 6))) + 360)::DOUBLE) % 360, 4) AS bearing FROM hit GROUP BY r, c""")
def q19_catchments(spark, sf):
    n = T.side(spark, sf)
    flow = T.written(terrain.d8(T.grid(spark, sf), T.CELL).select("r", "c", "dir", "to_r", "to_c"))
    own = terrain.first_outlet(flow, n, _outlets(spark, n))
    code = F.create_map(*[F.lit(x) for k, v in ((64, 0.0), (128, 45.0), (1, 90.0), (2, 135.0), (4, 180.0), (8, 225.0), (16, 270.0), (32, 315.0)) for x in (k, v)])
    bearing = F.radians(F.coalesce(F.try_element_at(code, F.col("dir")), F.lit(0.0)))
    # a cell's direction counts as much as what flows through it
    acc = terrain.accumulate(flow, n, {"acc": F.lit(1.0)})
    cells = flow.select((F.col("r").cast("long") * n + F.col("c")).alias("id"), bearing.alias("b")).hint("merge").join(own, "id").join(acc, "id")
    east, north = F.round(F.sum(F.col("acc") * F.sin("b")), 6), F.round(F.sum(F.col("acc") * F.cos("b")), 6)
    out = cells.groupBy("outlet").agg(F.count("*").alias("cells"), (F.count("*") * AREA).alias("area_m2"), F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0)).alias("bearing"))
    return rounded(out, "bearing", digits=4)


_EXITS = WALK + """, a AS (SELECT r, c, count(*)::BIGINT AS acc FROM walk GROUP BY r, c),
e AS (SELECT a.r, a.c, acc, row_number() OVER (ORDER BY acc DESC, a.r, a.c) AS k FROM a, n WHERE acc > 2 AND (a.r = 0 OR a.c = 0 OR a.r = n - 1 OR a.c = n - 1)),
pick AS (SELECT r, c, acc, k, [{'r': r, 'c': c}] AS kept, true AS ok FROM e WHERE k = 1 UNION ALL
  SELECT e.r, e.c, e.acc, e.k, CASE WHEN far THEN list_append(kept, {'r': e.r, 'c': e.c}) ELSE kept END, far FROM
  (SELECT e.*, kept, len(list_filter(kept, lambda x: power(x.r - e.r, 2) + power(x.c - e.c, 2) < 400)) = 0 AS far FROM pick JOIN e ON e.k = pick.k + 1) e)"""


@query(_EXITS + """, v AS (SELECT r, c, acc, acc * 25e0 * 3e-2 AS vol FROM pick WHERE ok)
SELECT row_number() OVER (ORDER BY acc DESC, r, c)::INT AS rank, r, c, acc, round(vol, 6) AS volume_m3, round(vol * 1e3 / 86400e0, 6) AS flow_ls FROM v""")
def q20_exits(spark, sf):
    """Where water leaves the site: cells of its boundary with more flow than the threshold, 20 cells apart, with the event's volume and mean flow."""
    n = T.side(spark, sf)
    edge = _counted(spark, sf).where((F.col("acc") > 2) & ((F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == n - 1) | (F.col("c") == n - 1)))
    kept = vector.all_apart(edge, "acc", 20.0)
    volume = F.col("acc") * AREA * 0.03
    order = Window.orderBy(F.desc("acc"), "r", "c")  # exits 20 cells apart on a boundary: few
    out = kept.select(F.row_number().over(order).alias("rank"), "r", "c", F.col("acc").cast("long").alias("acc"), volume.alias("volume_m3"), (volume * 1000 / 86400).alias("flow_ls"))
    return rounded(out, "volume_m3", "flow_ls")


@query(f"WITH {GRID}, q AS (SELECT a.r, a.c, least(a.z, b.z, d.z, e.z) AS lo, greatest(a.z, b.z, d.z, e.z) AS hi FROM g a JOIN g b ON b.r = a.r AND b.c = a.c + 1 JOIN g d ON d.r = a.r + 1 AND d.c = a.c JOIN g e ON e.r = a.r + 1 AND e.c = a.c + 1) SELECT l::BIGINT AS level, count(*)::BIGINT AS quads FROM (SELECT unnest(range(ceil(lo)::BIGINT, ceil(hi)::BIGINT)) AS l FROM q) GROUP BY l")
def q21_contour_crossings(spark, sf):
    return vector.contour_quads(T.grid(spark, sf), 1.0).groupBy(F.col("level").cast("long").alias("level")).agg(F.count("*").alias("quads"))


_LINES = "ln AS (SELECT n_nationkey AS id, 5e0 * n * (1 + n_nationkey % 5) / 7 AS x0, 5e0 * n * (1 + n_nationkey // 5) / 7 AS y0, 5e0 * n * (1 + n_nationkey % 5) / 7 + 6e1 AS x1, 5e0 * n * (1 + n_nationkey // 5) / 7 + 2e1 AS y1 FROM nation, n)"
_SAMPLES = "sm AS (SELECT id, i, floor((x0 + (x1 - x0) * i / 19e0) / 5)::INT AS c, floor((5e0 * n - (y0 + (y1 - y0) * i / 19e0)) / 5)::INT AS r FROM ln, n, (SELECT unnest(range(20)) AS i))"


def _lines(spark, sf) -> DataFrame:
    """Drawn lines, one per nation."""
    n, k = T.side(spark, sf), F.col("n_nationkey")
    x, y = 5.0 * n * (1 + k % 5) / 7, 5.0 * n * (1 + F.floor(k / 5)) / 7
    return T.table(spark, sf, "nation").select(k.alias("id"), x.alias("x0"), y.alias("y0"), (x + 60.0).alias("x1"), (y + 20.0).alias("y1"))


@query(WALK + ", " + SLOPE[len(GRID) + 2 :] + f""", a AS (SELECT r, c, count(*)::BIGINT AS acc FROM walk GROUP BY r, c), {_LINES}, {_SAMPLES},
k AS (SELECT id, coalesce(max(acc), 0)::BIGINT AS peak_acc, coalesce(avg(slope), 0e0) AS mean_slope FROM sm LEFT JOIN a ON a.r = sm.r AND a.c = sm.c LEFT JOIN sl ON sl.r = sm.r AND sl.c = sm.c GROUP BY id)
SELECT id, peak_acc, round(mean_slope, 6) AS mean_slope, row_number() OVER (ORDER BY peak_acc DESC, id)::INT AS rank FROM k WHERE mean_slope <= 18""")
def q22_contour_rank(spark, sf):
    n = T.side(spark, sf)
    g = T.grid(spark, sf)
    cells = vector.sample_lines(_lines(spark, sf), 20, n, T.CELL)
    at = cells.join(_counted(spark, sf), ["r", "c"], "left").join(terrain.slope_deg(g, T.CELL).select("r", "c", "slope"), ["r", "c"], "left")
    out = at.groupBy("id").agg(F.coalesce(F.max("acc"), F.lit(0.0)).cast("long").alias("peak_acc"), F.coalesce(F.avg("slope"), F.lit(0.0)).alias("mean_slope")).where("mean_slope <= 18")
    return rounded(vector.global_rank(out, "rank", F.desc("peak_acc"), "id"), "mean_slope")


#: Lines across the grid, a sample a cell.
_PROFILE = WALK + """, a AS (SELECT r, c, count(*)::BIGINT AS acc FROM walk GROUP BY r, c),
ln AS (SELECT n_nationkey AS id, 5e0 * n * (n_nationkey % 5) / 12 + 3 AS x0, 5e0 * n * (1 + n_nationkey // 5) / 7 AS y0, 2e0 * n AS dx, 2e1 AS dy, n FROM nation, n),
le AS (SELECT *, sqrt(dx * dx + dy * dy) AS len, greatest(2, floor(sqrt(dx * dx + dy * dy) / 5)::INT) AS steps FROM ln),
sm AS (SELECT id, len, i, len * i / (steps - 1) AS d, floor((x0 + dx * i / (steps - 1)) / 5)::INT AS c, floor((5e0 * n - (y0 + dy * i / (steps - 1))) / 5)::INT AS r FROM le, (SELECT unnest(range(10000))::INT AS i) WHERE i < steps),
pf AS (SELECT id, len, i, d, coalesce(acc, 0)::DOUBLE AS acc FROM sm LEFT JOIN a ON a.r = sm.r AND a.c = sm.c),
hi AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM (SELECT *, max(acc) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM pf) WHERE acc >= 3 AND acc >= m),
gr AS (SELECT id, k, i, i AS last, true AS ok FROM hi WHERE k = 1 UNION ALL SELECT hi.id, hi.k, hi.i, CASE WHEN hi.i >= last + 10 THEN hi.i ELSE last END, hi.i >= last + 10 FROM gr JOIN hi ON hi.id = gr.id AND hi.k = gr.k + 1),
pk AS (SELECT hi.id, hi.len, hi.i, hi.d, hi.acc FROM gr JOIN hi ON hi.id = gr.id AND hi.k = gr.k WHERE ok QUALIFY row_number() OVER (PARTITION BY hi.id ORDER BY hi.acc DESC, hi.i) <= 3)"""


def _profiles(spark, sf) -> DataFrame:
    n, k = T.side(spark, sf), F.col("n_nationkey")
    x, y = 5.0 * n * (k % 5) / 12 + 3, 5.0 * n * (1 + F.floor(k / 5)) / 7
    lines = T.table(spark, sf, "nation").select(k.alias("id"), G.line((x, y), (x + 2.0 * n, y + 20.0)).alias("pts"))
    return T.written(vector.profile(lines, _counted(spark, sf), n, T.CELL))


@query(_PROFILE + """, se AS (SELECT *, acc * 25 * 3e-2 AS inflow_m3, greatest(1e0, acc * 25 * 3e-2 / (3e-1 * 6e-1)) AS need FROM pk),
ab AS (SELECT *, greatest(0e0, d - need / 2) AS a0, least(len, d + need / 2) AS b0 FROM se),
sf AS (SELECT *, CASE WHEN a0 = 0 THEN a0 ELSE greatest(0e0, a0 - greatest(0e0, need - (b0 - a0))) END AS a1, CASE WHEN a0 = 0 THEN least(len, b0 + greatest(0e0, need - (b0 - a0))) ELSE b0 END AS b1 FROM ab)
SELECT id, i AS place, acc, round(acc * 25 / 1e4, 6) AS contributing_ha, round(inflow_m3, 6) AS inflow_m3, round(need, 6) AS required_m, round(a1, 6) AS seg_start, round(b1, 6) AS seg_end, row_number() OVER (ORDER BY acc DESC, id, i)::INT AS rank FROM sf WHERE b1 - a1 >= 1""")
def q23_swale_segments(spark, sf):
    """Where lines cross streams, the stretch that holds what comes down."""
    found = vector.peaks(_profiles(spark, sf), 3)
    out = vector.sized_segments(found, F.col("acc") * AREA * 0.03, 0.3 * 0.6)
    out = vector.global_rank(out.select("id", F.col("i").alias("place"), "acc", (F.col("acc") * AREA / 10000).alias("contributing_ha"), "inflow_m3", "required_m", "seg_start", "seg_end"), "rank", F.desc("acc"), "id", "place")
    return rounded(out, "contributing_ha", "inflow_m3", "required_m", "seg_start", "seg_end")


@query(_PROFILE + """, lo AS (SELECT pk.id, pk.i, max(CASE WHEN p.i < pk.i THEN p.i END) AS a, min(CASE WHEN p.i > pk.i THEN p.i END) AS b FROM pk JOIN pf p ON p.id = pk.id AND p.acc < pk.acc * 5e-1 GROUP BY pk.id, pk.i),
sp AS (SELECT pk.*, coalesce(a + 1, 0) AS a, coalesce(b - 1, (SELECT max(i) FROM pf WHERE pf.id = pk.id)) AS b FROM pk LEFT JOIN lo ON lo.id = pk.id AND lo.i = pk.i)
SELECT sp.id, sp.i AS place, sp.acc, round(x.d, 6) AS seg_start, round(y.d, 6) AS seg_end, round(y.d - x.d, 6) AS length_m FROM sp JOIN pf x ON x.id = sp.id AND x.i = sp.a JOIN pf y ON y.id = sp.id AND y.i = sp.b WHERE y.d - x.d >= 1""")
def q47_walked_segments(spark, sf):
    """Without a runoff depth: the stretch around each peak on which flow stays above half of it."""
    profiles = _profiles(spark, sf)
    out = vector.walked_segments(T.written(vector.peaks(profiles, 3)), profiles, 0.5)
    return rounded(out.select("id", F.col("i").alias("place"), "acc", "seg_start", "seg_end", "length_m"), "seg_start", "seg_end", "length_m")


_WORKS = "w AS (SELECT p_partkey, ['swale', 'berm', 'basin', 'dam', 'diversion'][p_partkey % 5 + 1] AS kind, p_size / 1e1 AS d, 1 + p_size % 7 / 2e0 AS w, p_retailprice / 1e1 AS l, p_retailprice / 5e0 AS a, p_partkey % 2 = 0 AS comp, (1 + p_partkey % 4)::DOUBLE AS g FROM part), x AS (SELECT *, (greatest(1e-1, w - 2 * d) + w + 2 * d) / 2 * d AS cs, (greatest(5e-2, w - 2 * d) + w + 2 * d) / 2 * d AS cs5, greatest(5e-2, w - 2 * d) AS bw FROM w)"


@query(f"WITH {_WORKS} SELECT p_partkey, kind, round(CASE kind WHEN 'swale' THEN (cs + CASE WHEN comp THEN sqrt(75e-2 * cs) * (w + 2 * d) / 2 ELSE 0e0 END) * l * 8e-1 WHEN 'basin' THEN a * d * 8e-1 ELSE 0e0 END, 9) AS capacity_m3, round(CASE kind WHEN 'swale' THEN cs * l WHEN 'basin' THEN a * d WHEN 'diversion' THEN cs5 * l ELSE 0e0 END, 9) AS cut_m3, round(CASE WHEN kind = 'berm' THEN d * d * l WHEN kind = 'swale' AND comp THEN 75e-2 * cs * l WHEN kind = 'dam' THEN w * d * l ELSE 0e0 END, 9) AS fill_m3, round(sqrt(75e-2 * cs), 9) AS berm_m FROM x")
def q24_earthwork_volumes(spark, sf):
    out = T.works(spark, sf).select(
        "p_partkey", "kind", H.capacity_m3("kind", "depth", "width", "length", "area", "companion").alias("capacity_m3"), H.cut_m3("kind", "depth", "width", "length", "area").alias("cut_m3"),
        H.fill_m3("kind", "depth", "width", "length", "companion").alias("fill_m3"), H.berm_height("depth", "width").alias("berm_m"),
    )
    return rounded(out, "capacity_m3", "cut_m3", "fill_m3", "berm_m", digits=9)


@query(f"WITH {_WORKS}, y AS (SELECT *, cs5 * power(cs5 / (bw + 2 * sqrt(2e0) * d), 2e0 / 3e0) * sqrt(g / 1e2) / 25e-3 AS q FROM x) SELECT p_partkey, round(q, 6) AS discharge, round(q / (17e-1 * power(3e-1, 15e-1)), 6) AS spillway_m, round(l / (d * w * 8e-1), 6) AS swale_m, round(l / (d * w), 6) AS drawn_m FROM y")
def q25_hydraulics(spark, sf):
    q = H.manning_m3s("depth", "width", "gradient")
    out = T.works(spark, sf).select("p_partkey", q.alias("discharge"), H.spillway_m(q, 0.3).alias("spillway_m"), H.swale_length_m("length", "depth", "width").alias("swale_m"), H.swale_length_m("length", "depth", "width", 1.0).alias("drawn_m"))
    return rounded(out, "discharge", "spillway_m", "swale_m", "drawn_m")


_X, _Y = "(c + 5e-1) * 5", "(n - r - 5e-1) * 5"
_SEG = f"sqrt(power(greatest(greatest(1e2 - {_X}, {_X} - 15e1), 0e0), 2) + power({_Y} - yy, 2))"


@query(f"""WITH {GRID}, k AS (SELECT *, {_X} AS x, {_Y} AS y FROM g),
a AS (SELECT *, CASE WHEN sqrt(power(greatest(greatest(3e1 - x, x - 9e1), 0e0), 2) + power(y - 62e0, 2)) <= 6e0 THEN z - 5e-1 ELSE z END AS z1 FROM k),
b AS (SELECT *, CASE WHEN x BETWEEN 11e1 AND 15e1 AND y BETWEEN 31e0 AND 59e0 THEN z1 - 1e0 ELSE z1 END AS z2 FROM a),
d AS (SELECT *, CASE WHEN sqrt(power(greatest(greatest(2e1 - y, y - 12e1), 0e0), 2) + power(x - 81e0, 2)) <= 4e0 THEN greatest(z2, 198e0) ELSE z2 END AS z3 FROM b)
SELECT r, c, round(z3, 6) AS z FROM d""")
def q26_burn_works(spark, sf):
    """A swale, a basin and a dam, one after the other."""
    g = vector.with_centres(T.grid(spark, sf), T.side(spark, sf), T.CELL)
    plan = [("swale", [(30.0, 62.0), (90.0, 62.0)], 0.5, 12.0, None), ("basin", [(110.0, 31.0), (150.0, 31.0), (150.0, 59.0), (110.0, 59.0)], 1.0, 0.0, None), ("dam", [(81.0, 20.0), (81.0, 120.0)], 2.0, 8.0, 198.0)]
    return rounded(vector.burn(g, plan).select("r", "c", "z"), "z")


@query(f"""WITH {GRID}, k AS (SELECT *, {_X} AS x, {_Y} AS y FROM g), s0 AS (SELECT z AS z0 FROM k, n WHERE r = floor((5e0 * n.n - 101e0) / 5) AND c = 6),
sg(x0, y0, x1, y1, before, len, steps) AS (VALUES (31e0, 101e0, 91e0, 101e0, 0e0, 6e1, 36), (91e0, 101e0, 121e0, 141e0, 6e1, 5e1, 30)),
sp AS (SELECT x0 + i / steps::DOUBLE * (x1 - x0) AS px, y0 + i / steps::DOUBLE * (y1 - y0) AS py, before + i / steps::DOUBLE * len AS d FROM sg, (SELECT unnest(range(37)) AS i) WHERE i <= steps),
m AS (SELECT r, c, min(z0 - d * 1e-2 - 5e-1) AS f FROM k, s0, sp WHERE sqrt(power(x - px, 2) + power(y - py, 2)) <= 3e0 GROUP BY r, c)
SELECT k.r, k.c, round(least(z, coalesce(f, z)), 6) AS z FROM k LEFT JOIN m ON m.r = k.r AND m.c = k.c""")
def q27_burn_diversion(spark, sf):
    """A drain of two segments."""
    n = T.side(spark, sf)
    g = vector.with_centres(T.grid(spark, sf), n, T.CELL)
    return rounded(vector.burn_diversion(g, [(31.0, 101.0), (91.0, 101.0), (121.0, 141.0)], 0.5, 6.0, 1.0, n, T.CELL).select("r", "c", "z"), "z")


@query("WITH l AS (SELECT s_nationkey, s_acctbal, min(s_name) AS f FROM supplier GROUP BY 1, 2), m AS (SELECT s_nationkey, s_acctbal, lag(f) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS receiver FROM l) SELECT s_nationkey AS site, s_name AS name, s_acctbal AS elevation, receiver FROM supplier JOIN m USING (s_nationkey, s_acctbal)")
def q28_receivers(spark, sf):
    return cascade.receivers(T.stores(spark, sf)).select("site", "name", "elevation", "receiver")


def _simulated(spark, sf) -> DataFrame:
    """Over all days of rain: the runoff of each is that of a storm of its own, the stores keep what they hold.

    As the SQL has it, stores of one height pass their water on in the order of their names.
    """
    storm = Window.partitionBy("day").orderBy("hour")
    q = T.daily_rain(spark, sf).withColumn("q", H.runoff_mm(F.sum("mm").over(storm.rowsBetween(Window.unboundedPreceding, 0)), F.lit(70)))
    hours = (F.col("time_min") - F.lag("time_min", 1, 0).over(Window.orderBy("time_min"))) / 60.0  # a row an hour: few
    feed = q.select("time_min", hours.alias("hours"), F.greatest(F.lit(0.0), F.col("q") - F.lag("q", 1, 0.0).over(storm)).alias("mm"))
    return cascade.simulate(T.stores(spark, sf), feed, by_name=True)


#: Every site's stores from the highest down, a step at a time: what one spills comes to the next in the same step.
_FOLD = """list_reduce(list_zip(ss, s), lambda acc, x: list_append(acc, {'inflow': {inflow}, 'loss': least(x[1].loss, x[2].stored + {inflow} + coalesce(acc[-1].over, 0e0)),
    'stored': least(x[1].cap, greatest(0e0, x[2].stored + {inflow} + coalesce(acc[-1].over, 0e0) - x[1].loss)), 'over': greatest(0e0, x[2].stored + {inflow} + coalesce(acc[-1].over, 0e0) - x[1].loss - x[1].cap)}),
    []::STRUCT(inflow DOUBLE, loss DOUBLE, stored DOUBLE, over DOUBLE)[])"""
_NONE = "list_transform(ss, lambda x: {'inflow': 0e0, 'loss': 0e0, 'stored': 0e0, 'over': 0e0})"
_SIM = f"""WITH RECURSIVE {RAIN},
qs AS (SELECT day, time_min, {_q('cum_mm', '7e1')} AS q FROM storm), fe AS (SELECT time_min, greatest(0e0, q - lag(q, 1, 0e0) OVER (PARTITION BY day ORDER BY time_min)) AS mm, row_number() OVER (ORDER BY time_min) AS t FROM qs),
si AS (SELECT s_nationkey AS site, list({{'cap': 50e0 + s_suppkey % 50, 'loss': 4e0 / 1e3 * (1e3 + 1e2 * s_nationkey), 'up': (1e3 + 1e2 * s_nationkey) * (1 + s_suppkey % 3) / 1e3}} ORDER BY s_acctbal DESC, s_name) AS ss, list(s_name ORDER BY s_acctbal DESC, s_name) AS names FROM supplier GROUP BY 1),
sim AS (SELECT site, 0::BIGINT AS t, {_NONE} AS s FROM si UNION ALL SELECT sim.site, sim.t + 1, {_FOLD.replace('{inflow}', 'mm * x[1].up')} FROM sim JOIN si ON si.site = sim.site JOIN fe ON fe.t = sim.t + 1),
ou AS (SELECT sim.site, time_min, unnest(names) AS name, unnest(s) AS v, unnest(list_transform(ss, lambda x: x.cap)) AS cap, unnest(range(1, len(names) + 1)) = len(names) AS last FROM sim JOIN si ON si.site = sim.site JOIN fe ON fe.t = sim.t),
st AS (SELECT site, time_min, name, v.inflow AS inflow, v.loss AS infiltration, v.stored AS stored, v.over AS overflow, CASE WHEN last THEN v.over ELSE 0e0 END AS exit, 100 * v.stored / cap AS fill_pct, min(CASE WHEN v.over > 0 THEN time_min / 6e1 END) OVER (PARTITION BY site, name ORDER BY time_min) AS first_overflow_hr FROM ou)"""


@query(_SIM + " SELECT site, time_min, name, round(inflow, 6) AS inflow, round(infiltration, 6) AS infiltration, round(stored, 6) AS stored, round(overflow, 6) AS overflow, round(exit, 6) AS exit, round(fill_pct, 6) AS fill_pct, round(first_overflow_hr, 6) AS first_overflow_hr FROM st")
def q29_storm_simulation(spark, sf):
    return rounded(_simulated(spark, sf), "inflow", "infiltration", "stored", "overflow", "exit", "fill_pct", "first_overflow_hr")


@query(_SIM + " SELECT site, name, round(sum(inflow), 6) AS inflow, round(sum(infiltration), 6) AS infiltration, round(sum(overflow), 6) AS overflow, round(max(fill_pct), 6) AS peak_fill_pct, round(min(first_overflow_hr), 6) AS first_overflow_hr FROM st GROUP BY site, name")
def q30_store_summary(spark, sf):
    out = _simulated(spark, sf).groupBy("site", "name").agg(F.sum("inflow").alias("inflow"), F.sum("infiltration").alias("infiltration"), F.sum("overflow").alias("overflow"), F.max("fill_pct").alias("peak_fill_pct"), F.min("first_overflow_hr").alias("first_overflow_hr"))
    return rounded(out, "inflow", "infiltration", "overflow", "peak_fill_pct", "first_overflow_hr")


CNS = (40, 50, 60, 70, 80)


def _class_flow(spark, sf) -> DataFrame:
    return T.written(terrain.d8(T.grid(spark, sf), T.CELL).select("r", "c", "cn", "to_r", "to_c"))


def _drained(flow: DataFrame, n: int) -> DataFrame:
    """(r, c, cn40, ...): how many cells of each curve number drain through a cell."""
    return _cells(terrain.accumulate(flow, n, {f"cn{k}": (F.col("cn") == k).cast("double") for k in CNS}), n)


def _class_counts(spark, sf) -> DataFrame:
    """(r, c, ends, cn40, ...): how many cells of each curve number drain through a cell, and whether its path ends there."""
    flow = _class_flow(spark, sf)
    counts = _drained(flow, T.side(spark, sf))
    # nine million cells of whole numbers are a file of few MB, which Spark would take for small and send through the driver
    return counts.join(flow.select("r", "c", F.col("to_r").isNull().alias("ends")).hint("merge"), ["r", "c"])


def _storm_steps(increments: DataFrame) -> DataFrame:
    """One row: the storm's steps (time_min, hours, mm40, ...) as an array ``s``, a few bytes for each step.

    A step lasts from the one before it, the first from the storm's start.
    """
    mm = [F.sum(F.when(F.col("cn") == k, F.greatest(F.lit(0.0), F.col("mm"))).otherwise(0.0)).alias(f"mm{k}") for k in CNS]
    hours = (F.col("time_min") - F.lag("time_min", 1, 0).over(Window.orderBy("time_min"))) / 60.0
    by_step = increments.groupBy("time_min").agg(*mm).withColumn("hours", hours)
    return by_step.agg(F.sort_array(F.collect_list(F.struct("time_min", "hours", *[f"mm{k}" for k in CNS]))).alias("s"))


def _routed(x) -> Column:
    """The flow that a step's runoff (mm40, ...) makes at a cell with such counts: linear in runoff, so no step is routed by itself."""
    return sum((F.coalesce(f"cn{k}", F.lit(0.0)) * x[f"mm{k}"] for k in CNS), F.lit(0.0)) / 1000.0 * AREA


def _frames(spark, sf) -> DataFrame:
    """(r, c, ends, peak_m3, total_m3): the greatest and the summed routed flow of each cell over all steps.

    Steps stay an array that is folded in one projection: there never is a row for a cell and a step.
    """
    steps = _storm_steps(_increments(spark, sf))
    wet = F.filter("s", lambda x: sum((x[f"mm{k}"] for k in CNS), F.lit(0.0)) > 0)
    sum_of = lambda k: F.aggregate("s", F.lit(0.0), lambda a, x: a + x[k])
    all_mm = F.struct(*[sum_of(f"mm{k}").alias(f"mm{k}") for k in CNS])
    row = steps.select(F.array_distinct(F.transform(wet, lambda x: F.struct(*[x[f"mm{k}"].alias(f"mm{k}") for k in CNS]))).alias("w"), all_mm.alias("all"))
    row = T.written(row)
    # counts are never below 0, so a step with less runoff of every class than another is nowhere the greatest
    less = lambda x, y: (x != y) & reduce(lambda p, q: p & q, [y[f"mm{k}"] >= x[f"mm{k}"] for k in CNS])
    row = T.written(row.select(F.filter("w", lambda x: ~F.exists("w", lambda y: less(x, y))).alias("w"), "all"))
    at = _class_counts(spark, sf).crossJoin(F.broadcast(row))
    return at.select("r", "c", "ends", F.coalesce(F.array_max(F.transform("w", _routed)), F.lit(0.0)).alias("peak_m3"), F.coalesce(_routed(F.col("all")), F.lit(0.0)).alias("total_m3"))


#: Routed flow of every cell in every step.
_FRAMES = f"WITH RECURSIVE {_INC}," + WALK[len("WITH RECURSIVE ") + len(GRID) + 1 :] + """,
ca AS (SELECT r, c, cn, count(*) AS k FROM walk GROUP BY r, c, cn), ms AS (SELECT time_min, cn, mm FROM i WHERE mm > 0),
fr AS (SELECT r, c, time_min, sum(ca.k * mm) / 1e3 * 25 AS v FROM ca JOIN ms ON ms.cn = ca.cn GROUP BY ALL)"""


@query(_FRAMES + " SELECT g.r, g.c, round(coalesce(max(v), 0e0), 4) AS peak_m3, round(coalesce(sum(v), 0e0), 4) AS total_m3 FROM g LEFT JOIN fr ON fr.r = g.r AND fr.c = g.c GROUP BY g.r, g.c")
def q31_cell_peak(spark, sf):
    """Peak and sum over the frames of a storm: a frame has the flow routed through each cell in one step."""
    return rounded(_frames(spark, sf).select("r", "c", "peak_m3", "total_m3"), "peak_m3", "total_m3", digits=4)


def _outflow(spark, sf) -> DataFrame:
    """(time_min, hours, most_m3, runoff_m3): without stores, the greatest flow of each step and the ground's runoff.

    Flow only grows downstream, so the greatest is where a path ends: cells of the rim, and pits.
    """
    counts = _class_counts(spark, sf).where("ends")
    steps = _storm_steps(_increments(spark, sf))
    each = counts.crossJoin(F.broadcast(steps)).select(F.explode(F.transform("s", lambda x: F.struct(x["time_min"].alias("time_min"), x["hours"].alias("hours"), _routed(x).alias("v")))).alias("x"))
    # every cell drains to one end, so the ends' flows add up to the runoff
    return each.groupBy("x.time_min", "x.hours").agg(F.max("x.v").alias("most_m3"), F.sum("x.v").alias("runoff_m3"))


_OUTFLOW = _FRAMES + """, sj AS (SELECT time_min, sum(greatest(0e0, mm) * k) / 1e3 * 25 AS runoff_m3, (time_min - lag(time_min, 1, 0) OVER (ORDER BY time_min)) / 6e1 AS hours FROM i GROUP BY time_min),
hg AS (SELECT sj.time_min, runoff_m3, hours, coalesce(m, 0e0) AS m FROM sj LEFT JOIN (SELECT time_min, max(v) AS m FROM fr GROUP BY 1) f ON f.time_min = sj.time_min)"""


@query(_OUTFLOW + " SELECT time_min::INT AS time_min, round(runoff_m3, 4) AS runoff_m3, round(m * 1e3 / greatest(1e0, hours * 36e2), 4) AS outflow_ls, round(runoff_m3 * 1e3 / greatest(1e0, hours * 36e2), 4) AS baseline_ls FROM hg")
def q68_outflow_without_stores(spark, sf):
    """The hydrograph of a site without earthworks, and the baseline on which all runoff leaves in its step."""
    seconds = F.greatest(F.lit(1.0), F.col("hours") * 3600)
    out = _outflow(spark, sf).select("time_min", "runoff_m3", (F.col("most_m3") * 1000 / seconds).alias("outflow_ls"), (F.col("runoff_m3") * 1000 / seconds).alias("baseline_ls"))
    return rounded(out, "runoff_m3", "outflow_ls", "baseline_ls", digits=4)


@query(_OUTFLOW + """, o AS (SELECT *, m * 1e3 / greatest(1e0, hours * 36e2) AS ls FROM hg)
SELECT round(sum(m), 4) AS outflow_m3, round(sum(runoff_m3), 4) AS runoff_m3, round(max(ls), 4) AS peak_ls, CASE WHEN max(ls) > 0 THEN arg_min(time_min, (-round(ls, 6), time_min)) / 6e1 ELSE 0e0 END AS peak_hr, count(*)::BIGINT AS steps FROM o""")
def q69_baseline_storm(spark, sf):
    """What a baseline without stores needs to be compared: volume that leaves, peak and its time."""
    o = _outflow(spark, sf).withColumn("ls", F.col("most_m3") * 1000 / F.greatest(F.lit(1.0), F.col("hours") * 3600))
    best = F.max(F.struct(F.round("ls", 6).alias("v"), (-F.col("time_min")).alias("t")))
    out = o.agg(F.sum("most_m3").alias("outflow_m3"), F.sum("runoff_m3").alias("runoff_m3"), F.max("ls").alias("peak_ls"), best.alias("b"), F.count("*").alias("steps"))
    out = out.withColumn("peak_hr", F.when(F.col("peak_ls") > 0, -F.col("b.t") / 60.0).otherwise(0.0)).drop("b")
    return rounded(out, "outflow_m3", "runoff_m3", "peak_ls", digits=4)


@query("WITH a AS (SELECT s_nationkey AS site, sum(s_acctbal) + 2e4 AS b, sum(s_acctbal * 5e-1) + 5e3 AS p FROM supplier GROUP BY 1) SELECT site, round(b, 4) AS before, round(p, 4) AS after, round(CASE WHEN b <= 0 THEN 0e0 ELSE greatest(0e0, 1e2 * (b - p) / b) END, 6) AS reduction_pct FROM a")
def q32_compare(spark, sf):
    a = T.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("site")).agg((F.sum("s_acctbal") + 20000.0).alias("before"), (F.sum(F.col("s_acctbal") * 0.5) + 5000.0).alias("after"))
    return rounded(rounded(a.withColumn("reduction_pct", H.percent_drop("before", "after")), "reduction_pct"), "before", "after", digits=4)


def _separation(n: int) -> float:
    """At least a tenth of the grid's shorter side."""
    return float(max(10, int(n * 0.1)))


def _scored(spark, sf, site: DataFrame | None = None, acc: DataFrame | None = None) -> DataFrame:
    """Valley cells up to the 75th percentile of flow, all of them if that leaves none, by flow over gentle slope.

    With a ``site`` (r, c) only its cells: those of the band, or if there are none, those of the valley. ``acc``: the
    counted flow, if it is there already.
    """
    n = T.side(spark, sf)
    slope = terrain.box_mean(terrain.slope_deg(T.grid(spark, sf), T.CELL), n, 1, "slope", "smooth").select("r", "c", "smooth")
    valley = T.written((_counted(spark, sf) if acc is None else acc).where("acc >= 10"))
    p75 = quantile.quantile(valley, "acc", 0.75)
    band = valley if p75 is None or valley.where(F.col("acc") <= p75).isEmpty() else valley.where(F.col("acc") <= p75)
    if site is not None:
        own = T.written(band.join(site, ["r", "c"], "left_semi"))
        band = valley.join(site, ["r", "c"], "left_semi") if own.isEmpty() else own
    return T.written(band.join(slope, ["r", "c"]).select("r", "c", "acc", (F.col("acc") / (F.col("smooth") + 1)).alias("score")))


_SCORED = WALK + ", " + SLOPE[len(GRID) + 2 :] + f""", a AS (SELECT r, c, count(*)::BIGINT AS acc FROM walk GROUP BY r, c),
sg AS (SELECT sl.*, n FROM sl, n), sma AS {_mirror(1, 'sg', 'r', 'c', 'slope', 'm').replace(', n WHERE', ' WHERE')}, smb AS {_mirror(1, 'sma', 'c', 'r', 'm', 'smooth')},
va AS (SELECT * FROM a WHERE acc >= 10), hi AS (SELECT quantile_cont(acc, 75e-2) AS p75 FROM va),
sc AS (SELECT va.r, va.c, acc, acc / (smooth + 1) AS score FROM va JOIN hi ON acc <= p75 JOIN smb ON smb.r = va.r AND smb.c = va.c),
sep AS (SELECT greatest(10, floor(n / 10)) AS s FROM n),
kp AS (SELECT 1 AS rank, r, c, acc, score, [{{'r': r, 'c': c}}] AS kept FROM (SELECT * FROM sc ORDER BY score DESC, r, c LIMIT 1) UNION ALL
  SELECT rank + 1, b.r, b.c, b.acc, b.score, list_append(kept, {{'r': b.r, 'c': b.c}}) FROM (
    SELECT kp.rank, kp.kept, sc.*, row_number() OVER (ORDER BY sc.score DESC, sc.r, sc.c) AS o FROM kp, sep, sc
    WHERE kp.rank < 5 AND len(list_filter(kp.kept, lambda x: sc.r - x.r >= -s AND sc.r - x.r < s AND sc.c - x.c >= -s AND sc.c - x.c < s)) = 0) b WHERE o = 1)"""


def _keypoints(spark, sf, acc: DataFrame | None = None) -> DataFrame:
    return vector.greedy_apart(_scored(spark, sf, acc=acc), "score", _separation(T.side(spark, sf)), 5, square=True)


@query(_SCORED + " SELECT rank::INT AS rank, r, c, round(score, 6) AS score FROM kp")
def q33_keypoints(spark, sf):
    return rounded(_keypoints(spark, sf), "score")


def _eroded(src: str) -> str:
    return f"SELECT a.r, a.c FROM {src} a JOIN {src} b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c HAVING count(*) = 9"


_RIDGES = WALK + f""", a AS (SELECT r, c, count(*)::BIGINT AS acc FROM walk GROUP BY r, c),
ma AS {_mirror(7, 'g', 'r', 'c', 'z', 'm').replace(', n WHERE', ' WHERE')}, mb AS {_mirror(7, 'ma', 'c', 'r', 'm', 'mean')},
cr AS (SELECT g.r, g.c, g.z, n FROM g JOIN mb ON mb.r = g.r AND mb.c = g.c JOIN a ON a.r = g.r AND a.c = g.c WHERE z - mean > 2e-2 AND acc <= 2 AND g.r BETWEEN 1 AND n - 2 AND g.c BETWEEN 1 AND n - 2),
e1 AS ({_eroded('cr')}), e2 AS ({_eroded('e1')}), e3 AS ({_eroded('e2')}), ct AS (SELECT (SELECT count(*) FROM e1) AS k1, (SELECT count(*) FROM e2) AS k2, (SELECT count(*) FROM e3) AS k3),
th AS (SELECT r, c FROM cr, ct WHERE k1 = 0 UNION ALL SELECT r, c FROM e1, ct WHERE k1 > 0 AND k2 = 0 UNION ALL SELECT r, c FROM e2, ct WHERE k2 > 0 AND k3 = 0 UNION ALL SELECT r, c FROM e3, ct WHERE k3 > 0),
tz AS (SELECT th.r, th.c, z, th.r::BIGINT * n + th.c AS id FROM th JOIN cr ON cr.r = th.r AND cr.c = th.c),
lb(r, c, zone) USING KEY (r, c) AS (SELECT r, c, id FROM tz UNION SELECT w.r, w.c, min(o.zone) FROM lb JOIN tz w ON abs(w.r - lb.r) + abs(w.c - lb.c) <= 1
  JOIN recurring.lb o ON abs(o.r - w.r) + abs(o.c - w.c) <= 1 JOIN recurring.lb own ON own.r = w.r AND own.c = w.c GROUP BY w.r, w.c, own.zone HAVING min(o.zone) < own.zone)"""


@query(_RIDGES + " SELECT zone, count(*)::BIGINT AS cells, round(avg(z), 6) AS mean_z FROM tz JOIN lb ON lb.r = tz.r AND lb.c = tz.c GROUP BY zone HAVING count(*) >= 20 ORDER BY cells DESC, zone LIMIT 30")
def q34_ridges(spark, sf):
    n = T.side(spark, sf)
    crest = _crest(spark, sf)
    return _ridge_zones(crest, n)


def _crest(spark, sf, least: float = 0.02) -> DataFrame:
    """(r, c, z) of cells inside the grid that stand out above their surroundings by ``least`` and have hardly any flow."""
    n = T.side(spark, sf)
    tpi = terrain.box_mean(T.grid(spark, sf), n, 7, "z", "mean").where((F.col("z") - F.col("mean") > least) & F.col("r").between(1, n - 2) & F.col("c").between(1, n - 2))
    return T.written(tpi.join(_counted(spark, sf).where("acc <= 2"), ["r", "c"]).select("r", "c", "z"))


def _ridge_zones(crest: DataFrame, n: int, least_m: float = 100.0) -> DataFrame:
    """The 30 largest connected parts of the thinned crest, of those as long as ``least_m`` or more, in cells."""
    thin = T.written(terrain.erode(crest))
    zones = crest.join(terrain.components(thin, n, eight=False), ["r", "c"])
    sizes = zones.groupBy("zone").agg(F.count("*").alias("cells"), F.avg("z").alias("mean_z"))
    out = sizes.where(F.col("cells") >= max(3, int(least_m / T.CELL))).orderBy(F.desc("cells"), "zone").limit(30)
    return rounded(out, "mean_z")


@query(_SCORED + """, ca AS (SELECT kp.rank, a.r, a.c, g.z, a.acc FROM kp JOIN a ON abs(a.r - kp.r) <= 6 AND abs(a.c - kp.c) <= 6 AND a.acc > kp.acc AND a.acc <= 4 * kp.acc JOIN g ON g.r = a.r AND g.c = a.c WHERE a.r BETWEEN 1 AND g.n - 2 AND a.c BETWEEN 1 AND g.n - 2),
wi AS (SELECT ca.*, (SELECT count(*) FROM g WHERE g.r = ca.r AND abs(g.c - ca.c) <= 200 AND g.z <= ca.z + 2) * 5e0 AS width_m FROM ca),
be1 AS (SELECT * FROM wi QUALIFY row_number() OVER (PARTITION BY rank ORDER BY acc / (width_m + 1) DESC, r, c) = 1)
SELECT kp.rank::INT AS rank, coalesce(be1.r, kp.r) AS r, coalesce(be1.c, kp.c) AS c, round(coalesce(be1.z, g.z), 6) AS z, coalesce(be1.acc, kp.acc)::BIGINT AS acc, coalesce(width_m, 5e1) AS width_m
FROM kp JOIN g ON g.r = kp.r AND g.c = kp.c LEFT JOIN be1 ON be1.rank = kp.rank""")
def q35_pond_sites(spark, sf):
    """Just below each keypoint, where the valley is narrow for its flow; the row is scanned to the grid's edge."""
    n, acc = T.side(spark, sf), _counted(spark, sf)
    keys = _keypoints(spark, sf, acc).select("rank", F.col("r").alias("kr"), F.col("c").alias("kc"))
    out = vector.pond_sites(keys, T.grid(spark, sf), acc, 6, n, T.CELL, cut_left=False)
    return rounded(out.withColumn("acc", F.col("acc").cast("long")), "z")


@query("""WITH k AS (SELECT n_nationkey + 1 AS kp, 100e0 + n_nationkey * 15e-1 AS base FROM nation), e AS (SELECT kp, o::INT AS o, round(base + o * 5e0, 2) AS elevation FROM k, (SELECT unnest(range(-2, 3)) AS o))
SELECT elevation, kp AS keypoint, o AS step, CASE WHEN o = 0 THEN 'keyline' WHEN o > 0 THEN 'cultivation_upper' ELSE 'cultivation_lower' END AS line_type,
  CASE WHEN o = 0 THEN 'Keyline ' || kp ELSE 'Cultivation ' || kp || ' (' || CASE WHEN o > 0 THEN '+' ELSE '' END || o || ')' END || ' — ' || printf('%.1f', elevation) || ' m' AS label
FROM e QUALIFY row_number() OVER (PARTITION BY elevation ORDER BY kp, o) = 1""")
def q36_cultivation_levels(spark, sf):
    """Keylines and the lines above and below them, each elevation once, with the first keypoint that has it."""
    keys = T.table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("kp"), (100.0 + F.col("n_nationkey") * 1.5).alias("base"))
    return vector.cultivation_levels(keys, 2, 5.0)


@query(f"WITH {GRID}, {_LINES}, {_SAMPLES}, h AS (SELECT id, i, greatest(0e0, max(z) OVER (PARTITION BY id) + 1 - z) AS h FROM sm JOIN g ON g.r = sm.r AND g.c = sm.c) SELECT id, round(max(h), 6) AS max_height, round(sum(h) * sqrt(4e3) / 19e0 * 2, 6) AS volume_m3, CASE WHEN max(h) > 5 THEN 'may need an engineer' WHEN max(h) <= 4 THEN 'feasible' ELSE 'check' END AS class FROM h GROUP BY id")
def q37_dam_walls(spark, sf):
    at = vector.sample_lines(_lines(spark, sf), 20, T.side(spark, sf), T.CELL).join(T.grid(spark, sf), ["r", "c"])
    h = at.withColumn("h", F.greatest(F.lit(0.0), F.max("z").over(Window.partitionBy("id")) + 1 - F.col("z")))
    out = h.groupBy("id").agg(F.max("h").alias("max_height"), (F.sum("h") * (4000.0**0.5) / 19.0 * 2).alias("volume_m3"))
    return rounded(out.withColumn("class", H.dam_class("max_height")), "max_height", "volume_m3")


@query(f"WITH n AS (SELECT floor(sqrt(count(*)))::BIGINT AS n FROM orders), {_LINES}, p AS (SELECT c_custkey, (c_custkey * 37 % 1000) / 1e3 * 5 * n AS x, (c_custkey * 91 % 1000) / 1e3 * 5 * n AS y FROM customer, n), t AS (SELECT *, greatest(0e0, least(1e0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS t FROM p, ln), d AS (SELECT c_custkey, id, sqrt((x - x0 - t * (x1 - x0)) * (x - x0 - t * (x1 - x0)) + (y - y0 - t * (y1 - y0)) * (y - y0 - t * (y1 - y0))) AS d FROM t) SELECT c_custkey, arg_min(id, (round(d, 6), id)) AS id, round(min(d), 6) AS distance FROM d GROUP BY c_custkey")
def q38_nearest_line(spark, sf):
    """For each clicked point the nearest drawn line."""
    n, k = T.side(spark, sf), F.col("c_custkey")
    p = T.table(spark, sf, "customer").select(k.alias("pid"), ((k * 37 % 1000) / 1000.0 * 5 * n).alias("x"), ((k * 91 % 1000) / 1000.0 * 5 * n).alias("y"))
    lines = _lines(spark, sf).select("id", G.line(("x0", "y0"), ("x1", "y1")).alias("pts"))
    return vector.nearest(p, lines, T.CELL * n / 4).select(F.col("pid").alias("c_custkey"), "id", "distance")


@query(f"WITH {RAIN} SELECT time_min, hour, round(mm, 9) AS mm, round(sum(mm) OVER (ORDER BY time_min ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 9) AS mm_6h FROM rain")
def q39_rolling_rain(spark, sf):
    w = Window.orderBy("time_min").rowsBetween(-5, 0)
    return rounded(T.daily_rain(spark, sf).select("time_min", "hour", "mm", F.sum("mm").over(w).alias("mm_6h")), "mm", "mm_6h", digits=9)


@query(_SIM + """ SELECT site, time_min, name, round(least(fill_pct, 1e2), 1) AS fill_pct, first_overflow_hr IS NOT NULL AS overflowed,
  first_overflow_hr IS NOT NULL AND abs(first_overflow_hr - time_min / 6e1) < 1 + 1e-6 AS first_overflow_this_step FROM st""")
def q40_fill_frames(spark, sf):
    """Each store at each frame: how full it is, whether it has overflowed yet, and whether that was within the last step."""
    out = _simulated(spark, sf)
    gone = F.col("first_overflow_hr").isNotNull()
    just = gone & (F.abs(F.col("first_overflow_hr") - F.col("time_min") / 60.0) < 1 + 1e-6)
    return out.select("site", "time_min", "name", (F.round(F.least("fill_pct", F.lit(100.0)), 1) + 0.0).alias("fill_pct"), gone.alias("overflowed"), just.alias("first_overflow_this_step"))


def _near_sql(grid: str) -> str:
    return grid + """,
t AS (SELECT r, c, z, lag(z) OVER x AS vw, lead(z) OVER x AS ve FROM g WINDOW x AS (PARTITION BY r ORDER BY c)),
nb AS (SELECT *, lag(z) OVER y AS vn, lag(vw) OVER y AS vnw, lag(ve) OVER y AS vne, lead(z) OVER y AS vs, lead(vw) OVER y AS vsw, lead(ve) OVER y AS vse FROM t WINDOW y AS (PARTITION BY c ORDER BY r))"""


def _dinf_sql() -> str:
    rows = []
    step = {k: (dr, dc) for k, dr, dc, _ in terrain.D8}
    for i, (a, b, quarters, sense) in enumerate(terrain.FACETS):
        (ra, ca), (rb, cb) = step[a], step[b]
        rows.append(f"SELECT r, c, {i} AS i, {quarters} AS ac, {sense} AS af, r + {ra} AS r1, c + {ca} AS c1, r + {rb} AS r2, c + {cb} AS c2, (z - v{a}) / 5e0 AS s1, (v{a} - v{b}) / 5e0 AS s2, (z - v{b}) / (5e0 * sqrt(2e0)) AS s3 FROM nb WHERE v{a} IS NOT NULL AND v{b} IS NOT NULL")
    return _near_sql(GRID) + f""",
fa AS ({" UNION ALL ".join(rows)}),
fs AS (SELECT *, CASE WHEN s2 < 0 THEN s1 WHEN s2 > s1 THEN s3 ELSE sqrt(s1 * s1 + s2 * s2) END AS s, CASE WHEN s2 < 0 THEN 0e0 WHEN s2 > s1 THEN pi() / 4 ELSE atan2(s2, s1) END AS turn FROM fa),
di AS (SELECT *, af * turn + ac * pi() / 2 AS angle FROM fs WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY s DESC, i) = 1)"""


@query(f"WITH {_dinf_sql()} SELECT g.r, g.c, round(angle, 6) AS angle FROM g LEFT JOIN di ON di.r = g.r AND di.c = g.c")
def q41_dinf_direction(spark, sf):
    return rounded(terrain.dinf(T.grid(spark, sf), T.CELL).select("r", "c", "angle"), "angle")


@query(f"""WITH RECURSIVE {_dinf_sql()},
e AS (SELECT r, c, r1 AS tr, c1 AS tc, 1 - turn / (pi() / 4) AS p FROM di UNION ALL SELECT r, c, r2, c2, turn / (pi() / 4) FROM di),
lv AS (SELECT r, c, 1e0 AS m FROM g UNION ALL SELECT tr, tc, sum(m * p) FROM lv JOIN e ON e.r = lv.r AND e.c = lv.c AND p > 0 GROUP BY tr, tc)
SELECT r, c, round(sum(m), 4) AS acc FROM lv GROUP BY r, c""")
def q42_dinf_accumulation(spark, sf):
    flow = terrain.dinf(T.grid(spark, sf), T.CELL).withColumn("weight", F.lit(1.0))
    return rounded(terrain.accumulate_split(flow), "acc", digits=4)


_ASPECT = _near_sql(GRID) + """,
v AS (SELECT r, c, z, vw, ve, coalesce(vn, 2 * z - vs) AS n1, coalesce(vs, 2 * z - vn) AS s1, coalesce(vne, 2 * ve - vse) AS ne1, coalesce(vse, 2 * ve - vne) AS se1, coalesce(vnw, 2 * vw - vsw) AS nw1, coalesce(vsw, 2 * vw - vnw) AS sw1 FROM nb),
h AS (SELECT *, coalesce(ve, 2 * z - vw) AS e2, coalesce(vw, 2 * z - ve) AS w2, coalesce(ne1, 2 * n1 - nw1) AS ne2, coalesce(nw1, 2 * n1 - ne1) AS nw2, coalesce(se1, 2 * s1 - sw1) AS se2, coalesce(sw1, 2 * s1 - se1) AS sw2 FROM v),
k AS (SELECT r, c, (ne2 + 2 * e2 + se2) - (nw2 + 2 * w2 + sw2) AS x, (sw2 + 2 * s1 + se2) - (nw2 + 2 * n1 + ne2) AS y FROM h),
b AS (SELECT r, c, CASE WHEN x = 0 AND y = 0 THEN 0e0 WHEN degrees(atan2(y, -x)) > 90 THEN 450 - degrees(atan2(y, -x)) ELSE 90 - degrees(atan2(y, -x)) END AS bearing FROM k),
asp AS (SELECT r, c, CASE WHEN bearing = 360 THEN 0e0 ELSE bearing END AS aspect FROM b)"""


@query(f"WITH {_ASPECT} SELECT r, c, round(aspect, 4) AS aspect FROM asp")
def q43_aspect(spark, sf):
    return rounded(terrain.aspect(T.grid(spark, sf)).select("r", "c", "aspect"), "aspect", digits=4)


@query(f"WITH {_ASPECT} SELECT r, c, round(aspect, 4) AS aspect FROM asp WHERE r % 10 = 0 AND c % 10 = 0")
def q44_slope_arrows(spark, sf):
    """One arrow every fifty metres."""
    step = max(1, int(50 / T.CELL))
    out = terrain.aspect(T.grid(spark, sf)).where((F.col("r") % step == 0) & (F.col("c") % step == 0))
    return rounded(out.select("r", "c", "aspect"), "aspect", digits=4)


@query(f"WITH {_near_sql(ROUGH)} SELECT r, c, round(CASE WHEN vn + vne + ve + vse + vs + vsw + vw + vnw IS NOT NULL AND z < least(vn, vne, ve, vse, vs, vsw, vw, vnw) THEN least(vn, vne, ve, vse, vs, vsw, vw, vnw) ELSE z END, 6) AS z FROM nb")
def q45_fill_pits(spark, sf):
    return rounded(terrain.fill_pits(T.grid(spark, sf, T.ROUGH)).select("r", "c", "z"), "z")


#: Filled surface, steps to a way down over flats, and the way of every cell.
_FULL = FILL + f""",
h AS (SELECT g.r, g.c, f.w AS z, g.n FROM f JOIN g ON g.r = f.r AND g.c = f.c),
st(i, dr, dc, code, dist) AS (VALUES {_STEPS}),
fl AS (SELECT a.r, a.c, i, code, b.r AS tr, b.c AS tc, (a.z - b.z) / dist AS f FROM h a, st, h b WHERE b.r = a.r + dr AND b.c = a.c + dc),
be AS (SELECT * FROM fl WHERE f > 0 QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY f DESC, i) = 1),
co AS (SELECT h.* FROM h LEFT JOIN be ON be.r = h.r AND be.c = h.c WHERE be.r IS NULL AND h.r > 0 AND h.c > 0 AND h.r < n - 1 AND h.c < n - 1),
ft AS (SELECT r, c, z, true AS core FROM co UNION ALL SELECT DISTINCT h.r, h.c, h.z, false FROM h JOIN co ON abs(h.r - co.r) <= 1 AND abs(h.c - co.c) <= 1 AND h.z = co.z WHERE NOT EXISTS (SELECT 1 FROM co x WHERE x.r = h.r AND x.c = h.c)),
fs(r, c, z, k) USING KEY (r, c) AS (SELECT r, c, z, 0 FROM ft WHERE NOT core
  UNION SELECT b.r, b.c, b.z, min(fs.k) + 1 FROM fs JOIN ft b ON abs(b.r - fs.r) <= 1 AND abs(b.c - fs.c) <= 1 AND b.z = fs.z LEFT JOIN recurring.fs o ON o.r = b.r AND o.c = b.c WHERE o.r IS NULL GROUP BY b.r, b.c, b.z),
hs(r, c, z, d) USING KEY (r, c) AS (SELECT DISTINCT ft.r, ft.c, ft.z, 1 FROM ft JOIN h ON abs(h.r - ft.r) <= 1 AND abs(h.c - ft.c) <= 1 AND h.z > ft.z
  UNION SELECT b.r, b.c, b.z, min(hs.d) + 1 FROM hs JOIN ft b ON abs(b.r - hs.r) <= 1 AND abs(b.c - hs.c) <= 1 AND b.z = hs.z LEFT JOIN recurring.hs o ON o.r = b.r AND o.c = b.c WHERE o.r IS NULL GROUP BY b.r, b.c, b.z),
fd AS (SELECT fs.r, fs.c, fs.z, k, 2 * k - coalesce(d, 0) AS v FROM fs LEFT JOIN hs ON hs.r = fs.r AND hs.c = fs.c),
fw AS (SELECT a.r, a.c, code, b.r AS tr, b.c AS tc FROM fd a, st, fd b WHERE a.k > 0 AND b.r = a.r + dr AND b.c = a.c + dc AND b.z = a.z AND b.v < a.v QUALIFY row_number() OVER (PARTITION BY a.r, a.c ORDER BY b.v, i) = 1),
way AS (SELECT h.r, h.c, coalesce(fw.code, be.code, 0) AS dir, coalesce(fw.tr, be.tr) AS to_r, coalesce(fw.tc, be.tc) AS to_c FROM h LEFT JOIN be ON be.r = h.r AND be.c = h.c LEFT JOIN fw ON fw.r = h.r AND fw.c = h.c),
walk AS (SELECT r, c FROM way UNION ALL SELECT w.to_r, w.to_c FROM walk JOIN way w ON w.r = walk.r AND w.c = walk.c WHERE w.to_r IS NOT NULL)"""


@query(_FULL + ", ac AS (SELECT r, c, count(*)::BIGINT AS acc FROM walk GROUP BY r, c) SELECT way.r, way.c, way.dir, acc FROM way JOIN ac ON ac.r = way.r AND ac.c = way.c")
def q46_conditioned_accumulation(spark, sf):
    """The whole chain from a raw surface: fill, flats, D8, accumulation."""
    n = T.side(spark, sf)
    flow = T.written(terrain.condition(T.grid(spark, sf, T.ROUGH), n, T.CELL))
    acc = _cells(terrain.accumulate(flow, n, {"acc": F.lit(1.0)}), n)
    return flow.join(acc, ["r", "c"]).select("r", "c", "dir", F.col("acc").cast("long").alias("acc"))


@query(_FULL + """, up AS (SELECT r, c, z FROM g UNION ALL SELECT w.to_r, w.to_c, up.z FROM up JOIN way w ON w.r = up.r AND w.c = up.c WHERE w.to_r IS NOT NULL),
lo AS (SELECT r, c, min(z) AS z FROM up GROUP BY r, c), lf AS (SELECT a.r, a.c, i, code, (a.z - b.z) / dist AS f FROM lo a, st, lo b WHERE b.r = a.r + dr AND b.c = a.c + dc),
lb AS (SELECT * FROM lf WHERE f > 0 QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY f DESC, i) = 1)
SELECT lo.r, lo.c, round(lo.z, 6) AS z, coalesce(lb.code, way.dir) AS dir FROM lo JOIN way ON way.r = lo.r AND way.c = lo.c LEFT JOIN lb ON lb.r = lo.r AND lb.c = lo.c""")
def q73_breached(spark, sf):
    """The surface with its depressions cut open, and where each cell drains to."""
    out = terrain.condition(T.grid(spark, sf, T.ROUGH), T.side(spark, sf), T.CELL, breach=True)
    return rounded(out.select("r", "c", "z", "dir"), "z")
