"""Runoff, hydraulics, earthwork sizing and classes as Spark columns. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Curve numbers and infiltration (mm/h) by soil, design storms (mm in one hour), and design factors.
SOIL_CN = {"Sand": 39, "Sandy loam": 49, "Loam": 61, "Clay loam": 74, "Clay": 80}
INFILTRATION = {"Sand": 15.0, "Sandy loam": 8.0, "Loam": 4.0, "Clay loam": 2.5, "Clay": 1.5}
STORMS_MM = [25.0, 40.0, 65.0, 80.0]
FREEBOARD, COMPACTION, MANNING_N, WEIR_C, POND_FLOOR = 0.8, 0.75, 0.025, 1.7, 0.001


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def adjust_cn(cn, moisture) -> Column:
    """Curve number under dry, normal or wet conditions, from 1 to 100; another condition is an error."""
    cn, m = _c(cn), _c(moisture)
    dry, wet = 4.2 * cn / (10 - 0.058 * cn), 23 * cn / (10 + 0.13 * cn)
    v = F.when(m == "dry", dry).when(m == "normal", cn.cast("double")).when(m == "wet", wet).otherwise(F.raise_error(F.concat(F.lit("unknown moisture "), m)).cast("double"))
    return F.greatest(F.lit(1.0), F.least(F.lit(100.0), v))


def runoff_mm(p, cn) -> Column:
    """SCS runoff depth: none below the initial abstraction or without a curve number."""
    p, cn = _c(p), _c(cn)
    s = F.try_divide(F.lit(25400.0), cn.cast("double")) - 254.0
    over = p - 0.2 * s
    return F.when((cn <= 0) | (over <= 0), F.lit(0.0)).otherwise(F.try_divide(over * over, over + s))


def runoff_ratio(p, cn) -> Column:
    return F.when(_c(p) <= 0, F.lit(0.0)).otherwise(F.try_divide(runoff_mm(p, cn), _c(p)))


def volume_m3(mm, area_m2) -> Column:
    return _c(mm) / 1000.0 * _c(area_m2)


def section_m2(depth, width, floor: float = 0.1) -> Column:
    """Cross-section of a channel with 1:1 sides; the bottom is at least ``floor`` wide."""
    d, w = _c(depth), _c(width)
    return (F.greatest(F.lit(floor), w - 2 * d) + w + 2 * d) / 2 * d


def berm_height(depth, width) -> Column:
    return F.sqrt(COMPACTION * section_m2(depth, width))


def capacity_m3(kind, depth, width, length, area, companion) -> Column:
    """What a swale or basin holds below its freeboard; other works hold nothing."""
    cs = section_m2(depth, width)
    with_berm = cs + F.when(_c(companion), berm_height(depth, width) * (_c(width) + 2 * _c(depth)) / 2).otherwise(0.0)
    return F.when(_c(kind) == "swale", with_berm * _c(length) * FREEBOARD).when(_c(kind) == "basin", _c(area) * _c(depth) * FREEBOARD).otherwise(F.lit(0.0))


def cut_m3(kind, depth, width, length, area) -> Column:
    k = _c(kind)
    return F.when(k == "swale", section_m2(depth, width) * _c(length)).when(k == "basin", _c(area) * _c(depth)).when(k == "diversion", section_m2(depth, width, 0.05) * _c(length)).otherwise(F.lit(0.0))


def fill_m3(kind, depth, width, length, companion) -> Column:
    k, d = _c(kind), _c(depth)
    side = berm_height(depth, width)
    return F.when(k == "berm", d * d * _c(length)).when((k == "swale") & _c(companion), side * side * _c(length)).when(k == "dam", _c(width) * d * _c(length)).otherwise(F.lit(0.0))


def manning_m3s(depth, width, gradient_pct) -> Column:
    d, w, s = _c(depth), _c(width), _c(gradient_pct) / 100.0
    bottom = F.greatest(F.lit(0.05), w - 2 * d)
    area = section_m2(depth, width, 0.05)
    radius = F.try_divide(area, bottom + 2 * F.sqrt(F.lit(2.0)) * d)
    return F.when((s <= 0) | (d <= 0) | (w <= 0), F.lit(0.0)).otherwise(area * F.pow(radius, F.lit(2.0 / 3.0)) * F.sqrt(s) / MANNING_N)


def spillway_m(discharge, head) -> Column:
    q, h = _c(discharge), _c(head)
    return F.when((q <= 0) | (h <= 0), F.lit(0.0)).otherwise(F.try_divide(q, WEIR_C * F.pow(h, F.lit(1.5))))


def swale_length_m(volume, depth, width, freeboard: float = FREEBOARD) -> Column:
    v, d, w = _c(volume), _c(depth), _c(width)
    return F.when((v <= 0) | (d <= 0) | (w <= 0), F.lit(0.0)).otherwise(F.try_divide(v, d * w * freeboard))


def infiltration_m3(rate_mm_h, area_m2, hours, available) -> Column:
    return F.least(_c(rate_mm_h) / 1000.0 * _c(area_m2) * _c(hours), _c(available))


def design_m3s(inflow_m3, hours) -> Column:
    """The mean flow of a storm's inflow, which sizes spillways; none without a duration."""
    return F.when(_c(hours) <= 0, F.lit(0.0)).otherwise(F.try_divide(_c(inflow_m3), _c(hours) * 3600.0))


def _steps(x: Column, bounds: list[tuple[float, str]], last: str, inclusive: bool = False) -> Column:
    out = None
    for most, name in bounds:
        test = x <= most if inclusive else x < most
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(last)


def channel_class(ha) -> Column:
    return _steps(_c(ha), [(0.5, "rills"), (5.0, "ephemeral"), (20.0, "permanent")], "river")


def slope_class(deg) -> Column:
    return _steps(_c(deg), [(3, "0-3"), (8, "3-8"), (13, "8-13"), (18, "13-18"), (25, "18-25")], "over 25")


def rank_band(rank) -> Column:
    return _steps(_c(rank), [(1, "1"), (5, "2-5"), (10, "6-10")], "11+", inclusive=True)


def draw_hint(deg) -> Column:
    d = _c(deg)
    return F.when((d < 0) | (d > 90), "").otherwise(_steps(d, [(5, "gentle"), (15, "moderate")], "steep", inclusive=True))


def pond_verdict(inflow, capacity) -> Column:
    return F.when(_c(inflow) <= _c(capacity), "captured").otherwise("overflows")


def dam_class(height) -> Column:
    h = _c(height)
    return F.when(h > 5, "may need an engineer").when(h <= 4, "feasible").otherwise("check")


def percent_drop(before, after) -> Column:
    """How much less, in percent: none below zero, and none without something before."""
    b, a = _c(before), _c(after)
    return F.when(b <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.try_divide(100 * (b - a), b)))


def register_sql(spark: SparkSession) -> None:
    """SQL functions for sessions that write SQL; Catalyst inlines them."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION scs_runoff(p DOUBLE, cn DOUBLE) RETURNS DOUBLE RETURN CASE WHEN cn <= 0 OR p <= 0.2 * (25400 / cn - 254) THEN 0 ELSE power(p - 0.2 * (25400 / cn - 254), 2) / (p + 0.8 * (25400 / cn - 254)) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION spillway_width(q DOUBLE, h DOUBLE) RETURNS DOUBLE RETURN CASE WHEN q <= 0 OR h <= 0 THEN 0 ELSE q / (1.7 * power(h, 1.5)) END")
