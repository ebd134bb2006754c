"""Lines and rings as columns: array<struct<x, y>>, with lengths, areas, places along, WKT and GeoJSON. No user functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x: double, y: double>>"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def line(*xy: tuple) -> Column:
    """A line from numbers or columns."""
    return F.array(*[point(x, y) for x, y in xy])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def segments(pts) -> Column:
    """array<struct<x0, y0, x1, y1, len>>, in order; empty for fewer than two points."""
    p = _c(pts)
    return F.zip_with(
        F.slice(p, F.lit(1), F.greatest(F.lit(0), F.size(p) - 1)), F.slice(p, F.lit(2), F.greatest(F.lit(0), F.size(p) - 1)),
        lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"), F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)).alias("len")),
    )


def length(pts) -> Column:
    return _sum(F.transform(segments(pts), lambda s: s["len"]))


def closed(ring) -> Column:
    """The ring with its first point at the end too."""
    p = _c(ring)
    return F.when((F.size(p) > 0) & (F.get(p, F.lit(0)) != F.element_at(p, -1)), F.concat(p, F.slice(p, 1, 1))).otherwise(p)


def area(ring) -> Column:
    return F.abs(_sum(F.transform(segments(closed(ring)), lambda s: (s["x0"] * s["y1"] - s["x1"] * s["y0"]) / 2)))


def line_centroid(pts) -> Column:
    """The middle of a line, each segment weighed by its length; of a line without length, its first point."""
    s, n = segments(pts), length(pts)
    mid = lambda a, b: F.try_divide(_sum(F.transform(s, lambda t: (t[a] + t[b]) / 2 * t["len"])), n)
    first = F.get(_c(pts), F.lit(0))
    return F.struct(F.coalesce(mid("x0", "x1"), first["x"]).alias("x"), F.coalesce(mid("y0", "y1"), first["y"]).alias("y"))


def ring_centroid(ring) -> Column:
    s = segments(closed(ring))
    cross = lambda t: t["x0"] * t["y1"] - t["x1"] * t["y0"]
    twice = _sum(F.transform(s, cross))
    at = lambda a, b: F.try_divide(_sum(F.transform(s, lambda t: (t[a] + t[b]) * cross(t))), 3 * twice)
    return F.struct(at("x0", "x1").alias("x"), at("y0", "y1").alias("y"))


def bounds(pts, margin: float = 0.0) -> Column:
    """struct<x0, y0, x1, y1>, widened on every side by a share of its extent."""
    p = _c(pts)
    low = lambda k: F.array_min(F.transform(p, lambda t: t[k]))
    high = lambda k: F.array_max(F.transform(p, lambda t: t[k]))
    wide = lambda k: (high(k) - low(k)) * margin
    return F.struct((low("x") - wide("x")).alias("x0"), (low("y") - wide("y")).alias("y0"), (high("x") + wide("x")).alias("x1"), (high("y") + wide("y")).alias("y1"))


def measured(pts) -> Column:
    """Segments with ``before``, the length of the line up to each."""
    s = segments(pts)
    return F.transform(s, lambda t, i: F.struct(t["x0"].alias("x0"), t["y0"].alias("y0"), t["x1"].alias("x1"), t["y1"].alias("y1"), t["len"].alias("len"), _sum(F.transform(F.slice(s, F.lit(1), i), lambda u: u["len"])).alias("before")))


def cumulative(pts) -> Column:
    """The distance of each vertex from the line's start."""
    return F.concat(F.array(F.lit(0.0)), F.transform(measured(pts), lambda s: s["before"] + s["len"]))


def interpolate(pts, distance) -> Column:
    """The point so far along the line; before its start the first point, beyond its end the last."""
    d = F.greatest(F.lit(0.0), F.least(_c(distance), length(pts)))
    on = F.filter(measured(pts), lambda s: (s["before"] <= d) & (s["len"] > 0))
    s = F.try_element_at(on, F.lit(-1))
    t = F.try_divide(d - s["before"], s["len"])
    first = F.get(_c(pts), F.lit(0))
    return F.when(s.isNull(), first).otherwise(F.struct((s["x0"] + t * (s["x1"] - s["x0"])).alias("x"), (s["y0"] + t * (s["y1"] - s["y0"])).alias("y")))


def _nearest(s: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """How far along a segment its nearest point to (x, y) lies, and the squared distance to it."""
    dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - s["x0"]) * dx + (y - s["y0"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return t * s["len"], F.pow(x - s["x0"] - t * dx, 2) + F.pow(y - s["y0"] - t * dy, 2)


def project(pts, x, y) -> Column:
    """The distance along the line of its point nearest to (x, y), the first of equals."""
    x, y = _c(x), _c(y)

    def one(s):
        along, d2 = _nearest(s, x, y)
        return F.struct(d2.alias("d2"), (s["before"] + along).alias("at"))

    return F.array_min(F.transform(measured(pts), one))["at"]


def distance(pts, x, y) -> Column:
    x, y = _c(x), _c(y)
    return F.sqrt(F.array_min(F.transform(segments(pts), lambda s: _nearest(s, x, y)[1])))


def substring(pts, start, end) -> Column:
    """The line between two distances, in their order along it; both are held to its length."""
    n = length(pts)
    hold = lambda d: F.greatest(F.lit(0.0), F.least(_c(d), n))
    low, high = F.least(hold(start), hold(end)), F.greatest(hold(start), hold(end))
    inner = F.transform(F.filter(measured(pts), lambda s: (s["before"] > low) & (s["before"] < high)), lambda s: point(s["x0"], s["y0"]))
    return F.concat(F.array(interpolate(pts, low)), inner, F.array(interpolate(pts, high)))


def inside(ring, x, y) -> Column:
    """Even-odd rule."""
    x, y = _c(x), _c(y)
    cuts = F.filter(segments(closed(ring)), lambda s: ((s["y0"] > y) != (s["y1"] > y)) & (x < s["x0"] + F.try_divide((s["x1"] - s["x0"]) * (y - s["y0"]), s["y1"] - s["y0"])))
    return F.size(cuts) % 2 == 1


def touches(pts, x0, y0, x1, y1) -> Column:
    """Whether a line enters the box: some segment has a stretch of its way inside it on both axes."""
    x0, y0, x1, y1 = (_c(v) for v in (x0, y0, x1, y1))

    def crosses(s):
        def span(a, b, low, high):
            """Where on the segment, from 0 to 1, an axis lies between low and high; nothing (1 before 0) if it never does."""
            d = b - a
            p, q = F.try_divide(low - a, d), F.try_divide(high - a, d)
            flat = (a >= low) & (a <= high)
            return F.when(d == 0, F.when(flat, 0.0).otherwise(2.0)).otherwise(F.least(p, q)), F.when(d == 0, F.when(flat, 1.0).otherwise(-2.0)).otherwise(F.greatest(p, q))

        (a0, a1), (b0, b1) = span(s["x0"], s["x1"], x0, x1), span(s["y0"], s["y1"], y0, y1)
        return F.greatest(a0, b0, F.lit(0.0)) <= F.least(a1, b1, F.lit(1.0))

    return F.exists(segments(pts), crosses)


def valid(pts, least: int = 2) -> Column:
    """Enough points, all with both coordinates."""
    p = _c(pts)
    return p.isNotNull() & (F.size(p) >= least) & F.forall(p, lambda t: t["x"].isNotNull() & t["y"].isNotNull())


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_PAIR = rf"\s*{_NUMBER}\s+{_NUMBER}(?:\s+{_NUMBER})?\s*"


def from_wkt(text) -> Column:
    """The parts of a WKT point, line, polygon or multi-geometry as array<points>; null for what is none of these.

    Holes are parts like others: under the even-odd rule they are outside.
    """
    t = F.upper(F.trim(_c(text)))
    good = F.regexp_like(t, F.lit(rf"^(MULTI)?(POINT|LINESTRING|POLYGON)\s*(Z\s*)?[(][-+0-9.eE,\s()]+[)]$")) & (F.char_length(F.replace(t, F.lit("("), F.lit(""))) == F.char_length(F.replace(t, F.lit(")"), F.lit(""))))
    lists = F.regexp_extract_all(t, F.lit(rf"[(]({_PAIR}(?:,{_PAIR})*)[)]"), F.lit(1))

    def points(part):
        return F.transform(F.split(part, ","), lambda p: F.struct(F.element_at(F.split(F.trim(p), r"\s+"), 1).try_cast("double").alias("x"), F.element_at(F.split(F.trim(p), r"\s+"), 2).try_cast("double").alias("y")))

    return F.when(good & (F.size(lists) > 0), F.transform(lists, points))


def from_geojson(text) -> Column:
    """The parts of a GeoJSON geometry, or of a feature's, as array<points>; null for what is none."""
    c = _c(text)
    own = F.coalesce(F.get_json_object(c, "$.geometry"), c)
    kind, coordinates = F.get_json_object(own, "$.type"), F.get_json_object(own, "$.coordinates")
    pts = lambda a: F.transform(a, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    one = F.array(pts(F.array(F.from_json(coordinates, "array<double>"))))
    flat = F.array(pts(F.from_json(coordinates, "array<array<double>>")))
    parts = F.transform(F.from_json(coordinates, "array<array<array<double>>>"), pts)
    many = F.transform(F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>")), pts)
    found = F.when(kind == "Point", one).when(kind.isin("LineString", "MultiPoint"), flat).when(kind.isin("Polygon", "MultiLineString"), parts).when(kind == "MultiPolygon", many)
    return F.when(F.forall(found, lambda p: valid(p, 1)), found)


def _pairs(pts: Column, form: str) -> Column:
    return F.transform(_c(pts), lambda p: F.format_string(form, p["x"].cast("string"), p["y"].cast("string")))


def to_wkt(pts, kind: str = "LINESTRING") -> Column:
    body = F.array_join(_pairs(pts, "%s %s"), ", ")
    return F.concat(F.lit(f"{kind} (("), body, F.lit("))")) if kind == "POLYGON" else F.concat(F.lit(f"{kind} ("), body, F.lit(")"))


def to_geojson(pts, kind: str = "LineString") -> Column:
    body = F.array_join(_pairs(pts, "[%s,%s]"), ",")
    left, right = ("[[", "]]") if kind == "Polygon" else ("[", "]")
    return F.concat(F.lit('{"type":"' + kind + '","coordinates":' + left), body, F.lit(right + "}"))
