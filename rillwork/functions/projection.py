"""Map projections as columns: longitude and latitude, UTM zones by the transverse Mercator series, and web Mercator."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Axis and flattening of the WGS 84 and the GRS 80 ellipsoid.
WGS84, GRS80 = (6378137.0, 1 / 298.257223563), (6378137.0, 1 / 298.257222101)
#: The series of the projection and of its inverse, by powers of the third flattening from the first.
FORWARD = [[1 / 2, -2 / 3, 5 / 16, 41 / 180], [0, 13 / 48, -3 / 5, 557 / 1440], [0, 0, 61 / 240, -103 / 140], [0, 0, 0, 49561 / 161280]]
BACKWARD = [[1 / 2, -2 / 3, 37 / 96, -1 / 360], [0, 1 / 48, 1 / 15, -437 / 1440], [0, 0, 17 / 480, -37 / 840], [0, 0, 0, 4397 / 161280]]
LATITUDE = [[2, -2 / 3, -2, 116 / 45], [0, 7 / 3, -8 / 5, -227 / 45], [0, 0, 56 / 15, -136 / 35], [0, 0, 0, 4279 / 630]]
#: Codes of longitude and latitude in degrees.
DEGREES = {4326, 4258}
SCALE, EASTING, SOUTH = 0.9996, 500000.0, 10000000.0


@dataclass(frozen=True)
class Zone:
    """A transverse Mercator zone: ellipsoid, central meridian in degrees and northing of the equator."""

    ellipsoid: tuple[float, float]
    meridian: float
    northing: float

    @property
    def third(self) -> float:
        return self.ellipsoid[1] / (2 - self.ellipsoid[1])

    @property
    def radius(self) -> float:
        n = self.third
        return SCALE * self.ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def series(self, rows: list[list[float]]) -> list[float]:
        return [sum(c * self.third ** (k + 1) for k, c in enumerate(row)) for row in rows]


def zone(epsg: int) -> Zone:
    """UTM zones of WGS 84 (32601-32660 north, 32701-32760 south) and of ETRS 89 (25828-25838)."""
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return Zone(WGS84, epsg % 100 * 6.0 - 183, SOUTH if epsg > 32700 else 0.0)
    if 25828 <= epsg <= 25838:
        return Zone(GRS80, epsg % 100 * 6.0 - 183, 0.0)
    raise ValueError(f"EPSG:{epsg} is not known")


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def to_zone(lon: Column, lat: Column, z: Zone) -> Column:
    e = 2 * math.sqrt(z.third) / (1 + z.third)
    sine, turn = F.sin(F.radians(lat)), F.radians(lon - z.meridian)
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    a = z.series(FORWARD)
    x = sum((c * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, c in enumerate(a, 1)), eta)
    y = sum((c * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, c in enumerate(a, 1)), xi)
    return _point(EASTING + z.radius * x, z.northing + z.radius * y)


def from_zone(x: Column, y: Column, z: Zone) -> Column:
    xi, eta = (y - z.northing) / z.radius, (x - EASTING) / z.radius
    b = z.series(BACKWARD)
    north = sum((-c * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, c in enumerate(b, 1)), xi)
    east = sum((-c * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, c in enumerate(b, 1)), eta)
    chi = F.asin(F.sin(north) / F.cosh(east))
    lat = sum((c * F.sin(2 * k * chi) for k, c in enumerate(z.series(LATITUDE), 1)), chi)
    return _point(z.meridian + F.degrees(F.atan2(F.sinh(east), F.cos(north))), F.degrees(lat))


def transform(x: Column, y: Column, source: int, target: int) -> Column:
    """struct<x, y> of a point given in one system, in another, by their EPSG numbers; degrees are longitude, latitude.

    WGS 84 and ETRS 89 are taken as one datum. A null coordinate gives nulls, and so does a place that the target
    cannot show, such as a pole in a zone. Numbers that are not known are an error.
    """
    if source == target:
        return _point(x, y)
    r = WGS84[0]
    if source in DEGREES:
        degrees = _point(x, y)
    elif source == 3857:
        degrees = _point(F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2))
    else:
        degrees = from_zone(x, y, zone(source))
    if target in DEGREES:
        return degrees

    def project(p: Column) -> Column:
        lon, lat = p["x"], p["y"]
        if target == 3857:
            out = _point(F.radians(lon) * r, F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)) * r)
        else:
            out = to_zone(lon, lat, zone(target))
        good = F.abs(lat) < 90
        return _point(F.when(good, out["x"]), F.when(good, out["y"]))

    return F.transform(F.array(degrees), project)[0]  # the degrees are computed once


def to_crs(parts: Column, source: int, target: int) -> Column:
    """Lines or rings, array<array<struct<x, y>>>, in another system."""
    return F.transform(parts, lambda pts: F.transform(pts, lambda p: transform(p["x"], p["y"], source, target)))
