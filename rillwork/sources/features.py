"""Lines and polygons from GeoJSON files and text, and tables of lines as GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions import geometry as G
from rillwork.functions import projection as P


def read_features(spark: SparkSession, path: str, epsg: int = 4326, to_epsg: int | None = None) -> DataFrame:
    """(path, seq, parts, props) of the features in GeoJSON files; those without a geometry are left out.

    A file may be one feature collection, or have a feature on each line. props maps names to texts. With ``to_epsg``
    coordinates are taken from the system ``epsg`` to that one.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    whole = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    each = text.select("path", F.posexplode(F.coalesce(whole, lines)).alias("seq", "feature"))
    props = F.from_json(F.get_json_object("feature", "$.properties"), "map<string, string>")
    out = each.select("path", "seq", G.from_geojson("feature").alias("parts"), props.alias("props"))
    out = out.where("parts is not null and size(parts) > 0")
    return out if to_epsg is None else out.withColumn("parts", P.to_crs(F.col("parts"), epsg, to_epsg))


def read_contours(spark: SparkSession, path: str, field: str = "ELEV") -> DataFrame:
    """(id, elevation, pts) of contour lines, each part a line of its own; lines of fewer than two points are left out."""
    parts = read_features(spark, path).select("path", "seq", F.posexplode("parts").alias("part", "pts"), F.col("props")[field].try_cast("double").alias("elevation"))
    return parts.where(G.valid("pts")).select(F.xxhash64("path", "seq", "part").alias("id"), "elevation", "pts")


def as_features(lines: DataFrame, pts: str, *props: str) -> DataFrame:
    """One GeoJSON feature a row, as ``value``: written as text, it is a file with a feature on each line."""
    head = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*props)), F.lit(',"geometry":'))
    return lines.select(F.concat(head, G.to_geojson(pts), F.lit("}")).alias("value"))
