"""Outlines of masks as polygons: directed sides, chained into rings by list ranking, holes given to their shells.

A side runs with its cell on the left, so shells turn left and holes right. Sides are chained within tiles first; only
the ends of these chains point to each other, and their places on a ring are found by doubling pointers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwork.sources.tables import forget, written

_POINT = "struct<x: int, y: int>"


def _sides(cells: DataFrame, n: int) -> DataFrame:
    """(zone, id, x0, y0, x1, y1) in corners of cells: the sides that no two cells of one zone share."""
    r, c = F.col("r").cast("int"), F.col("c").cast("int")
    ways = [(c, r + 1, c + 1, r + 1), (c + 1, r + 1, c + 1, r), (c + 1, r, c, r), (c, r, c, r + 1)]
    each = [F.struct(((r.cast("long") * n + c) * 4 + k).alias("id"), *[v.alias(name) for name, v in zip(("x0", "y0", "x1", "y1"), way, strict=True)]) for k, way in enumerate(ways)]
    sides = cells.select("zone", F.explode(F.array(*each)).alias("s")).select("zone", "s.*")
    key = [F.least("x0", "x1").alias("kx"), F.least("y0", "y1").alias("ky"), (F.col("x0") == F.col("x1")).alias("up")]
    alone = sides.groupBy("zone", *key).agg(F.count("*").alias("k"), F.min(F.struct("id", "x0", "y0", "x1", "y1")).alias("s")).where("k = 1")
    return alone.select("zone", "s.*")


def _linked(sides: DataFrame) -> DataFrame:
    """The sides with ``to``, the side that follows: where two start at a corner, the one of the same cell, so cells that
    touch at a corner only have outlines of their own. At a corner at most two sides end and two start."""
    ends = sides.select("zone", F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("id").alias("i"), F.lit(None).cast("long").alias("o"))
    starts = sides.select("zone", F.col("x0").alias("x"), F.col("y0").alias("y"), F.lit(None).cast("long").alias("i"), F.col("id").alias("o"))
    met = ends.union(starts).groupBy("zone", "x", "y").agg(F.collect_list("i").alias("i"), F.sort_array(F.collect_list("o")).alias("o"))
    own = lambda i, o: F.coalesce(F.get(F.filter(o, lambda k: F.floor(k / 4) == F.floor(i / 4)), 0), F.get(o, 0))
    to = met.select(F.explode(F.transform("i", lambda i: F.struct(i.alias("id"), own(i, F.col("o")).alias("to")))).alias("p")).select("p.*")
    return sides.join(to, "id")


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sides of one tile as chains: the first side's id, the side after the last one, how many, and the corners at which they turn."""
    ids, to = pdf["id"].tolist(), pdf["to"].tolist()
    at = {x: k for k, x in enumerate(ids)}
    x, y, zone = pdf["x0"].tolist(), pdf["y0"].tolist(), pdf["zone"].tolist()
    flat = (pdf["x0"] != pdf["x1"]).tolist()
    inner = {t for t in to if t in at}
    out, seen = [], np.zeros(len(ids), bool)
    heads = [k for k in range(len(ids)) if ids[k] not in inner]
    for k in [*heads, *sorted(range(len(ids)), key=ids.__getitem__)]:  # then rings that lie in the tile whole
        if seen[k]:
            continue
        first, last, points, size = k, None, [], 0
        while k is not None and not seen[k]:
            seen[k] = True
            if last is None or flat[k] != flat[last]:
                points.append((x[k], y[k]))
            last, size = k, size + 1
            k = at.get(to[k])
        out.append((ids[first], to[last], zone[first], size, [p[0] for p in points], [p[1] for p in points]))
    return pd.DataFrame(out, columns=["id", "to", "zone", "size", "xs", "ys"])


def _ranked(chains: DataFrame) -> DataFrame:
    """(id, ring, before) of chains (id, to, size): the least id on the ring, and how many sides of the ring, from its
    start, come before. Both by doubling, so rounds grow with the logarithm of the chains on a ring."""
    state = written(chains.select("id", "to", F.col("id").alias("ring")))
    while True:
        hop = state.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("ring").alias("other"))
        new = written(state.join(hop, "to").select("id", F.col("far").alias("to"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("moved")))
        moved = not new.where("moved").isEmpty()
        forget(state)
        state = new.select("id", "to", "ring")
        if not moved:
            break
    rings = state.select("id", "ring")
    # from each chain to the ring's start: what is left of the ring
    left = chains.select("id", "to", F.col("size").alias("rest")).join(rings, "id").select("id", "ring", "rest", F.when(F.col("to") != F.col("ring"), F.col("to")).alias("to"))
    left = written(left)
    while not left.where("to is not null").isEmpty():
        hop = left.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("rest").alias("more"))
        new = written(left.join(hop, "to", "left").select("id", "ring", (F.col("rest") + F.coalesce("more", F.lit(0))).alias("rest"), F.col("far").alias("to")))
        forget(left)
        left = new
    whole = left.where("id = ring").select("ring", F.col("rest").alias("all"))
    return left.join(whole, "ring").select("id", "ring", (F.col("all") - F.col("rest")).alias("before"))


def _around(points: Column, body) -> Column:
    """body(point before, point, point after) for each point of a closed ring."""
    k = F.size(points)
    return F.transform(points, lambda p, i: body(F.get(points, (i + k - 1) % k), p, F.get(points, (i + 1) % k)))


def rings(cells: DataFrame, n: int, tile: int = 256) -> DataFrame:
    """(zone, ring, area, points, start): the closed outlines of the cells (r, c, zone) of an n x n grid.

    points are the corners where a ring turns, in corners of cells, without the first one again; area is in cells,
    below 0 for a hole. A ring's points are one value, as in a polygon; all before is distributed.
    """
    linked = _linked(written(_sides(cells, n)))
    at = [F.floor(F.col("x0") / tile).alias("tx"), F.floor(F.col("y0") / tile).alias("ty")]
    chains = written(linked.groupBy(*at).applyInPandas(_chain, "id long, to long, zone long, size long, xs array<int>, ys array<int>"))
    placed = chains.join(_ranked(chains), "id").select("zone", "ring", "before", F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y")).cast(f"array<{_POINT}>").alias("points"))
    whole = placed.groupBy("zone", "ring").agg(F.sort_array(F.collect_list(F.struct("before", "points"))).alias("all"))
    whole = whole.select("zone", "ring", F.flatten(F.transform("all", lambda x: x["points"])).alias("points"))
    # where chains met the line may go straight on
    turns = _around(F.col("points"), lambda a, p, b: F.when(((a["x"] == p["x"]) & (p["x"] == b["x"])) | ((a["y"] == p["y"]) & (p["y"] == b["y"])), F.lit(None)).otherwise(p))
    whole = whole.withColumn("points", F.array_compact(turns))
    twice = _around(F.col("points"), lambda a, p, b: (p["y"].cast("double") * b["x"] - p["x"].cast("double") * b["y"]))
    return whole.withColumn("area", F.aggregate(twice, F.lit(0.0), lambda s, v: s + v) / 2)


def polygons(cells: DataFrame, n: int, cell: float, x0: float = 0.0, y0: float | None = None, tile: int = 256) -> DataFrame:
    """(zone, shell, area_m2, perimeter_m, holes, parts, wkt): each zone's cells as polygons with holes.

    Cells that touch at a corner only are not connected, so a zone may have several polygons. The grid's top left
    corner is x0, y0 (n cells high above 0 by default). Each hole goes to the shell around it: in the row of a hole's
    leftmost side the next side to the left is its shell's, or that of a hole of the same shell. Repeated cells count
    once; an empty mask gives no row. ``zone`` is a whole number.
    """
    mask = cells.where("zone is not null").select("r", "c", F.col("zone").cast("long").alias("zone")).distinct()
    found = written(rings(mask, n, tile))
    top = n * cell if y0 is None else y0
    # vertical sides of each ring, a row at a time
    walls = found.select("zone", "ring", F.explode(_around(F.col("points"), lambda a, p, b: F.when(p["x"] == b["x"], F.struct(p["x"].alias("x"), F.least(p["y"], b["y"]).alias("y0"), (F.greatest(p["y"], b["y"]) - 1).alias("y1"))))).alias("w")).where("w is not null")
    first = found.where("area < 0").join(walls.groupBy("ring").agg(F.min(F.struct("w.x", "w.y0")).alias("m")), "ring").select("zone", "ring", F.col("m.x").alias("x"), F.col("m.y0").alias("y"))
    rows = walls.select("zone", "ring", F.col("w.x").alias("x"), F.explode(F.sequence("w.y0", "w.y1")).alias("y")).join(first.select("zone", "y").distinct(), ["zone", "y"], "left_semi")
    before = rows.withColumn("up", F.lag("ring").over(Window.partitionBy("zone", "y").orderBy("x", "ring")))
    up = written(first.join(before, ["zone", "ring", "x", "y"]).select("ring", "up").union(found.where("area > 0").select("ring", F.col("ring").alias("up"))))
    while True:
        far = up.select(F.col("ring").alias("up"), F.col("up").alias("far"))
        new = written(up.join(far, "up").select("ring", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")))
        moved = not new.where("moved").isEmpty()
        forget(up)
        up = new.select("ring", "up")
        if not moved:
            break
    place = F.transform("points", lambda p: F.struct((x0 + p["x"] * cell).alias("x"), (top - p["y"] * cell).alias("y")))
    length = F.aggregate(_around(F.col("points"), lambda a, p, b: F.abs(p["x"] - b["x"]) + F.abs(p["y"] - b["y"])), F.lit(0), lambda s, v: s + v) * cell
    each = found.join(up, "ring").select("zone", F.col("up").alias("shell"), (F.col("ring") != F.col("up")).alias("hole"), F.col("ring"), "area", length.alias("length"), place.alias("points"))
    one = each.groupBy("zone", "shell").agg(
        (F.sum("area") * cell * cell).alias("area_m2"), F.sum("length").alias("perimeter_m"), F.sum(F.col("hole").cast("int")).cast("int").alias("holes"),
        F.transform(F.sort_array(F.collect_list(F.struct("hole", "ring", "points"))), lambda x: x["points"]).alias("parts"),
    )
    number = lambda v: F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", "")
    pair = lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"]))
    text = F.transform("parts", lambda ps: F.concat(F.lit("("), F.array_join(F.transform(F.concat(ps, F.slice(ps, 1, 1)), pair), ", "), F.lit(")")))
    return one.withColumn("wkt", F.concat(F.lit("POLYGON ("), F.array_join(text, ", "), F.lit(")")))
