"""Lines, polygons and greedy choices over cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwork.functions import geometry as G
from rillwork.sources.tables import forget, written


def with_centres(cells: DataFrame, n: int, cell: float) -> DataFrame:
    """x and y of the true cell centres, north up."""
    return cells.withColumns({"x": (F.col("c") + 0.5) * cell, "y": (F.lit(n) - F.col("r") - 0.5) * cell})


def sample_lines(lines: DataFrame, count: int, n: int, cell: float) -> DataFrame:
    """(id, place, r, c): evenly spaced samples of straight lines, ends included; those off the grid stay, unmatched."""
    s = lines.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    x = F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("place") / float(count - 1)
    y = F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("place") / float(count - 1)
    return s.select("id", "place", F.floor((cell * n - y) / cell).cast("int").alias("r"), F.floor(x / cell).cast("int").alias("c"))


def distance(x, y, x0, y0, x1, y1) -> Column:
    """From a point to a segment."""
    x, y, x0, y0, x1, y1 = (F.col(v) if isinstance(v, str) else F.lit(v) for v in (x, y, x0, y0, x1, y1))
    dx, dy = x1 - x0, y1 - y0
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - x0) * dx + (y - y0) * dy, dx * dx + dy * dy), F.lit(0.0))))
    a, b = x - x0 - t * dx, y - y0 - t * dy
    return F.sqrt(a * a + b * b)


def inside(polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule at the cell centre."""
    x, y, odd = F.col("x"), F.col("y"), F.lit(0)
    for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y0 != y1:
            cuts = ((y > y0) != (y > y1)) & (x < x0 + (x1 - x0) * (y - y0) / (y1 - y0))
            odd = odd + cuts.cast("int")
    return odd % 2 == 1


def near(line: list[tuple[float, float]], radius: float) -> Column:
    """Centre within ``radius`` of a polyline."""
    parts = [distance("x", "y", *a, *b) <= radius for a, b in zip(line, line[1:], strict=False)]
    return reduce(lambda p, q: p | q, parts)


def burn(cells: DataFrame, works: list[tuple]) -> DataFrame:
    """Applies (kind, points, depth, width, crest) in their order, as one projection over x, y, z.

    Swales and basins lower, berms raise, dams raise to their crest at most; a dam without a crest is a berm.
    """
    z = F.col("z")
    for kind, points, depth, width, crest in works:
        where = inside(points) if kind == "basin" else near(points, width / 2)
        new = z - depth if kind in ("swale", "basin") else F.greatest(z, F.lit(crest)) if kind == "dam" and crest is not None else z + depth
        z = F.when(where, new).otherwise(z)
    return cells.withColumn("z", z)


def companion_side(cells: DataFrame, line: list[tuple[float, float]], width: float) -> DataFrame:
    """One row: which side of a swale has the lower mean, with the cells of the swale and of both sides."""
    (x0, y0), (x1, y1) = line[0], line[-1]
    side = (F.col("x") - x0) * (y1 - y0) - (F.col("y") - y0) * (x1 - x0)
    d = reduce(F.least, [distance("x", "y", *a, *b) for a, b in zip(line, line[1:], strict=False)]) if len(line) > 2 else distance("x", "y", *line[0], *line[1])
    ring = (d > width / 2) & (d <= 1.5 * width)
    return cells.withColumns({"_d": d, "_s": side}).agg(
        F.avg(F.when(ring & (F.col("_s") < 0), F.col("z"))).alias("left"), F.avg(F.when(ring & (F.col("_s") > 0), F.col("z"))).alias("right"), F.count_if(F.col("_d") <= width / 2).alias("n_swale"),
        F.count_if(ring & (F.col("_s") < 0)).alias("n_left"), F.count_if(ring & (F.col("_s") > 0)).alias("n_right"),
    )


def burn_diversion(cells: DataFrame, points: list[tuple[float, float]], depth: float, width: float, gradient_pct: float, n: int, cell: float) -> DataFrame:
    """Lowers cells to a floor that falls from the ground at the first vertex; each segment has samples a third of a cell apart.

    ``points`` are the vertices. A line of one vertex or without length changes nothing. The ground at the start is
    taken from the nearest cell of the grid.
    """
    spans = [(a, b, ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5) for a, b in zip(points, points[1:], strict=False)]
    if not sum(s[2] for s in spans):
        return cells
    start = points[0]
    r, c = min(n - 1, max(0, int((cell * n - start[1]) / cell))), min(n - 1, max(0, int(start[0] / cell)))
    top = cells.where((F.col("r") == r) & (F.col("c") == c)).select(F.col("z").alias("top"))
    out, before = None, 0.0
    for a, b, length in spans:
        if not length:
            continue
        steps = max(2, int(length / cell * 3))
        t = F.col("k") / float(steps)
        far = F.sqrt(F.pow(F.col("x") - (a[0] + t * (b[0] - a[0])), 2) + F.pow(F.col("y") - (a[1] + t * (b[1] - a[1])), 2))
        close = cells.where(distance("x", "y", *a, *b) <= width / 2)
        floors = close.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps)))).where(far <= width / 2)
        floors = floors.select("r", "c", (before + t * length).alias("d"))
        out, before = floors if out is None else out.unionAll(floors), before + length
    lowest = out.groupBy("r", "c").agg(F.max("d").alias("d")).join(F.broadcast(top), F.lit(True)).select("r", "c", (F.col("top") - F.col("d") * (gradient_pct / 100.0) - depth).alias("floor"))
    return cells.join(lowest, ["r", "c"], "left").withColumn("z", F.least("z", F.coalesce("floor", "z"))).drop("floor")


#: Side of the tiles in which ``all_apart`` takes cells, in cells.
APART_TILE = 1024


def _apart_in_tile(pdf: pd.DataFrame, apart: float) -> pd.DataFrame:
    """The own cells of a tile that are taken or still open, from all cells within ``apart`` of it that are.

    From the greatest down a cell goes if one is taken within that distance, and is taken if none is open there
    either. Of cells beyond the tile not all neighbours are here: those that do not go stay as they came.
    """
    pdf = pdf.sort_values(["last", "v", "r", "c"], ascending=[True, False, True, True])
    side, least = max(1, int(apart / 2**0.5)), apart * apart
    reach = int(apart / side) + 1
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    taken, undecided = {}, {}  # by blocks of which no two cells can be taken
    for r, c in pdf.loc[pdf["won"], ["r", "c"]].itertuples(index=False):
        taken[r // side, c // side] = (r, c)
    state = []
    for r, c, won, own in zip(*(pdf[k].tolist() for k in ("r", "c", "won", "own")), strict=True):
        if won:
            state.append(1)
            continue
        i, j = r // side, c // side
        near = [(i + di, j + dj) for di, dj in steps]
        if any((t := taken.get(k)) and (t[0] - r) ** 2 + (t[1] - c) ** 2 < least for k in near):
            state.append(0)
        elif not own or any((x - r) ** 2 + (y - c) ** 2 < least for k in near for x, y in undecided.get(k, ())):
            undecided.setdefault((i, j), []).append((r, c))
            state.append(2)
        else:
            taken[i, j] = (r, c)
            state.append(1)
    state = np.array(state, np.int8)
    pdf["won"] = state == 1
    return pdf.loc[pdf["own"] & (state > 0), ["r", "c", "v", "last", "won"]]


def all_apart(cells: DataFrame, by: str, apart: float) -> DataFrame:
    """Cells (r, c, by) from the greatest value down, each at least ``apart`` cells from all taken before it; ties by row and column.

    A tile takes its own cells in that order, but for those that wait for a greater one beyond its edge. Rounds follow
    until none waits; the greatest cell left never does. A chain of cells of which each waits for the next takes a
    round for each tile that it crosses.
    """
    tile, reach = max(APART_TILE, math.ceil(apart)), math.ceil(apart)
    given = written(cells.select("r", "c", by))
    value = F.col(by).cast("double")
    last = F.when(value.isNull(), 2).when(F.isnan(value), 0).otherwise(1)  # pandas does not tell null from NaN, the greatest
    state = written(given.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), value.alias("v"), last.alias("last"), F.lit(False).alias("won")))
    ranges = lambda x: F.explode(F.sequence(F.floor((F.col(x) - reach) / tile), F.floor((F.col(x) + reach) / tile)))
    own = (F.floor(F.col("r") / tile) == F.col("tr")) & (F.floor(F.col("c") / tile) == F.col("tc"))
    while not state.where("not won").isEmpty():
        dealt = state.withColumn("tr", ranges("r")).withColumn("tc", ranges("c")).withColumn("own", own)
        new = written(dealt.groupBy("tr", "tc").applyInPandas(lambda pdf: _apart_in_tile(pdf, apart), "r int, c int, v double, last int, won boolean"))
        forget(state)
        state = new
    return given.join(state.select("r", "c"), ["r", "c"], "left_semi")


def auto_outlets(acc: DataFrame, n: int, threshold: float, apart: float = 20.0) -> DataFrame:
    """(r, c, acc) of the outlets of an n x n grid: rim cells with as much flow, from the greatest down and so far apart.

    Where no rim cell has that much, the cell of the greatest flow anywhere, the first of equals by row and column.
    """
    rim = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == n - 1) | (F.col("c") == n - 1)
    edge = written(acc.where(rim & (F.col("acc") >= threshold)).select("r", "c", "acc"))
    if not edge.isEmpty():
        return all_apart(edge, "acc", apart)
    best = acc.where("acc is not null").agg(F.max_by(F.struct("r", "c", "acc"), F.struct("acc", -F.col("r"), -F.col("c"))).alias("b"))
    return best.where("b is not null").select("b.*")


def greedy_apart(cells: DataFrame, by: str, apart: float, most: int, square: bool = False) -> DataFrame:
    """Up to ``most`` cells from the greatest value down, each at least ``apart`` cells from all taken before.

    Each round is an aggregation that returns one cell; nothing is gathered.
    """
    spark, taken, left = cells.sparkSession, [], cells
    for rank in range(1, most + 1):
        best = left.agg(F.max(F.struct(F.col(by), (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))).alias("m")).first()["m"]
        if best is None:
            break
        r, c = -best["r"], -best["c"]
        taken.append((rank, r, c, float(best[by])))
        dr, dc = F.col("r") - r, F.col("c") - c
        left = left.where(~((dr >= -apart) & (dr < apart) & (dc >= -apart) & (dc < apart))) if square else left.where(dr * dr + dc * dc >= apart * apart)
    return spark.createDataFrame(taken, f"rank int, r int, c int, {by} double")


def contour_quads(cells: DataFrame, step: float) -> DataFrame:
    """(r, c, level) of each 2 x 2 quad that a level crosses: lead along rows, then along columns."""
    row, col = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    pair = cells.withColumn("e", F.lead("z").over(row))
    pair = pair.withColumns({"lo": F.least("z", "e"), "hi": F.greatest("z", "e")}).where("e is not null")
    both = pair.withColumns({"lo2": F.lead("lo").over(col), "hi2": F.lead("hi").over(col)}).where("lo2 is not null")
    low, high = F.least("lo", "lo2"), F.greatest("hi", "hi2")
    first, last = F.ceil(low / step), F.ceil(high / step) - 1
    return both.where(first <= last).select("r", "c", F.explode(F.sequence(first, last)).alias("k")).select("r", "c", (F.col("k") * step).alias("level"))


def pond_sites(keys: DataFrame, cells: DataFrame, acc: DataFrame, radius: int, n: int, cell: float, cut_left: bool = True) -> DataFrame:
    """For each keypoint (rank, kr, kc) the cell of most flow per width of its valley, within ``radius`` cells of it.

    Only inner cells with more flow than the keypoint, and at most four times as much, are looked at; the first of
    equals by row and column wins. A width counts cells of the row, up to 200 to each side, that lie no higher than
    2 m above the site. cut_left: a row that does not reach 200 cells to the left has no width. A keypoint without
    such a cell is its own site, of ten cells' width.
    """
    k = F.broadcast(keys)  # as many rows as keypoints were asked for
    at_key = k.join(acc.withColumnsRenamed({"r": "kr", "c": "kc", "acc": "k_acc"}), ["kr", "kc"]).join(cells.select(F.col("r").alias("kr"), F.col("c").alias("kc"), F.col("z").alias("k_z")), ["kr", "kc"])
    at_key = written(at_key)
    # each keypoint's window is spelled out, so cells meet it by equality
    window = at_key.withColumn("r", F.explode(F.sequence(F.greatest(F.lit(1), F.col("kr") - radius), F.least(F.lit(n - 2), F.col("kr") + radius))))
    window = window.withColumn("c", F.explode(F.sequence(F.greatest(F.lit(1), F.col("kc") - radius), F.least(F.lit(n - 2), F.col("kc") + radius))))
    around = cells.join(window, ["r", "c"]).join(acc, ["r", "c"]).where("acc > k_acc and acc <= 4 * k_acc")
    if cut_left:
        around = around.where("c >= 200")
    # the row is looked at in stretches of 200 columns, so no site meets a whole row
    sites = written(around.select("rank", "r", "c", "z", "acc"))
    stretch = sites.select("*", F.explode(F.sequence(F.floor((F.col("c") - 200) / 200), F.floor((F.col("c") + 200) / 200))).alias("part"))
    row = cells.select("r", F.floor(F.col("c") / 200).alias("part"), F.col("c").alias("oc"), F.col("z").alias("oz"))
    wide = stretch.join(row, ["r", "part"]).where((F.abs(F.col("oc") - F.col("c")) <= 200) & (F.col("oz") <= F.col("z") + 2)).groupBy("rank", "r", "c", "z", "acc").agg((F.count("*") * cell).alias("width_m"))
    best = F.max_by(F.struct("r", "c", "z", "acc", "width_m"), F.struct(F.col("acc") / (F.col("width_m") + 1), -F.col("r"), -F.col("c"))).alias("s")
    found = at_key.join(wide.groupBy("rank").agg(best), "rank", "left")
    own = F.struct(F.col("kr").alias("r"), F.col("kc").alias("c"), F.col("k_z").alias("z"), F.col("k_acc").alias("acc"), F.lit(10.0 * cell).alias("width_m"))
    return found.select("rank", F.coalesce("s", own).alias("s")).select("rank", "s.*")


def cultivation_levels(keys: DataFrame, each_side: int = 2, spacing_m: float = 5.0) -> DataFrame:
    """(elevation, keypoint, step, line_type, label) from keypoints (kp, base): the keyline and lines on both sides of it.

    An elevation that several have is the first keypoint's, of its lowest step.
    """
    e = keys.select("kp", F.explode(F.sequence(F.lit(-each_side), F.lit(each_side))).alias("step"), "base").select("kp", "step", F.round(F.col("base") + F.col("step") * spacing_m, 2).alias("elevation"))
    once = e.groupBy("elevation").agg(F.min(F.struct("kp", "step")).alias("s")).select("elevation", F.col("s.kp").alias("keypoint"), "s.step")
    kind = F.when(F.col("step") == 0, "keyline").when(F.col("step") > 0, "cultivation_upper").otherwise("cultivation_lower")
    sign = F.when(F.col("step") > 0, "+").otherwise("")
    name = F.when(F.col("step") == 0, F.concat(F.lit("Keyline "), "keypoint")).otherwise(F.concat(F.lit("Cultivation "), "keypoint", F.lit(" ("), sign, "step", F.lit(")")))
    return once.withColumns({"line_type": kind, "label": F.concat(name, F.lit(" — "), F.format_string("%.1f m", "elevation"))})


def global_rank(df: DataFrame, name: str, *order) -> DataFrame:
    """row_number over all rows in this order, which must tell all rows apart, without gathering them in one task.

    Rows are sorted by range; each range counts its own, and starts where the ranges before it end.
    """
    sorted_rows = written(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    before = sorted_rows.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as partitions
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return sorted_rows.withColumn(name, within).join(F.broadcast(before), "_part").withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_part", "_before")


def profile(lines: DataFrame, raster: DataFrame, n: int, cell: float, value: str = "acc") -> DataFrame:
    """(id, i, d, value): samples of lines (id, pts) a cell apart, both ends included; off the raster the value is 0."""
    length = G.length("pts")
    s = lines.withColumn("len", length).where("len >= 1").withColumn("steps", F.greatest(F.lit(2), F.floor(F.col("len") / max(cell, 1.0)).cast("int")))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps") - 1))).withColumn("d", F.col("len") * F.col("i") / (F.col("steps") - 1))
    s = s.withColumn("p", G.interpolate("pts", F.col("d"))).select("id", "len", "i", "d", F.floor((cell * n - F.col("p.y")) / cell).cast("int").alias("r"), F.floor(F.col("p.x") / cell).cast("int").alias("c"))
    return s.join(raster.select("r", "c", value), ["r", "c"], "left").select("id", "len", "i", "d", F.coalesce(value, F.lit(0.0)).cast("double").alias(value))


def peaks(profiles: DataFrame, least: float, most: int = 3, reach: int = 5, skip: int = 10) -> DataFrame:
    """(id, len, i, d, acc) of each profile's peaks: no less than ``least`` or than any sample within ``reach``.

    After a peak the next ``skip`` - 1 samples are passed over. Of each line the ``most`` greatest stay, the first of equals.
    """
    w = Window.partitionBy("id").orderBy("i").rowsBetween(-reach, reach)
    high = profiles.withColumn("m", F.max("acc").over(w)).where((F.col("acc") >= least) & (F.col("acc") >= F.col("m")))
    one = F.sort_array(F.collect_list(F.struct("i", "d", "acc")))
    start = F.struct(F.lit(-skip).alias("last"), F.expr("cast(array() as array<struct<i: int, d: double, acc: double>>)").alias("out"))

    def step(state, x):
        take = x["i"] >= state["last"] + skip
        return F.struct(F.when(take, x["i"]).otherwise(state["last"]).alias("last"), F.when(take, F.array_append(state["out"], x)).otherwise(state["out"]).alias("out"))

    found = high.groupBy("id", "len").agg(one.alias("all")).select("id", "len", F.explode(F.aggregate("all", start, step, lambda s: s["out"])).alias("x")).select("id", "len", "x.*")
    return found.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("acc"), "i"))).where(F.col("_k") <= most).drop("_k")


def sized_segments(found: DataFrame, inflow_m3: Column, section_m2: float) -> DataFrame:
    """Each peak with the stretch of its line that holds its inflow: centred on it, moved along where the line ends; 1 m at least."""
    need = F.greatest(F.lit(1.0), inflow_m3 / section_m2)
    out = found.withColumns({"inflow_m3": inflow_m3, "required_m": need})
    low, high = F.greatest(F.lit(0.0), F.col("d") - F.col("required_m") / 2), F.least(F.col("len"), F.col("d") + F.col("required_m") / 2)
    out = out.withColumns({"_a": low, "_b": high}).withColumn("_short", F.greatest(F.lit(0.0), F.col("required_m") - (F.col("_b") - F.col("_a"))))
    start = F.when(F.col("_a") == 0, F.col("_a")).otherwise(F.greatest(F.lit(0.0), F.col("_a") - F.col("_short")))
    end = F.when(F.col("_a") == 0, F.least("len", F.col("_b") + F.col("_short"))).otherwise(F.col("_b"))
    return out.withColumns({"seg_start": start, "seg_end": end}).where("seg_end - seg_start >= 1").drop("_a", "_b", "_short")


def walked_segments(found: DataFrame, profiles: DataFrame, drop: float) -> DataFrame:
    """Each peak with the stretch around it on which flow never falls below ``drop`` times the peak's."""
    low = profiles.select("id", F.col("i").alias("j"), F.col("acc").alias("v"))
    ends = profiles.groupBy("id").agg(F.max("i").alias("n"))
    cut = found.join(low, "id").where(F.col("v") < F.col("acc") * drop).groupBy("id", "i").agg(F.max(F.when(F.col("j") < F.col("i"), F.col("j"))).alias("a"), F.min(F.when(F.col("j") > F.col("i"), F.col("j"))).alias("b"))
    spans = found.join(cut, ["id", "i"], "left").join(ends, "id").withColumns({"a": F.coalesce(F.col("a") + 1, F.lit(0)), "b": F.coalesce(F.col("b") - 1, "n")})
    at = lambda k, name: profiles.select("id", F.col("i").alias(k), F.col("d").alias(name))
    out = spans.join(at("a", "seg_start"), ["id", "a"]).join(at("b", "seg_end"), ["id", "b"])
    return out.where("seg_end - seg_start >= 1").select("id", "i", "d", "acc", "seg_start", "seg_end", (F.col("seg_end") - F.col("seg_start")).alias("length_m"))


def _edges(polygons: DataFrame) -> DataFrame:
    """(id, seq, x0, y0, x1, y1): the sides of all rings of polygons (id, seq, parts)."""
    return polygons.select("id", "seq", F.explode("parts").alias("ring")).select("id", "seq", F.explode(G.segments(G.closed("ring"))).alias("s")).select("id", "seq", "s.x0", "s.y0", "s.x1", "s.y1")


def _spans(polygons: DataFrame, n: int, cell: float) -> DataFrame:
    """(id, seq, r, a, b): stretches of each row's centre line inside a polygon, from a up to b, by the even-odd rule.

    A side is dealt to the rows whose centre line it crosses; sorted, the crossings of a row pair up.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    top, bottom = F.greatest(F.lit(0), F.floor(n - high / cell - 0.5).cast("int") - 1), F.least(F.lit(n - 1), F.ceil(n - low / cell - 0.5).cast("int") + 1)
    e = _edges(polygons).where((F.col("y0") != F.col("y1")) & (top <= bottom)).withColumn("r", F.explode(F.sequence(top, bottom)))
    y = (F.lit(n) - F.col("r") - 0.5) * cell
    e = e.where((y > F.col("y0")) != (y > F.col("y1"))).select("id", "seq", "r", (F.col("x0") + (F.col("x1") - F.col("x0")) * (y - F.col("y0")) / (F.col("y1") - F.col("y0"))).alias("x"))
    rows = e.groupBy("id", "seq", "r").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda k: F.struct(F.get("xs", 2 * k).alias("a"), F.get("xs", 2 * k + 1).alias("b")))
    return rows.where("size(xs) > 1").select("id", "seq", "r", F.explode(pairs).alias("p")).select("id", "seq", "r", "p.a", "p.b")


def _columns(low: Column, high: Column, n: int, cell: float) -> Column:
    """The columns between two places, one more on each side, within the grid."""
    first, last = F.greatest(F.lit(0), F.floor(low / cell).cast("int") - 1), F.least(F.lit(n - 1), F.floor(high / cell).cast("int") + 1)
    return F.explode(F.when(first <= last, F.sequence(first, last)))


def _on_sides(polygons: DataFrame, n: int, cell: float) -> DataFrame:
    """(r, c, id, seq) of the cells whose square a side of a polygon touches: a side is dealt to its rows, and in a row
    to the columns that it passes over there."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    top, bottom = F.greatest(F.lit(0), F.floor(n - high / cell).cast("int") - 1), F.least(F.lit(n - 1), F.floor(n - low / cell).cast("int") + 1)
    e = _edges(polygons).where(top <= bottom).withColumn("r", F.explode(F.sequence(top, bottom)))
    # the part of the side within the row's band of y
    y0, y1 = (F.lit(n) - F.col("r") - 1) * cell, (F.lit(n) - F.col("r")) * cell
    at = lambda y: F.col("x0") + (F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(y - F.col("y0"), F.col("y1") - F.col("y0"))))
    level = F.col("y0") == F.col("y1")
    a, b = F.when(level, F.col("x0")).otherwise(at(y0)), F.when(level, F.col("x1")).otherwise(at(y1))
    e = e.withColumn("c", _columns(F.least(a, b), F.greatest(a, b), n, cell))
    x, y, half = (F.col("c") + 0.5) * cell, (F.lit(n) - F.col("r") - 0.5) * cell, cell / 2
    hit = G.touches(G.line((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1"))), x - half, y - half, x + half, y + half)
    return e.where(hit).select("r", "c", "id", "seq").distinct()


def in_polygons(cells: DataFrame, polygons: DataFrame, n: int, cell: float, all_touched: bool = False) -> DataFrame:
    """(r, c, id, seq) of each cell in each polygon (id, seq, parts), by its centre, or by any touch of its square.

    Parts are rings; a hole is a ring too. Polygons are drawn row by row, so the work follows the cells that they
    cover and the length of their sides, not cells times polygons. Polygons without parts, and what lies off the
    n x n grid, have no cell.
    """
    polygons = polygons.where("size(parts) > 0")
    span = _spans(polygons, n, cell).withColumn("c", _columns(F.col("a"), F.col("b"), n, cell))
    x = (F.col("c") + 0.5) * cell
    drawn = span.where((x >= F.col("a")) & (x < F.col("b"))).select("r", "c", "id", "seq")
    if all_touched:
        drawn = drawn.union(_on_sides(polygons, n, cell)).distinct()
    return cells.select("r", "c").join(drawn, ["r", "c"])


def on_edges(cells: DataFrame, polygons: DataFrame, n: int, cell: float) -> DataFrame:
    """(r, c, id) of the cells whose square the rings of a polygon touch."""
    drawn = _on_sides(polygons.where("size(parts) > 0"), n, cell).select("r", "c", "id").distinct()
    return cells.select("r", "c").join(drawn, ["r", "c"])


def zone_cn(cells: DataFrame, zones: DataFrame, default: float, n: int, cell: float) -> DataFrame:
    """cell(r, c, cn): the curve number of the last zone (seq, cn, wkt) that holds the centre, or the default.

    Zones whose text is no geometry, and curve numbers of 0 or less, count for nothing.
    """
    known = zones.select("seq", "cn", G.from_wkt("wkt").alias("parts")).where("parts is not null and cn > 0").withColumn("id", F.col("seq"))
    found = in_polygons(cells, known, n, cell).join(known.select("seq", "cn"), "seq").groupBy("r", "c").agg(F.max_by("cn", "seq").alias("zone"))
    return cells.select("r", "c").join(found, ["r", "c"], "left").select("r", "c", F.coalesce(F.col("zone").cast("double"), F.lit(float(default))).alias("cn"))


def clip(cells: DataFrame, polygon: DataFrame, n: int, cell: float) -> DataFrame:
    """The cells of the polygon's extent, with rows and columns from its corner; outside the polygon z is null."""
    mask = written(in_polygons(cells, polygon, n, cell).select("r", "c").distinct().withColumn("_in", F.lit(True)))
    box = mask.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    inner = cells.join(F.broadcast(box), F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1")))
    return inner.join(mask, ["r", "c"], "left").select((F.col("r") - F.col("r0")).alias("r"), (F.col("c") - F.col("c0")).alias("c"), F.when(F.col("_in"), F.col("z")).alias("z"))


def clip_lines(lines: DataFrame, ring: Column, least_m: float = 0.5) -> DataFrame:
    """(id, start, end, length_m) of the longest stretch of each line (id, pts) inside a ring, as distances along the line.

    Each segment is cut where it crosses the ring; pieces whose middle is inside belong, and those that follow each
    other are one stretch. Lines without a stretch of ``least_m`` go.
    """
    seg = lines.select("id", F.posexplode(G.measured("pts")).alias("i", "s")).where("s.len > 0")
    s, dx, dy = F.col("s"), F.col("s.x1") - F.col("s.x0"), F.col("s.y1") - F.col("s.y0")

    def cut(e):
        ex, ey = e["x1"] - e["x0"], e["y1"] - e["y0"]
        both = dx * ey - dy * ex
        t = F.try_divide((e["x0"] - s["x0"]) * ey - (e["y0"] - s["y0"]) * ex, both)
        u = F.try_divide((e["x0"] - s["x0"]) * dy - (e["y0"] - s["y0"]) * dx, both)
        return F.when((t > 0) & (t < 1) & (u >= 0) & (u <= 1), t)

    ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.array_compact(F.transform(G.segments(G.closed(ring)), cut)))))
    pieces = seg.withColumn("ts", ts).select("id", "i", "s", F.posexplode(F.zip_with(F.slice("ts", F.lit(1), F.size("ts") - 1), F.slice("ts", F.lit(2), F.size("ts") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "t"))
    middle = (F.col("t.a") + F.col("t.b")) / 2
    pieces = pieces.withColumn("inside", G.inside(ring, F.col("s.x0") + middle * dx, F.col("s.y0") + middle * dy))
    w = Window.partitionBy("id").orderBy("i", "k")
    runs = pieces.withColumn("run", F.sum((~F.col("inside")).cast("int")).over(w)).where("inside")
    runs = runs.groupBy("id", "run").agg(F.min(F.col("s.before") + F.col("t.a") * F.col("s.len")).alias("start"), F.max(F.col("s.before") + F.col("t.b") * F.col("s.len")).alias("end")).withColumn("length_m", F.col("end") - F.col("start"))
    best = runs.groupBy("id").agg(F.max_by(F.struct("start", "end", "length_m"), F.struct("length_m", -F.col("start"))).alias("x"))
    return best.select("id", "x.*").where(F.col("length_m") >= least_m)


def companion_berm(cells: DataFrame, original: DataFrame, line: list[tuple[float, float]], depth: float, width: float) -> DataFrame:
    """Raises the side of a swale whose mean of the original ground is lower, so that it takes up what the swale gives.

    ``cells`` and ``original`` have r, c, x, y, z. The sides are bands of the swale's width beside it. If one side has
    no cell the other is taken, and if both have none nothing changes.
    """
    got = companion_side(original, line, width)
    use_left = F.col("right").isNull() | (F.col("left").isNotNull() & (F.col("left") < F.col("right")))
    plan = got.select(use_left.alias("_left"), F.when(use_left, F.col("n_left")).otherwise(F.col("n_right")).alias("_n"), "n_swale").where("_n > 0")
    plan = plan.select("_left", (F.col("n_swale") / F.col("_n") * depth).alias("_raise"))
    d, side = _off(line)
    ring = (d > width / 2) & (d <= 1.5 * width)
    out = cells.join(F.broadcast(plan), F.lit(True), "left")  # one row
    hit = ring & F.when(F.col("_left"), side < 0).otherwise(side > 0)
    return out.withColumn("z", F.when(hit & F.col("_raise").isNotNull(), F.col("z") + F.col("_raise")).otherwise(F.col("z"))).drop("_left", "_raise")


def _off(line: list[tuple[float, float]]) -> tuple[Column, Column]:
    """Distance from a line, and a value below zero on its left."""
    (x0, y0), (x1, y1) = line[0], line[-1]
    parts = [distance("x", "y", *a, *b) for a, b in zip(line, line[1:], strict=False)]
    return (reduce(F.least, parts) if len(parts) > 1 else parts[0]), (F.col("x") - x0) * (y1 - y0) - (F.col("y") - y0) * (x1 - x0)


def burn_plan(cells: DataFrame, works: list[dict], n: int, cell: float) -> DataFrame:
    """Burns works in their order: kind, points, depth, width, and crest, companion, gradient_pct, enabled where they matter.

    Works switched off, and those with too few points, are passed over. ``cells`` has r, c, x, y, z.
    """
    original, out = cells, cells
    for w in works:
        points, kind = w.get("points") or [], w["kind"]
        if not w.get("enabled", True) or len(points) < (3 if kind == "basin" else 2):
            continue
        if kind == "diversion":
            out = burn_diversion(out, points, w["depth"], w["width"], w.get("gradient_pct", 1.0), n, cell)
            continue
        out = burn(out, [(kind, points, w["depth"], w["width"], w.get("crest"))])
        if kind == "swale" and w.get("companion"):
            out = companion_berm(out, original, points, w["depth"], w["width"])
    return out


def outline(cells: DataFrame) -> DataFrame:
    """(x0, y0, x1, y1) in cells: the sides of a mask's cells (r, c) that no two of them share, which bound its area."""
    r, c = F.col("r"), F.col("c")
    sides = F.array(*[F.struct(*[v.cast("int").alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), s)]) for s in ((c, r, c + 1, r), (c, r + 1, c + 1, r + 1), (c, r, c, r + 1), (c + 1, r, c + 1, r + 1))])
    return cells.select(F.explode(sides).alias("s")).select("s.*").groupBy("x0", "y0", "x1", "y1").count().where("count = 1").drop("count")


def _walked(cells: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """From the first cell with one neighbour or none to the first unvisited neighbour, until there is none."""
    left = set(cells)
    near = lambda p: [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (p[0] + a, p[1] + b) in left]
    ends = sorted(p for p in left if len(near(p)) <= 1)
    at, out = (ends or sorted(left))[0], []
    while at is not None:
        out.append(at)
        left.discard(at)
        at = next(iter(near(at)), None)
    return out


def ordered_pixels(zones: DataFrame) -> DataFrame:
    """(zone, seq, r, c): each zone's cells as a line, from the first cell with one neighbour or none to the first unvisited neighbour.

    Where the walk ends, what is left of the zone is not part of the line. A task reads its zones one after the other
    and holds one of them, a thinned ridge: most are of few cells, too few for a group of their own.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zone, own, out = None, [], []

        def told():
            out.extend((zone, i, r, c) for i, (r, c) in enumerate(_walked(own)))

        for pdf in batches:
            for z, r, c in zip(pdf["zone"].tolist(), pdf["r"].tolist(), pdf["c"].tolist(), strict=True):
                if z != zone:
                    if own:
                        told()
                    zone, own = z, []
                own.append((r, c))
            yield pd.DataFrame(out, columns=["zone", "seq", "r", "c"])
            out = []
        if own:
            told()
            yield pd.DataFrame(out, columns=["zone", "seq", "r", "c"])

    return zones.select("zone", "r", "c").repartition("zone").sortWithinPartitions("zone").mapInPandas(walk, "zone long, seq int, r int, c int")


def ponding_frame(ponds: DataFrame, works: DataFrame, n: int, cell: float) -> DataFrame:
    """(r, c, name, depth) of ponded cells (r, c, x, y, depth) within five widths of a work (name, wx, wy, fill, width).

    The depth is the pond's times the store's fill, none at a millimetre or less; of several works the last by name
    counts. A work is dealt to the rows it reaches and, in these, to stretches of 64 columns, so cells meet only works beside them.
    """
    reach, wide = F.col("width") * 5, cell * 64
    top, bottom = F.floor((cell * n - F.col("wy") - reach) / cell), F.floor((cell * n - F.col("wy") + reach) / cell)
    dealt = works.withColumn("r", F.explode(F.sequence(top, bottom))).withColumn("r", F.col("r").cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.floor((F.col("wx") - reach) / wide), F.floor((F.col("wx") + reach) / wide))))
    near = F.sqrt(F.pow(F.col("x") - F.col("wx"), 2) + F.pow(F.col("y") - F.col("wy"), 2)) <= reach
    close = ponds.withColumn("part", F.floor(F.col("x") / wide)).join(dealt, ["r", "part"]).where(near)
    last = close.groupBy("r", "c").agg(F.max_by(F.struct("name", (F.col("depth") * F.col("fill")).alias("d")), "name").alias("s"))
    return last.select("r", "c", "s.name", F.when(F.col("s.d") > 1e-3, F.col("s.d")).alias("depth"))


def _to_segment(x: Column, y: Column, s: Column) -> Column:
    dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - s["x0"]) * dx + (y - s["y0"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
    a, b = x - s["x0"] - t * dx, y - s["y0"] - t * dy
    return F.sqrt(a * a + b * b)


def nearest(points: DataFrame, lines: DataFrame, reach: float, most: float | None = None, few: int = 500) -> DataFrame:
    """(pid, id, distance) of the line nearest to each point (pid, x, y) among lines (id, pts), the least id of equals.

    Up to ``few`` segments go to every task. More lines are dealt to blocks as wide as the reach, and points meet the
    lines of their block only; points that have none within reach look again with twice the reach, up to ``most``.
    Beyond ``most``, without lines, or with a coordinate that is null or not finite, a point has no line and no
    distance; segments with such a coordinate count for nothing.
    """
    finite = lambda *names: reduce(lambda p, q: p & q, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in names])
    seg = written(lines.select("id", F.explode(G.segments("pts")).alias("s")).select("id", "s.*").where(finite("x0", "y0", "x1", "y1")))
    kind = lines.schema["id"].dataType
    if seg.count() <= few:
        row = seg.agg(F.collect_list(F.struct("id", "x0", "y0", "x1", "y1")).alias("s"))  # ``few`` entries at most
        best = F.array_min(F.transform("s", lambda s: F.struct(F.round(_to_segment(F.col("x"), F.col("y"), s), 6).alias("d"), s["id"].alias("id"))))
        m = F.when(finite("x", "y"), best)
        near_by = points.crossJoin(F.broadcast(row)).select("pid", m.alias("m"))
        within = F.lit(True) if most is None else F.col("m.d") <= most
        return near_by.select("pid", F.when(within, F.col("m.id")).alias("id"), F.when(within, F.col("m.d")).alias("distance"))
    good = written(points.select("pid", "x", "y", F.coalesce(finite("x", "y"), F.lit(False)).alias("ok")))
    rest = good.where("not ok").select("pid")
    left, found = good.where("ok").select("pid", "x", "y"), []
    while not left.isEmpty():
        span = lambda a, b, d=reach: F.explode(F.sequence(F.floor((F.least(a, b) - d) / d), F.floor((F.greatest(a, b) + d) / d)))
        dealt = seg.withColumn("bx", span("x0", "x1")).withColumn("by", span("y0", "y1"))
        at = left.withColumns({"bx": F.floor(F.col("x") / reach), "by": F.floor(F.col("y") / reach)})
        d = F.round(distance("x", "y", "x0", "y0", "x1", "y1"), 6)
        best = at.join(dealt, ["bx", "by"]).withColumn("d", d).where(F.col("d") <= reach).groupBy("pid").agg(F.min(F.struct("d", "id")).alias("m")).select("pid", F.col("m.id").alias("id"), F.col("m.d").alias("distance"))
        best = written(best)
        found.append(best)
        left = written(left.join(best.select("pid"), "pid", "left_anti"))
        if most is not None and reach >= most:
            break
        reach = reach * 2 if most is None else min(reach * 2, most)
    none = rest.union(left.select("pid")).select("pid", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("double").alias("distance"))
    return reduce(DataFrame.unionByName, [*found, none])


def thinned_ridges(crest: DataFrame, zones: DataFrame, n: int, cell: float, least_m: float = 100.0, most: int = 30) -> DataFrame:
    """(zone, cells, length_m, mean_z) of thinned crests (r, c, zone) as lines, the longest first; crest has r, c, z.

    A zone of fewer cells than ``least_m`` spans, or of fewer than three, is none.
    """
    big = zones.groupBy("zone").agg(F.count("*").alias("cells")).where(F.col("cells") >= max(3, int(least_m / cell)))
    path = ordered_pixels(zones.join(big, "zone")).join(crest.select("r", "c", "z"), ["r", "c"])
    step = Window.partitionBy("zone").orderBy("seq")
    far = F.sqrt(F.pow(F.col("r") - F.lag("r").over(step), 2) + F.pow(F.col("c") - F.lag("c").over(step), 2)) * cell
    out = path.withColumn("d", far).groupBy("zone").agg(F.count("*").alias("cells"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("length_m"), F.avg("z").alias("mean_z"))
    return out.where("cells >= 2").orderBy(F.desc("length_m"), "zone").limit(most)
