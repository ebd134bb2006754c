"""Operators over cell(r, c, z): focal windows, drainage by pointer doubling, tiles with halos."""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwork.operators import spill
from rillwork.sources.tables import forget, written

#: Direction codes and steps, in the order that decides ties.
D8 = [("n", -1, 0, 64), ("ne", -1, 1, 128), ("e", 0, 1, 1), ("se", 1, 1, 2), ("s", 1, 0, 4), ("sw", 1, -1, 8), ("w", 0, -1, 16), ("nw", -1, -1, 32)]


def _along(by: str, order: str):
    return Window.partitionBy(by).orderBy(order)


def neighbours(cells: DataFrame, value: str = "z") -> DataFrame:
    """The eight neighbours' values as columns, from two windows: along rows, then the triples along columns."""
    row, col = _along("r", "c"), _along("c", "r")
    out = cells.withColumn("_t", F.struct(F.lag(value).over(row).alias("w"), F.col(value).alias("m"), F.lead(value).over(row).alias("e")))
    up, down = F.lag("_t").over(col), F.lead("_t").over(col)
    out = out.withColumns({"_u": up, "_d": down})
    picks = {"n": "_u.m", "ne": "_u.e", "e": "_t.e", "se": "_d.e", "s": "_d.m", "sw": "_d.w", "w": "_t.w", "nw": "_u.w"}
    return out.withColumns({k: F.col(v) for k, v in picks.items()}).drop("_t", "_u", "_d")


def slope_deg(cells: DataFrame, cell: float) -> DataFrame:
    """Slope by central differences, one-sided at the edges."""

    def gradient(by, order):
        w = _along(by, order)
        a, b = F.lag("z").over(w), F.lead("z").over(w)
        return F.when(a.isNull(), (b - F.col("z")) / cell).when(b.isNull(), (F.col("z") - a) / cell).otherwise((b - a) / (2 * cell))

    out = cells.withColumn("gx", gradient("r", "c")).withColumn("gy", gradient("c", "r"))
    return out.withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))).drop("gx", "gy")


def box_mean(cells: DataFrame, n: int, half: int, value: str, name: str) -> DataFrame:
    """Mean over (2 half + 1) squared cells of an n x n grid mirrored at its edges, one axis after the other."""

    def axis(df, by, order, value, name):
        low = df.where(F.col(order) < half).withColumn(order, -1 - F.col(order))
        high = df.where(F.col(order) >= n - half).withColumn(order, 2 * n - 1 - F.col(order))
        padded = df.unionByName(low).unionByName(high)
        return padded.withColumn(name, F.avg(value).over(_along(by, order).rowsBetween(-half, half))).where((F.col(order) >= 0) & (F.col(order) < n))

    once = axis(cells, "r", "c", value, "_m")
    return axis(once, "c", "r", "_m", name).drop("_m")


def d8(cells: DataFrame, cell: float) -> DataFrame:
    """Code of the steepest fall to a neighbour (0: none), with the receiver's row and column."""
    out = neighbours(cells)
    falls = {k: (F.col("z") - F.col(k)) / (cell * (2.0**0.5 if dr and dc else 1.0)) for k, dr, dc, _ in D8}
    most = F.greatest(*falls.values())
    code, dr, dc = F.lit(0), F.lit(0), F.lit(0)
    for k, r, c, n in reversed(D8):
        hit = falls[k] == F.col("_most")
        code, dr, dc = F.when(hit, n).otherwise(code), F.when(hit, r).otherwise(dr), F.when(hit, c).otherwise(dc)
    out = out.withColumn("_most", F.when(most > 0, most))
    falls_now = {"dir": code, "to_r": F.col("r") + dr, "to_c": F.col("c") + dc}
    out = out.withColumns({k: F.when(F.col("_most").isNotNull(), v).otherwise(F.lit(0) if k == "dir" else F.lit(None).cast("int")) for k, v in falls_now.items()})
    return out.drop("_most", *[k for k, *_ in D8])


def fill_pits(cells: DataFrame) -> DataFrame:
    """Inner cells lower than all eight neighbours, raised to the lowest of them."""
    out = neighbours(cells)
    near = [F.col(k) for k, *_ in D8]
    inner = F.greatest(*near).isNotNull()
    for x in near:
        inner = inner & x.isNotNull()
    least = F.least(*near)
    return out.withColumn("z", F.when(inner & (F.col("z") < least), least).otherwise(F.col("z"))).drop(*[k for k, *_ in D8])


def aspect(cells: DataFrame) -> DataFrame:
    """The compass bearing in degrees that a cell faces, from a weighted 3 x 3 window; 0 where flat.

    What lies beyond the grid's edge goes on in a straight line, up and down first and then left and right.
    """
    out = neighbours(cells)
    on = lambda near, mid, far: F.coalesce(F.col(near), 2 * F.col(mid) - F.col(far))
    out = out.withColumns({a: on(a, m, b) for a, m, b in (("n", "z", "s"), ("s", "z", "n"), ("ne", "e", "se"), ("se", "e", "ne"), ("nw", "w", "sw"), ("sw", "w", "nw"))})
    out = out.withColumns({a: on(a, m, b) for a, m, b in (("e", "z", "w"), ("w", "z", "e"), ("ne", "n", "nw"), ("nw", "n", "ne"), ("se", "s", "sw"), ("sw", "s", "se"))})
    x = (F.col("ne") + 2 * F.col("e") + F.col("se")) - (F.col("nw") + 2 * F.col("w") + F.col("sw"))
    y = (F.col("sw") + 2 * F.col("s") + F.col("se")) - (F.col("nw") + 2 * F.col("n") + F.col("ne"))
    turn = F.degrees(F.atan2(y, -x))
    bearing = F.when((x == 0) & (y == 0), 0.0).when(turn > 90, 450 - turn).otherwise(90 - turn)
    return out.withColumn("aspect", F.when(bearing == 360, 0.0).otherwise(bearing)).drop(*[k for k, *_ in D8])


#: The eight facets in the order that decides ties, as side cell, corner cell, quarter turns, sense.
FACETS = [("e", "ne", 0, 1), ("n", "ne", 1, -1), ("n", "nw", 1, 1), ("w", "nw", 2, -1), ("w", "sw", 2, 1), ("s", "sw", 3, -1), ("s", "se", 3, 1), ("e", "se", 4, -1)]


def dinf(cells: DataFrame, cell: float) -> DataFrame:
    """Direction of the steepest fall over eight facets: ``angle`` in radians from east towards north, null where none.

    Water goes to the facet's side cell (r1, c1) with share p1 and to its corner cell (r2, c2) with share p2. A cell
    that gets a share lies lower, so the flow has no loop.
    """
    z, quarter = F.col("z"), math.pi / 4
    steps = {k: (dr, dc) for k, dr, dc, _ in D8}
    falls, turns = [], []
    for side, corner, _, _ in FACETS:
        along, across = (z - F.col(side)) / cell, (F.col(side) - F.col(corner)) / cell
        falls.append(F.when(across < 0, along).when(across > along, (z - F.col(corner)) / (cell * 2.0**0.5)).otherwise(F.sqrt(along * along + across * across)))
        turns.append(F.when(across < 0, 0.0).when(across > along, quarter).otherwise(F.atan2(across, along)))
    out = neighbours(cells).withColumns({"_f": F.array(*falls), "_t": F.array(*turns)}).withColumn("_most", F.array_max("_f"))
    out = out.withColumn("_k", F.when(F.col("_most") > 0, F.array_position("_f", F.col("_most")).cast("int")))
    of = lambda values: F.try_element_at(F.array(*[F.lit(v) for v in values]), F.col("_k"))
    turn = F.try_element_at("_t", F.col("_k"))
    out = out.withColumns({
        "angle": of([float(f[3]) for f in FACETS]) * turn + of([f[2] * math.pi / 2 for f in FACETS]),
        "r1": F.col("r") + of([steps[f[0]][0] for f in FACETS]), "c1": F.col("c") + of([steps[f[0]][1] for f in FACETS]), "p1": 1 - turn / quarter,
        "r2": F.col("r") + of([steps[f[1]][0] for f in FACETS]), "c2": F.col("c") + of([steps[f[1]][1] for f in FACETS]), "p2": turn / quarter,
    })
    return out.drop("_f", "_t", "_most", "_k", *steps)


#: How values meet: as columns over a group, of two columns, and in arrays.
_MEET = {
    "sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0.0)), np.add),
    "min": (F.min, lambda a, b: F.least(a, b), np.minimum),  # least() passes over nulls
}


def _along_pointers(state: DataFrame, names: list[str], how: str = "sum") -> DataFrame:
    """What each weight comes to over a node and all whose pointers lead to it. ``state`` has id, ptr and the weights.

    Pointers double each round, so rounds grow with the logarithm of the longest path.
    """
    over, both, _ = _MEET[how]
    state = written(state)
    for _ in range(64):
        if state.where("ptr is not null").isEmpty():
            return state.drop("ptr")
        got = state.where("ptr is not null").groupBy("ptr").agg(*[over(k).alias(f"_{k}") for k in names]).withColumnRenamed("ptr", "id")
        hop = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"))
        new = state.join(hop, "ptr", "left").join(got, "id", "left").select("id", F.col("next").alias("ptr"), *[both(F.col(k), F.col(f"_{k}")).alias(k) for k in names])
        new = written(new)
        forget(state)
        state = new
    raise RuntimeError("the drainage has a loop")


def _within_tile(pdf: pd.DataFrame, names: list[str], how: str = "sum") -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For the cells of one tile: the place of the last cell of each one's path inside, and what weights come to inside, by doubling."""
    ids, far = pdf["id"].to_numpy(), pdf["to"].to_numpy(np.float64)
    order = np.argsort(ids)
    sought = np.where(np.isnan(far), -1, far).astype(np.int64)
    place = order[np.minimum(np.searchsorted(ids, sought, sorter=order), len(ids) - 1)]
    to = np.where(ids[place] == sought, place, -1)
    root = np.where(to < 0, np.arange(len(to)), to)
    sums = {k: pdf[k].to_numpy(np.float64).copy() for k in names}
    ptr = to.copy()
    for _ in range(64):
        live = np.flatnonzero(ptr >= 0)
        if not len(live):
            return root, sums
        at = ptr[live]
        for k in names:
            if how == "sum":
                sums[k] = sums[k] + np.bincount(at, sums[k][live], len(ptr))
            else:
                new = sums[k].copy()
                _MEET[how][2].at(new, at, sums[k][live])
                sums[k] = new
        ptr[live] = ptr[at]
        root = root[root]
    raise RuntimeError("the drainage has a loop")


def accumulate(flow: DataFrame, n: int, weights: dict[str, Column], tile: int = 128, how: str = "sum") -> DataFrame:
    """Sum, or minimum, of each weight over a cell and all that drain to it. ``flow`` has r, c, to_r, to_c.

    Each tile is summed by itself; then only the cells from which water leaves a tile point to each other, and what
    they carry doubles along these pointers; then each tile is summed once more with what comes in. Cells move
    twice, to their tile; the rounds move rims only.
    """
    names = list(weights)
    cell, to = F.col("r").cast("long") * n + F.col("c"), F.col("to_r").cast("long") * n + F.col("to_c")
    cells = written(flow.select(cell.alias("id"), to.alias("to"), F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc"), *[w.cast("double").alias(k) for k, w in weights.items()]))
    fields = ", ".join(f"{k} double" for k in names)

    def rims(pdf: pd.DataFrame) -> pd.DataFrame:
        root, sums = _within_tile(pdf, names, how)
        ids = pdf["id"].to_numpy()
        r, c = ids // n % tile, ids % n % tile
        out = (root == np.arange(len(ids))) | (r == 0) | (c == 0) | (r == tile - 1) | (c == tile - 1)
        # a cell that ends its path inside carries its sum on; others only tell where water that enters them ends up
        last = root[out] == np.flatnonzero(out)
        frame = {"id": ids[out], "root": ids[root[out]], "to": pdf["to"].to_numpy()[out], "last": last}
        return pd.DataFrame(frame | {k: sums[k][out] for k in names})

    rim = written(cells.groupBy("tr", "tc").applyInPandas(rims, f"id long, root long, to double, last boolean, {fields}").withColumn("to", F.when(~F.isnan("to"), F.col("to").cast("long"))))
    ends = rim.where("last").select("id", "to", *names)
    entered = rim.select(F.col("id").alias("to"), F.col("root").alias("ptr"))
    total = written(_along_pointers(ends.join(entered, "to", "left").select("id", "ptr", *names), names, how))
    over, both, _ = _MEET[how]
    into = ends.where("to is not null").select("id", "to").join(total, "id").groupBy("to").agg(*[over(k).alias(f"_{k}") for k in names]).withColumnRenamed("to", "id")
    fed = cells.join(into, "id", "left").select("id", "to", "tr", "tc", *[both(F.col(k), F.col(f"_{k}")).alias(k) for k in names])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        _, sums = _within_tile(pdf, names, how)
        return pd.DataFrame({"id": pdf["id"]} | sums)

    return written(fed.groupBy("tr", "tc").applyInPandas(whole, f"id long, {fields}"))


def first_outlet(flow: DataFrame, n: int, outlets: DataFrame) -> DataFrame:
    """(id, outlet) of each cell whose path meets an outlet (id), at the first it meets.

    Pointers double until they stand on an outlet or leave the grid; cells that are settled take no part in later
    rounds, so no round joins many cells to few outlets.
    """
    cell = F.col("r").cast("long") * n + F.col("c")
    to = F.col("to_r").cast("long") * n + F.col("to_c")
    marks = outlets.select("id", F.lit(True).alias("stop")).distinct()
    state = flow.select(cell.alias("id"), to.alias("ptr")).join(marks, "id", "left").select("id", F.when(F.col("stop"), F.col("id")).otherwise(F.col("ptr")).alias("ptr"), F.col("stop").isNotNull().alias("done"))
    state = written(state.withColumn("done", F.col("done") | F.col("ptr").isNull()))
    for _ in range(64):
        left = state.where("not done")
        if left.isEmpty():
            return state.where("ptr is not null").select("id", F.col("ptr").alias("outlet"))
        hop = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("done").alias("end"))
        moved = left.join(hop, "ptr", "left").select("id", F.col("next").alias("ptr"), F.coalesce("end", F.lit(True)).alias("done"))
        new = written(state.where("done").unionByName(moved))
        forget(state)
        state = new
    raise RuntimeError("the drainage has a loop")


def erode(cells: DataFrame, passes: int = 3) -> DataFrame:
    """(r, c) of a mask thinned by a 3x3 square: cells whose nine all stand in it, at most ``passes`` times.

    A pass that would leave nothing is not taken, so a mask too thin for any stays as it is. Outside is empty.
    """
    around = F.explode(F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]))
    mask = cells.select("r", "c").distinct()
    for _ in range(passes):
        inner = written(mask.select(around.alias("x")).groupBy("x.r", "x.c").count().where("count = 9").select("r", "c"))
        if inner.isEmpty():
            break
        mask = inner
    return mask


def components(cells: DataFrame, n: int, eight: bool = True) -> DataFrame:
    """(r, c, zone): connected cells share the least cell number. Labels spread to neighbours and then jump."""
    steps = [(dr, dc) for _, dr, dc, _ in D8 if eight or not (dr and dc)]
    ids = cells.select(F.col("r"), F.col("c"), (F.col("r").cast("long") * n + F.col("c")).alias("id"))
    near = ids.select("id", F.explode(F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in steps])).alias("x"))
    near = near.where((F.col("x.r") >= 0) & (F.col("x.r") < n) & (F.col("x.c") >= 0) & (F.col("x.c") < n)).select(F.col("id").alias("b"), (F.col("x.r").cast("long") * n + F.col("x.c")).alias("a"))
    edges = written(near.join(ids.select(F.col("id").alias("a")), "a"))
    label = written(ids.select("id", F.col("id").alias("zone")))
    while True:
        least = edges.join(label.withColumnRenamed("id", "a"), "a").groupBy("b").agg(F.min("zone").alias("m")).withColumnRenamed("b", "id")
        spread = label.join(least, "id", "left").select("id", "zone", F.least("zone", F.coalesce("m", "zone")).alias("new"))
        jump = label.select(F.col("id").alias("new"), F.col("zone").alias("far"))
        moved = written(spread.join(jump, "new", "left").select("id", "zone", F.least("new", "far").alias("new")))
        forget(label)
        label = moved.select("id", F.col("new").alias("zone"))
        if moved.where("new < zone").isEmpty():
            return label.select(F.floor(F.col("id") / n).cast("int").alias("r"), (F.col("id") % n).cast("int").alias("c"), "zone")


def _uphill(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Spreads 1 from marked cells to neighbours that lie as high or higher. 0.5 marks cells that never pass it on.

    All cells that were reached last look around at once.
    """
    rows, cols = z.shape
    high = np.pad(z, 1, constant_values=np.nan).ravel()
    out = np.pad(w, 1, constant_values=2.0).ravel()
    wide = cols + 2
    steps = np.array([x * wide + y for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y])
    todo = np.flatnonzero(out == 1)
    while len(todo):
        near = todo[:, None] + steps
        new = near[(out[near] == 0) & (high[near] >= high[todo][:, None])]
        out[new] = 1
        todo = np.unique(new)
    return out.reshape(rows + 2, wide)[1:-1, 1:-1]


def _dealt(cells: DataFrame, tile: int) -> DataFrame:
    """Each cell with the tiles (tr, tc) that it lies in or beside."""
    ranges = lambda x: F.sequence(F.floor((F.col(x) - 1) / tile), F.floor((F.col(x) + 1) / tile))
    return cells.withColumn("tr", F.explode(ranges("r"))).withColumn("tc", F.explode(ranges("c")))


def _near_flat(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Steps to the nearest cell with 0 over cells of the same height, never through others."""
    out = w.copy()
    todo = [(w[i, j], i, j) for i, j in zip(*np.nonzero(w < 1e8), strict=True)]
    heapq.heapify(todo)
    rows, cols = z.shape
    while todo:
        d, i, j = heapq.heappop(todo)
        if d > out[i, j]:
            continue
        for x in range(max(0, i - 1), min(rows, i + 2)):
            for y in range(max(0, j - 1), min(cols, j + 2)):
                if z[x, y] == z[i, j] and out[x, y] > d + 1:
                    out[x, y] = d + 1
                    heapq.heappush(todo, (d + 1, x, y))
    return out


def _newest(versions: list[DataFrame], ran: list[DataFrame]) -> DataFrame:
    """The cells of each tile as they were written last; ``ran`` has the tiles (tr, tc, k) of each round."""
    last = reduce(DataFrame.unionByName, ran).groupBy("tr", "tc").agg(F.max("k").alias("k"))
    return reduce(DataFrame.unionByName, versions).join(last, ["tr", "tc", "k"]).select("r", "c", "z", "w", "tr", "tc")


def tiled_fixpoint(cells: DataFrame, kernel, tile: int = 128, most: int = 12) -> DataFrame:
    """Runs a kernel on tiles with a rim of neighbours' values until none changes. ``cells`` has r, c, z, w.

    A task holds one tile and settles it for the rim it has. After the first round only tiles beside a changed rim
    run again, and only those are written again; of every ``most`` rounds' tables one is made. Rounds grow with the
    tiles a path crosses.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = key[0] * tile - 1, key[1] * tile - 1
        z, w = np.full((tile + 2, tile + 2), np.nan), np.full((tile + 2, tile + 2), 2.0 if kernel is _uphill else np.inf)
        i, j = pdf["r"].to_numpy() - top, pdf["c"].to_numpy() - left
        z[i, j], w[i, j] = pdf["z"], pdf["w"]
        new = kernel(z, w)
        own = (i > 0) & (i <= tile) & (j > 0) & (j <= tile)
        out = pdf.loc[own, ["r", "c", "z", "w"]].rename(columns={"w": "was"})
        out["w"] = new[i[own], j[own]]
        return out

    at = {"tr": F.floor(F.col("r") / tile), "tc": F.floor(F.col("c") / tile)}
    around = lambda x: F.explode(F.sequence(F.col(x) - 1, F.col(x) + 1))
    state, active, versions, ran, k = written(cells.select("r", "c", "z", "w").withColumns(at)), None, [], [], 0
    first = state
    while True:
        if active is None:
            dealt = _dealt(state.select("r", "c", "z", "w"), tile)
        else:  # tiles that run, and those beside them
            near = active.select(around("tr").alias("tr"), "tc").select("tr", around("tc").alias("tc")).distinct()
            dealt = _dealt(state.join(near, ["tr", "tc"], "left_semi").select("r", "c", "z", "w"), tile).join(active, ["tr", "tc"], "left_semi")
        new = written(dealt.groupBy("tr", "tc").applyInPandas(run, "r int, c int, z double, was double, w double").withColumns(at).withColumn("k", F.lit(k)))
        changed = new.where("w != was").select("r", "c", F.col("tr").alias("hr"), F.col("tc").alias("hc"))
        touched = written(_dealt(changed, tile).where("tr != hr or tc != hc").select("tr", "tc").distinct())
        versions.append(new.drop("was"))
        ran.append(new.select("tr", "tc", "k").distinct() if active is None else active.withColumn("k", F.lit(k)))
        state, active, k = _newest(versions, ran), touched, k + 1
        if k == 1:
            forget(first)
        if touched.isEmpty():
            return state.select("r", "c", "z", "w")
        if len(versions) > most:
            whole = written(state.withColumn("k", F.lit(k)))
            forget(*versions)
            versions, ran, k = [whole], [whole.select("tr", "tc", "k").distinct()], k + 1
            state = _newest(versions, ran)


def fill_depressions(cells: DataFrame, n: int, tile: int = 128) -> DataFrame:
    """cell(r, c, z, w): w is the least surface from which water leaves the grid everywhere."""
    return spill.fill(cells, n, tile)


def uphill(cells: DataFrame, start: Column, barrier: Column, tile: int = 512) -> DataFrame:
    """cell(r, c, z, w): w >= 0.5 where a cell is a start, a barrier, or reached from a start going never down."""
    return tiled_fixpoint(cells.withColumn("w", F.when(start, 1.0).when(barrier, 0.5).otherwise(0.0)), _uphill, tile)


def _downstream(to: list[list[int]], share: list[list[float]]) -> list[int]:
    """Places in an order in which each stands before those that it passes water to."""
    n = len(to[0])
    waits = [0] * n
    for at, p in zip(to, share, strict=True):
        for t, x in zip(at, p, strict=True):
            if t >= 0 and x > 0:
                waits[t] += 1
    order = [k for k in range(n) if not waits[k]]
    for k in order:  # grows while it is read
        for at, p in zip(to, share, strict=True):
            t = at[k]
            if t >= 0 and p[k] > 0:
                waits[t] -= 1
                if not waits[t]:
                    order.append(t)
    if len(order) < n:
        raise RuntimeError("the drainage has a loop")
    return order


def _split_tile(pdf: pd.DataFrame) -> tuple[list[list[int]], list[list[float]], list[int]]:
    """Both targets of each cell as places in the tile (-1: outside or none), their shares, and the order downstream."""
    at = {x: k for k, x in enumerate(pdf["id"].tolist())}
    to = [[at.get(x, -1) for x in pdf[f"t{k}"].tolist()] for k in (1, 2)]
    share = [[x if x == x else 0.0 for x in pdf[f"p{k}"].tolist()] for k in (1, 2)]
    return to, share, _downstream(to, share)


def _solved_inflow(links: pd.DataFrame) -> pd.DataFrame:
    """(id, inflow) of a small system: each cell passes its inflow on once it is whole."""
    start, inner = links[links["a"] < 0], links[links["a"] >= 0]
    x: dict[int, float] = dict(zip(start["b"].tolist(), start["v"].tolist(), strict=True))
    out: dict[int, list[tuple[int, float]]] = {}
    waits: dict[int, int] = {}
    for a, b, v in zip(inner["a"].tolist(), inner["b"].tolist(), inner["v"].tolist(), strict=True):
        out.setdefault(a, []).append((b, v))
        waits[b] = waits.get(b, 0) + 1
    todo = [a for a in out if not waits.get(a)]
    while todo:
        a = todo.pop()
        for b, v in out.get(a, ()):
            x[b] = x.get(b, 0.0) + v * x.get(a, 0.0)
            waits[b] -= 1
            if not waits[b]:
                todo.append(b)
    return pd.DataFrame({"id": list(x), "inflow": list(x.values())}, columns=["id", "inflow"]).astype({"id": "int64", "inflow": "float64"})


def rim_inflow(links: DataFrame, small: int = 2_000_000) -> DataFrame:
    """(id, inflow) solved from links (a, b, v): v of what comes to a goes on to b; where a is -1, v itself comes to b.

    Up to ``small`` links are solved in one task. More are carried on in rounds: what is still under way takes one
    link a round, so there are as many rounds as tiles on the longest way, over rims only.
    """
    links = written(links.groupBy("a", "b").agg(F.sum("v").alias("v")))
    if links.count() <= small:
        return links.groupBy().applyInPandas(_solved_inflow, "id long, inflow double")
    inner, moving = links.where("a >= 0"), links.where("a < 0").select(F.col("b").alias("id"), F.col("v").alias("inflow"))
    moving = written(moving)
    parts = [moving]
    while True:
        moving = written(moving.join(inner, F.col("id") == F.col("a")).groupBy("b").agg(F.sum(F.col("inflow") * F.col("v")).alias("inflow")).select(F.col("b").alias("id"), "inflow"))
        if moving.isEmpty():
            break
        parts.append(moving)
        if len(parts) > 20:
            total = written(reduce(DataFrame.unionAll, parts[:-1]).groupBy("id").agg(F.sum("inflow").alias("inflow")))
            forget(*parts[:-1])
            parts = [total, moving]
    return reduce(DataFrame.unionAll, parts).groupBy("id").agg(F.sum("inflow").alias("inflow"))


def accumulate_split(flow: DataFrame, tile: int = 128, small: int = 2_000_000) -> DataFrame:
    """(r, c, acc): each cell's weight and the shares of all that drain to it, along the two ways of ``dinf``.

    ``flow`` has r, c, weight, r1, c1, p1, r2, c2, p2. What leaves a tile is a linear map of what enters it: a task
    carries, beside its own weights, one unit from each rim cell down through its tile. Between tiles only what comes
    to rim cells is solved; then each tile is summed once more. Cells move twice, whatever the grid's size. A null
    weight is none.
    """
    key = lambda r, c: F.shiftleft(F.col(r).cast("long"), 32) + F.col(c)
    cells = written(flow.select(
        key("r", "c").alias("id"), F.coalesce(key("r1", "c1"), F.lit(-1)).alias("t1"), "p1", F.coalesce(key("r2", "c2"), F.lit(-1)).alias("t2"), "p2", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"),
        F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"),
    ))

    def rims(pdf: pd.DataFrame) -> pd.DataFrame:
        to, share, order = _split_tile(pdf)
        ids = pdf["id"].to_numpy()
        r, c = (ids >> 32) % tile, (ids & 0xFFFFFFFF) % tile
        entries = np.flatnonzero((r == 0) | (c == 0) | (r == tile - 1) | (c == tile - 1))
        carried = np.zeros((len(ids), len(entries) + 1))
        carried[entries, np.arange(len(entries))] = 1.0
        carried[:, -1] = pdf["weight"]
        names, outer = np.append(ids[entries], -1), [pdf["t1"].tolist(), pdf["t2"].tolist()]
        a, b, v = [], [], []
        for k in order:
            own = carried[k]
            for at, p, far in zip(to, share, outer, strict=True):
                if p[k] > 0:
                    if at[k] >= 0:
                        carried[at[k]] += p[k] * own
                    elif far[k] >= 0:
                        some = np.flatnonzero(own)
                        a.append(names[some])
                        b.append(np.full(len(some), int(far[k])))
                        v.append(p[k] * own[some])
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (a, b, v)]
        return pd.DataFrame({"a": flat[0].astype(np.int64), "b": flat[1].astype(np.int64), "v": flat[2]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        to, share, order = _split_tile(pdf)
        acc = (pdf["weight"] + pdf["inflow"]).tolist()
        for k in order:
            for at, p in zip(to, share, strict=True):
                if at[k] >= 0 and p[k] > 0:
                    acc[at[k]] += p[k] * acc[k]
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"r": (ids >> 32).astype(np.int32), "c": (ids & 0xFFFFFFFF).astype(np.int32), "acc": acc})

    inflow = rim_inflow(cells.groupBy("tr", "tc").applyInPandas(rims, "a long, b long, v double"), small)
    fed = cells.join(inflow, "id", "left").withColumn("inflow", F.coalesce("inflow", F.lit(0.0)))
    return written(fed.groupBy("tr", "tc").applyInPandas(whole, "r int, c int, acc double"))


def flat_ways(down: DataFrame, n: int) -> DataFrame:
    """(r, c, dir, to_r, to_c, steps) of the cells of flats, those inside the grid that no neighbour lies below.

    ``down`` has r, c, z, dir. Two distances are taken over each flat and the cells of its height that have a way down
    beside it: ``steps`` to the nearest of these, and the steps from the nearest cell with higher ground beside it. A cell
    goes to the neighbour of its height for which twice the first less the second is least: away from higher ground, and
    always nearer to a way down, since of two neighbours the second distance differs by one at most.
    """
    edge = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == n - 1) | (F.col("c") == n - 1)
    near = neighbours(down.withColumn("core", ~edge & (F.col("dir") == 0)).withColumn("own", F.struct("z", "core")), "own")
    beside = lambda test: reduce(lambda p, q: p | q, [F.coalesce(test(k), F.lit(False)) for k, *_ in D8])
    near = near.withColumns({"higher": beside(lambda k: F.col(f"{k}.z") > F.col("z")), "touch": beside(lambda k: F.col(f"{k}.core") & (F.col(f"{k}.z") == F.col("z")))})
    flat = written(near.where("core or touch").select("r", "c", "z", "core", "higher"))
    toward = tiled_fixpoint(flat.withColumn("w", F.when(F.col("core"), 1e9).otherwise(0.0)), _near_flat)
    away = tiled_fixpoint(flat.withColumn("w", F.when(F.col("higher"), 1.0).otherwise(1e9)), _near_flat)
    away = away.select("r", "c", F.when(F.col("w") < 1e8, F.col("w")).otherwise(0.0).alias("d"))
    ranked = toward.join(away, ["r", "c"]).select("r", "c", "z", F.col("w").alias("steps"), (2 * F.col("w") - F.col("d")).alias("v"))
    # of the neighbours of the same height the one of the least value, the first in the order of D8
    out = flat.where("core").select("r", "c", "z").join(ranked.select("r", "c", "steps", "v"), ["r", "c"]).where("steps < 1e8")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(code).alias("code"), (F.col("r") + dr).alias("to_r"), (F.col("c") + dc).alias("to_c")) for i, (_, dr, dc, code) in enumerate(D8)])
    there = ranked.select(F.col("r").alias("to_r"), F.col("c").alias("to_c"), F.col("z").alias("z2"), F.col("v").alias("v2"))
    each = out.select("r", "c", "z", "steps", "v", F.explode(steps).alias("s")).select("r", "c", "z", "steps", "v", "s.*").join(there, ["to_r", "to_c"]).where("z2 = z and v2 < v")
    best = each.groupBy("r", "c", "steps").agg(F.min(F.struct("v2", "i", "code", "to_r", "to_c")).alias("b"))
    return best.select("r", "c", F.col("b.code").alias("dir"), "b.to_r", "b.to_c", "steps")


def condition(cells: DataFrame, n: int, cell: float, breach: bool = False) -> DataFrame:
    """cell(r, c, z, dir, to_r, to_c, steps): a surface without depressions and the D8 way of every cell.

    Depressions are filled; a cell of a flat goes as flat_ways() says, so every inner cell has a way out of the grid.
    Cells on the grid's edge without a lower neighbour end a path. breach: depressions are cut open instead. The ways
    over the filled surface leave each pit over its lowest pass; along them every cell is lowered to the lowest
    ground upstream of it. Where a cell has a lower neighbour then it goes down the steepest fall, elsewhere the
    old way, to ground that is no higher; so no loop can form.
    """
    filled = written(fill_depressions(cells, n).select("r", "c", F.col("w").alias("z"), F.col("z").alias("ground")))
    down = written(d8(filled, cell))
    ways = flat_ways(down, n).select("r", "c", F.col("dir").alias("_d"), F.col("to_r").alias("_r"), F.col("to_c").alias("_c"), F.col("steps").alias("_w"))
    out = down.join(ways, ["r", "c"], "left")
    out = out.select("r", "c", "z", "ground", F.coalesce("_d", "dir").alias("dir"), F.coalesce("_r", "to_r").alias("to_r"), F.coalesce("_c", "to_c").alias("to_c"), F.coalesce("_w", F.lit(0.0)).alias("steps"))
    if not breach:
        return out.drop("ground")
    out = written(out)
    low = accumulate(out, n, {"low": F.col("ground")}, how="min")
    cut = low.select(F.floor(F.col("id") / n).cast("int").alias("r"), (F.col("id") % n).cast("int").alias("c"), F.col("low").alias("z"))
    fall = d8(written(cut), cell).select("r", "c", "z", F.col("dir").alias("_d"), F.col("to_r").alias("_r"), F.col("to_c").alias("_c"))
    own = F.col("_d") > 0
    both = fall.join(out.drop("z"), ["r", "c"])
    return both.select("r", "c", "z", *[F.when(own, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("_d", "dir"), ("_r", "to_r"), ("_c", "to_c"))], "steps")


def condition_dinf(cells: DataFrame, n: int, cell: float, lift: float = 1e-5) -> DataFrame:
    """As ``condition`` for split flow: flats are lifted by ``lift`` for each step from their way down, and ``dinf`` looks at that.

    A cell that has no fall on the lifted surface takes its D8 way whole, so none is left without a way out.
    """
    d = written(condition(cells, n, cell).withColumn("z", F.col("z") + lift * F.col("steps")))
    split = dinf(d, cell)
    none = F.col("angle").isNull() & F.col("to_r").isNotNull()
    return split.withColumns({"r1": F.when(none, F.col("to_r")).otherwise(F.col("r1")), "c1": F.when(none, F.col("to_c")).otherwise(F.col("c1")), "p1": F.when(none, 1.0).otherwise(F.col("p1")), "p2": F.when(none, 0.0).otherwise(F.col("p2"))})
