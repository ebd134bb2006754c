"""Depressions filled by a spill graph: tiles are flooded once each, and only the cells of their rims meet.

A tile is flooded from its rim inwards: every cell gets the level at which its water first reaches the rim, and the
rim cell that it reaches. Where the waters of two rim cells meet there is a pass between them. With the passes from
tile to tile and those out of the grid this is a graph of rim cells, whose least levels to the outside (the smallest
highest pass of any way) are solved without the other cells. A cell's surface then is the higher of its own level
and its rim cell's: any way out passes the rim, and ways through other rim cells are no lower, since such a cell
could be reached through this one.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.sources.tables import forget, written

#: The node that stands for all that lies outside.
OUTSIDE = -1
#: Up to so many passes are solved in one task; more are merged in rounds first, until so few are left.
SMALL = 400_000


def flood(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, float]]]:
    """Levels at which water reaches the rim of a tile, the rim cell (flat index) it reaches, and the passes between
    rim cells that are needed to know all least levels among them. NaN cells hold no water and let none through."""
    rows, cols = z.shape
    wide = cols + 2
    padded = np.full((rows + 2, wide), np.nan)
    padded[1:-1, 1:-1] = z
    height = padded.ravel().tolist()
    known = np.isfinite(padded).ravel().tolist()
    level, label = [0.0] * len(height), [-1] * len(height)
    rim = np.ones(z.shape, bool)
    rim[1:-1, 1:-1] = False
    heap = []
    for i in np.flatnonzero(np.pad(rim, 1) & np.isfinite(padded)).tolist():
        level[i], label[i] = height[i], i
        heap.append((height[i], i))
    heapq.heapify(heap)
    steps = (-wide - 1, -wide, -wide + 1, -1, 1, wide - 1, wide, wide + 1)
    passes: dict[tuple[int, int], float] = {}
    done = [False] * len(height)
    while heap:
        w, i = heapq.heappop(heap)
        done[i] = True
        own = label[i]
        for s in steps:
            j = i + s
            if label[j] < 0:
                if known[j]:
                    level[j], label[j] = (w if w > height[j] else height[j]), own
                    heapq.heappush(heap, (level[j], j))
            elif label[j] != own and done[j]:
                key = (own, label[j]) if own < label[j] else (label[j], own)
                # w is the higher level of the two: cells come out of the heap in rising order
                if w < passes.get(key, np.inf):
                    passes[key] = w
    at = lambda i: (i // wide - 1) * cols + i % wide - 1
    inner = np.array(label).reshape(rows + 2, wide)[1:-1, 1:-1]
    inner = np.where(inner >= 0, (inner // wide - 1) * cols + inner % wide - 1, -1)
    tree = spanning([(a, b, w) for (a, b), w in passes.items()])
    return np.array(level).reshape(rows + 2, wide)[1:-1, 1:-1], inner, [(at(a), at(b), w) for a, b, w in tree]


def spanning(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The edges of a least spanning forest: it keeps all least levels between nodes."""
    root: dict[int, int] = {}

    def find(x):
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    out = []
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b, w))
    return out


def _solved(edges: pd.DataFrame) -> pd.DataFrame:
    """(node, level) of all nodes of a small graph: the lowest node that still can be reached comes next."""
    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in zip(edges["a"].tolist(), edges["b"].tolist(), edges["w"].tolist(), strict=True):
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    heap, level = [(-np.inf, OUTSIDE)], {}
    while heap:
        w, a = heapq.heappop(heap)
        if a in level:
            continue
        level[a] = w
        for b, e in near.get(a, ()):
            if b not in level:
                heapq.heappush(heap, (max(w, e), b))
    level.pop(OUTSIDE, None)
    return pd.DataFrame({"node": list(level), "level": list(level.values())}, columns=["node", "level"]).astype({"node": "int64", "level": "float64"})


def _jumped(pointers: DataFrame) -> DataFrame:
    """(node, top) of (node, to), by doubling: the last node of each chain of pointers, one that points to itself or nowhere."""
    state = written(pointers.select("node", F.col("to").alias("top")))
    while True:
        hop = state.select(F.col("node").alias("top"), F.col("top").alias("far"))
        new = written(state.join(hop, "top", "left").select("node", F.coalesce("far", "top").alias("top"), (F.coalesce("far", "top") != F.col("top")).alias("moved")))
        still = not new.where("moved").isEmpty()
        forget(state)
        state = new.select("node", "top")
        if not still:
            return state


def least_levels(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, level): the least possible highest edge of a way from each node to OUTSIDE. ``edges`` has a, b, w.

    Each node takes its lowest edge, of equals the one of the least ends. Along these choices edges never rise, so the
    nodes of a chain have the level of the chain's last node, or that of their own edge where it is higher; nodes of a
    chain become one. Rounds at least halve the nodes; a graph of at most ``small`` edges is solved in one task. Nodes
    without a way to OUTSIDE have no level.
    """
    edges = written(edges.where("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w")))
    merged = []
    while edges.count() > small:
        ends = edges.select(F.col("a").alias("node"), F.struct("w", "a", "b").alias("e")).union(edges.select(F.col("b"), F.struct("w", "a", "b"))).where(F.col("node") != OUTSIDE)
        choice = written(ends.groupBy("node").agg(F.min("e").alias("e")).select("node", "e.w", F.when(F.col("node") == F.col("e.a"), F.col("e.b")).otherwise(F.col("e.a")).alias("to")))
        # two nodes that chose the same edge point at each other: the lesser one is the last of its chain
        other = choice.select(F.col("node").alias("to"), F.col("to").alias("back"))
        chains = choice.join(other, "to", "left").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("to"))
        tops = written(choice.select("node", "w").join(_jumped(chains), "node"))
        merged.append(tops)
        up = tops.select("node", "top")
        outer = edges.join(up.toDF("a", "ta"), "a", "left").join(up.toDF("b", "tb"), "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"), "w")
        new = written(outer.where("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w")))
        forget(edges, choice)
        edges = new
    level = written(edges.groupBy().applyInPandas(_solved, "node long, level double"))
    for tops in reversed(merged):
        # a chain that ends at OUTSIDE is as high as its own edge
        below = level.withColumnRenamed("node", "top").union(level.sparkSession.range(1).select(F.lit(OUTSIDE).cast("long"), F.lit(float("-inf"))))
        inner = tops.join(below, "top").where(F.col("node") != F.col("top")).select("node", F.greatest("w", "level").alias("level"))
        new = written(level.union(inner))
        forget(level, tops)
        level = new
    return level


def fill(cells: DataFrame, n: int, tile: int = 128, small: int = SMALL) -> DataFrame:
    """cell(r, c, z, w): w is the least surface from which water leaves an n x n grid everywhere.

    Each cell is moved to its tile once and read once more; what is solved between tiles are rim cells only, a share of
    about 4 / tile, in rounds that do not depend on how many tiles a way crosses. Cells that are missing, null or NaN
    let no water through and null and NaN ones have no surface; so have cells that no water leaves. An empty grid gives no row.
    """
    fields = "edge boolean, a long, b long, z double, w double"

    def flooded(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(key[0]) * tile, int(key[1]) * tile
        rows, cols = min(tile, n - top), min(tile, n - left)
        z = np.full((rows, cols), np.nan)
        i, j = pdf["r"].to_numpy() - top, pdf["c"].to_numpy() - left
        z[i, j] = pdf["z"].to_numpy(np.float64, na_value=np.nan)
        level, label, passes = flood(z)
        wide = lambda k: (top + np.asarray(k, np.int64) // cols) * n + left + np.asarray(k, np.int64) % cols
        own = label[i, j]
        cell = pd.DataFrame({"edge": False, "a": (top + i) * n + left + j, "b": np.where(own >= 0, wide(own), -2), "z": z[i, j], "w": np.where(own >= 0, level[i, j], np.nan)})
        a, b, w = zip(*passes, strict=True) if passes else ((), (), ())
        return pd.concat([cell, pd.DataFrame({"edge": True, "a": wide(a), "b": wide(b), "z": 0.0, "w": np.array(w, np.float64)})])

    at = cells.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("z").cast("double").alias("z"))
    done = written(at.groupBy(F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc")).applyInPandas(flooded, fields))
    r, c = F.floor(F.col("a") / n), F.col("a") % n
    far = lambda x: (x % tile == 0) | (x % tile == tile - 1) | (x == n - 1)
    rim = done.where(~F.col("edge") & (F.col("b") == F.col("a")) & (far(r) | far(c))).select(F.col("a").alias("id"), r.alias("r"), c.alias("c"), "z")
    # a rim cell with those of its neighbours to the right and below that lie in another tile
    ahead = rim.select("id", "z", F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"), F.explode(F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("x"))
    ahead = ahead.where((F.floor(F.col("x.r") / tile) != F.col("tr")) | (F.floor(F.col("x.c") / tile) != F.col("tc"))).where((F.col("x.c") >= 0) & (F.col("x.c") < n))
    across = ahead.select(F.col("id").alias("a"), "z", (F.col("x.r") * n + F.col("x.c")).alias("id")).join(rim.select("id", F.col("z").alias("z2")), "id").select("a", F.col("id").alias("b"), F.greatest("z", "z2").alias("w"))
    out = rim.where((F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == n - 1) | (F.col("c") == n - 1)).select(F.col("id").alias("a"), F.lit(OUTSIDE).cast("long").alias("b"), F.col("z").alias("w"))
    levels = least_levels(done.where("edge").select("a", "b", "w").union(across).union(out), small)
    whole = done.where(~F.col("edge")).join(levels.withColumnRenamed("node", "b"), "b", "left")
    w = F.when(F.col("level").isNotNull(), F.greatest("w", "level"))
    return whole.select(r.cast("int").alias("r"), c.cast("int").alias("c"), F.when(~F.isnan("z"), F.col("z")).alias("z"), w.alias("w"))
