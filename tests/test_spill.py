"""Depressions by the spill graph, held against plain relaxation, and least levels against all ways."""

import random

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from rillwork.operators import spill, terrain
from rillwork.plans import catalog


def plain_fill(z):
    """Lowers a full surface until nothing changes."""
    n = len(z)
    w = np.where(np.isnan(z), np.inf, 1e9)
    w[0], w[-1], w[:, 0], w[:, -1] = (np.where(np.isnan(x), np.inf, x) for x in (z[0], z[-1], z[:, 0], z[:, -1]))
    while True:
        old = w.copy()
        wide = np.pad(w, 1, constant_values=np.inf)
        near = np.min([wide[1 + a : n + 1 + a, 1 + b : n + 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        inner = np.s_[1:-1, 1:-1]
        w[inner] = np.where(np.isnan(z[inner]), np.inf, np.minimum(w[inner], np.maximum(z[inner], near[inner])))
        if (w == old).all():
            return w


def grid_of(spark, z):
    n = len(z)
    return spark.createDataFrame([(i, j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(n) for j in range(n)], "r int, c int, z double")


@pytest.fixture(scope="module")
def rough():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(48, 48)).cumsum(axis=0).cumsum(axis=1) / 5 + rng.normal(size=(48, 48))
    z[20:30, 15:33] = -40.0  # a lake over many tiles
    z[10:14, 10] = np.round(z[10:14, 10])
    return z


@pytest.mark.parametrize(("tile", "small"), [(24, 10**6), (12, 10**6), (6, 10**6), (6, 40)])
def test_fill_on_any_tiles(spark, rough, tile, small):
    """4, 16 and 64 tiles, and passes merged in rounds."""
    want = plain_fill(rough)
    got = {(x.r, x.c): x.w for x in spill.fill(grid_of(spark, rough), 48, tile, small).collect()}
    assert all(got[i, j] == want[i, j] for i in range(48) for j in range(48))


def test_fill_with_missing_cells(spark, rough):
    z = rough[:20, :20].copy()
    z[5:9, 3:16] = np.nan
    z[12, 12:15] = z[14, 12:15] = z[13, 12] = z[13, 14] = np.nan  # a cell that no water leaves
    want = plain_fill(z)
    got = {(x.r, x.c): x for x in spill.fill(grid_of(spark, z), 20, 7).collect()}
    for i in range(20):
        for j in range(20):
            if np.isnan(z[i, j]) or (i, j) == (13, 13):
                assert got[i, j].w is None
            else:
                assert got[i, j].w == want[i, j] and got[i, j].z == z[i, j]
    some = grid_of(spark, z).where("z is not null")
    assert sorted(spill.fill(some, 20, 7).where("w is not null").collect()) == sorted(x for x in got.values() if x.w is not None)
    assert spill.fill(some.limit(0), 20, 7).count() == 0


def test_least_levels(spark):
    """Random graphs with equal weights and parts without a way out, in one task and in rounds."""
    r = random.Random(8)
    edges = [(r.randrange(60), r.randrange(60), float(r.randrange(9))) for _ in range(90)] + [(i, spill.OUTSIDE, 5.0) for i in range(0, 60, 19)] + [(70, 71, 1.0)]
    want = {spill.OUTSIDE: -np.inf}
    for _ in range(200):
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                if y in want and x != spill.OUTSIDE:
                    want[x] = min(want.get(x, np.inf), max(want[y], w))
    want.pop(spill.OUTSIDE)
    df = spark.createDataFrame(edges, "a long, b long, w double")
    for small in (1000, 20, 0):
        assert {x.node: x.level for x in spill.least_levels(df, small).collect()} == want


def test_queries(spark):
    for name in ("q15_ponding_depth", "q16_pond_zones", "q17_pond_query"):
        same(spark, catalog.QUERIES[name], catalog.ORACLE[name])
