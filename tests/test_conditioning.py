"""Breaching and flats with two distances."""

import numpy as np
from pyspark.sql import functions as F

from rillwork.operators import terrain


def grid_of(spark, z):
    return spark.createDataFrame([(i, j, float(z[i, j])) for i in range(len(z)) for j in range(len(z))], "r int, c int, z double")


def test_breach_leaves_no_pit_and_raises_nothing(spark):
    rng = np.random.default_rng(7)
    z = rng.normal(size=(30, 30)).cumsum(axis=0) + rng.normal(size=(30, 30))
    z[10:16, 8:20] = np.round(z[10:16, 8:20])
    out = {(x.r, x.c): x for x in terrain.condition(grid_of(spark, z), 30, 1.0, breach=True).collect()}
    assert all(x.z <= z[k] for k, x in out.items()) and len(out) == 900
    lowered = sum(x.z < z[k] for k, x in out.items())
    filled = sum(w > z[i, j] for (i, j), w in ((((x.r, x.c)), x.w) for x in terrain.fill_depressions(grid_of(spark, z), 30).collect()))
    assert 0 < lowered < 450 and filled > 0
    for k, x in out.items():  # every way ends at the rim, and never rises
        seen = set()
        while x.to_r is not None:
            assert k not in seen
            seen.add(k)
            k = (x.to_r, x.to_c)
            assert out[k].z <= x.z
            x = out[k]
        assert k[0] in (0, 29) or k[1] in (0, 29)


def test_flats_lead_away_from_higher_ground(spark):
    """A flat valley floor between walls with its outlet at one end: water keeps to the middle."""
    z = np.full((11, 30), 5.0)
    z[0], z[-1], z[:, -1] = 9.0, 9.0, 9.0
    z[5, 0] = 4.0
    z[:5, 0], z[6:, 0] = 9.0, 9.0
    wide = np.full((30, 30), 20.0)
    wide[:11] = z
    wide[11:] = 20.0 - np.arange(19)[:, None] * 0.5  # the rest falls to the last row
    out = {(x.r, x.c): x for x in terrain.condition(grid_of(spark, wide), 30, 1.0).collect()}
    # a cell beside the upper wall goes down to the middle as well as along
    assert all(out[1, c].to_r == 2 for c in range(8, 28))
    at, rows = (1, 27), []
    while out[at].to_r is not None:
        at = (out[at].to_r, out[at].to_c)
        rows.append(at[0])
    assert at == (5, 0) and rows.count(5) > 15


def test_minimum_upstream(spark):
    rng = np.random.default_rng(1)
    z = np.add.outer(np.arange(25) * -1.0, rng.random(25))
    flow = terrain.d8(grid_of(spark, z), 1.0).withColumn("v", F.rand(3))
    flow = terrain.written(flow)
    low = {}
    for x in sorted(flow.collect(), key=lambda x: -x.z):
        k = (x.r, x.c)
        low[k] = min(low.get(k, 9), x.v)
        if x.to_r is not None:
            low[x.to_r, x.to_c] = min(low.get((x.to_r, x.to_c), 9), low[k])
    for tile in (128, 6):
        got = {(x.id // 25, x.id % 25): x.v for x in terrain.accumulate(flow, 25, {"v": F.col("v")}, tile, "min").collect()}
        assert got == low
