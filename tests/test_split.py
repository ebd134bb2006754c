"""Split flow by rim transfer: the same on any tiles, solved at once or in rounds, and nothing is lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.operators import terrain


@pytest.fixture(scope="module")
def flow(spark):
    rng = np.random.default_rng(6)
    z = np.add.outer(np.arange(40) * -1.0, np.abs(np.arange(40) - 20.0)) + rng.random((40, 40)) * 3
    cells = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(40) for j in range(40)], "r int, c int, z double")
    return terrain.written(terrain.dinf(cells, 1.0).withColumn("weight", F.lit(1.0) + F.col("c") / 10))


@pytest.fixture(scope="module")
def plain(flow):
    """From the highest cell down."""
    rows = sorted(flow.collect(), key=lambda x: -x.z)
    acc = {(x.r, x.c): x.weight for x in rows}
    for x in rows:
        for r, c, p in ((x.r1, x.c1, x.p1), (x.r2, x.c2, x.p2)):
            if r is not None and p > 0:
                acc[r, c] += p * acc[x.r, x.c]
    return acc


@pytest.mark.parametrize(("tile", "small"), [(64, 10**6), (20, 10**6), (5, 10**6), (5, 0)])
def test_any_tiles(flow, plain, tile, small):
    got = {(x.r, x.c): x.acc for x in terrain.accumulate_split(flow, tile, small).collect()}
    assert got.keys() == plain.keys() and all(got[k] == pytest.approx(v, rel=1e-12) for k, v in plain.items())


def test_cells_move_twice(flow):
    """However many tiles a way crosses, there are two passes over cells and one table of rims."""
    runs = []
    real = terrain.written
    terrain.written = lambda df: runs.append(df.columns) or real(df)
    try:
        terrain.accumulate_split(flow, 4)
    finally:
        terrain.written = real
    assert len(runs) == 3 and terrain.accumulate_split(flow.limit(0), 4).count() == 0


def test_a_loop_is_an_error(spark):
    loop = spark.createDataFrame([(0, 0, 1.0, 0, 1, 1.0, 0, 0, 0.0), (0, 1, 1.0, 0, 0, 1.0, 0, 0, 0.0)], "r int, c int, weight double, r1 int, c1 int, p1 double, r2 int, c2 int, p2 double")
    with pytest.raises(Exception, match="loop"):
        terrain.accumulate_split(loop)
