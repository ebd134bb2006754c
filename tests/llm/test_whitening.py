"""Whitening held against exact fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rillwork.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def exact(rows):
    """n, S, covariance in fractions of the distinct vectors."""
    xs = sorted({tuple(r) for r in rows})
    n, d = len(xs), len(xs[0])
    s = [sum(x[i] for x in xs) for i in range(d)]
    y = [[Fraction(x[i] * n - s[i], n) for i in range(d)] for x in xs]
    return xs, n, s, [[sum(r[i] * r[j] for r in y) / n for j in range(d)] for i in range(d)]


def frame(spark, rows):
    return spark.createDataFrame([Row(vec_id=i, x=[int(v) for v in r]) for i, r in enumerate(rows)], "vec_id long, x array<long>")


def test_double_double_loses_nothing():
    rng = np.random.default_rng(0)
    a, b = (rng.normal(size=50) * 10.0 ** rng.integers(-8, 8, 50) for _ in range(2))
    for op, want in ((whitening.two_sum, lambda x, y: Fraction(x) + Fraction(y)), (whitening.two_product, lambda x, y: Fraction(x) * Fraction(y))):
        high, low = op(a, b)
        assert all(Fraction(h) + Fraction(e) == want(x, y) for h, e, x, y in zip(high, low, a, b, strict=True))
    total = whitening.row_sum((np.array([[1e30], [1.0], [-1e30], [2.0], [1e-9]]), np.zeros((5, 1))))
    assert Fraction(total[0][0]) + Fraction(total[1][0]) == 3 + Fraction(1e-9)


def test_query(spark):
    got = queries.op13_embedding_whitening(spark, SF).collect()
    source = {r["vec_id"]: [math.floor(256 * c) for c in r["embedding"]] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    xs, n, s, v = exact(source.values())
    dense = np.array([[float(c) for c in r] for r in v])
    values, axes = np.linalg.eigh(dense)
    assert len(got) == 4 * len(source)
    by = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(1, 5):
        e, axis = values[-k], axes[:, -k]
        white = {i: float(np.array([float(Fraction(c * n - t, n)) for c, t in zip(x, s, strict=True)]) @ axis / math.sqrt(e)) for i, x in source.items()}
        sign = np.sign(sum(white[i] * by[i, k]["whitened"] for i in source))
        for i, x in source.items():
            r = by[i, k]
            assert r["n"] == n and r["deviation"] == sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True))
            assert abs(r["whitened"] - sign * white[i]) < 1e-9
            assert abs(r["explained"] / (e / np.trace(dense)) - 1) < 1e-12
            assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("big", [10**4, 10**7])
def test_small_directions_beside_large_ones(spark, big):
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(-big, big, (300, 1)) * 100, rng.integers(-3, 3, (300, 2)), rng.integers(0, 2, (300, 1)), 5 * rng.integers(-9, 9, (300, 1)) + big**2], axis=1)
    rows[:, 3] += rows[:, 0]
    rows = np.concatenate([rows, rows[:40]])
    w = whitening.fit(frame(spark, rows.tolist()), 5)
    xs, n, s, v = exact(rows.tolist())
    assert w.centre.n == n and w.centre.sums == s and len(w.values) == 5
    trace = sum(v[i][i] for i in range(5))
    assert abs(w.trace / float(trace) - 1) < 1e-14
    for e, axis in zip(w.values, w.vectors, strict=True):
        a = [Fraction(float(c)) for c in axis]
        va = [sum(v[i][j] * a[j] for j in range(5)) for i in range(5)]
        rayleigh = sum(p * q for p, q in zip(va, a, strict=True)) / sum(p * p for p in a)
        assert abs(e / float(rayleigh) - 1) < 1e-4
    assert w.identity_error < 1e-4


def test_merging_shares_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = rng.integers(-500, 500, (400, 9)).tolist()
    whole = whitening.fit(frame(spark, rows))
    monkeypatch.setattr(whitening, "BLOCK", 7)
    parts = whitening.fit(frame(spark, rows).repartition(13))
    assert np.allclose(whole.values, parts.values, rtol=1e-14) and abs(whole.trace - parts.trace) <= 1e-12 * whole.trace


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, -0.001]), (1, [0.5, -0.001]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [1.0, -inf]), (6, [2.0, 3.0]), (None, [-1.0, 4.0]), (7, [1.0]), (8, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit("other")).where(whitening.usable(F.col("embedding")))
    vectors = vectors.select("vec_id", whitening.as_integers(F.col("embedding")).alias("x"))
    got = whitening.whiten(vectors, whitening.fit(vectors), ["vec_id"]).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted((i, k) for i in (1, 1, 6, 0, 7, 8) for k in (1, 2))
    assert {r["n"] for r in got} == {3}
    assert all((r["whitened"] is None) == (r["vec_id"] in (7, 8)) and (r["deviation"] is None) == (r["vec_id"] in (7, 8)) for r in got)
    for none in (vectors.limit(0), vectors.where("vec_id = 1"), vectors.where("vec_id = 8")):  # nothing, no variance, no dimension
        out = whitening.whiten(none, whitening.fit(none), ["vec_id"])
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_sums_beyond_the_longs(spark):
    rows = [[2**62, 1], [2**62 - 4, 2], [2**61, 3], [-(2**62), 5]]
    w = whitening.fit(frame(spark, rows))
    assert w.centre.sums == [sum(r[0] for r in rows), 11]
    assert [r["deviation"] for r in whitening.whiten(frame(spark, rows), w, ["vec_id"]).collect()] == [None] * (4 * len(w.values))
