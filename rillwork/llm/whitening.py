"""Whitening of embeddings by a covariance that is summed in double-double."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm.common import written

#: A pair (high, low) of arrays stands for the unrounded sum of both.
DoubleDouble = tuple[np.ndarray, np.ndarray]
#: Numbers of a task's working arrays, sums in one row of a partial result, shares that partial results are merged in first.
CELLS, BLOCK, SHARES = 1 << 17, 1 << 12, 64
#: An eigenvalue below this share of the greatest is rounding: there is no such component.
LEAST_SHARE = 1e-22
#: Eigenvalues above this share of the greatest come out right beside it.
CLEAR = 1e-6


def two_sum(a: np.ndarray, b: np.ndarray) -> DoubleDouble:
    """The rounded sum and what rounding took from it, exactly."""
    s = a + b
    v = s - a
    return s, (a - (s - v)) + (b - v)


def split(a: np.ndarray) -> DoubleDouble:
    """Two halves of 26 bits, whose products are exact."""
    t = 134217729.0 * a
    high = t - (t - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray) -> DoubleDouble:
    """The rounded product and what rounding took from it, exactly."""
    (a1, a2), (b1, b2) = split(a), split(b)
    p = a * b
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


def plus(x: DoubleDouble, y: DoubleDouble) -> DoubleDouble:
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def times(x: DoubleDouble, y: DoubleDouble) -> DoubleDouble:
    p, e = two_product(x[0], y[0])
    return two_sum(p, e + (x[0] * y[1] + x[1] * y[0]))


def over(x: DoubleDouble, n: int) -> DoubleDouble:
    d = (np.full_like(x[0], float(n)), np.full_like(x[0], float(n - int(float(n)))))
    q = x[0] / d[0]
    back = times((q, np.zeros_like(q)), d)
    rest = plus(x, (-back[0], -back[1]))
    return two_sum(q, rest[0] / d[0])


def row_sum(x: DoubleDouble) -> DoubleDouble:
    """Sum over the first axis, by halves."""
    high, low = x
    while len(high) > 1:
        if len(high) % 2:
            high, low = (np.concatenate([a, np.zeros_like(a[:1])]) for a in (high, low))
        h = len(high) // 2
        high, low = plus((high[:h], low[:h]), (high[h:], low[h:]))
    return high[0], low[0]


def usable(c: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor numbers that are not finite."""
    return c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def as_integers(c: Column, scale: int = 256) -> Column:
    """floor(scale * v) of each entry as long; beyond the longs it is the nearest of them."""
    return F.transform(c, lambda v: F.floor(v.cast("double") * scale) + F.lit(0).cast("long"))


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of length d as a matrix, and which rows they are."""
    fits = np.diff(np.asarray(column.offsets)) == d
    return np.asarray(column.filter(pa.array(fits)).flatten()).reshape(-1, d), fits


def _total(fit: DataFrame, terms: Callable[[np.ndarray], DoubleDouble], d: int, width: int) -> DoubleDouble:
    """Sums over all rows of ``fit`` of the ``width`` numbers that ``terms`` makes of each x-vector.

    Each task sums its rows; parts are merged, high with high and low with low, in shares and then in whole, block by
    block of the numbers. Only the sums come to the driver.
    """
    schema = "task int, block int, high array<double>, low array<double>"

    def rows(task: int, sums: dict[int, DoubleDouble]) -> Iterator[pa.RecordBatch]:
        for b, (high, low) in sorted(sums.items()):
            lists = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (high, low)]
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([b], pa.int32()), *lists], names=["task", "block", "high", "low"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = (np.zeros(width), np.zeros(width))
        step = max(1, CELLS // width)
        any_ = False
        for batch in batches:
            x, _ = _matrix(batch.column(0), d)
            for i in range(0, len(x), step):
                acc, any_ = plus(acc, row_sum(terms(x[i : i + step]))), True
        if any_:
            yield from rows(TaskContext.get().partitionId(), {b: (acc[0][b * BLOCK : (b + 1) * BLOCK], acc[1][b * BLOCK : (b + 1) * BLOCK]) for b in range(-(-width // BLOCK))})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, DoubleDouble] = {}
        for batch in batches:
            for b, high, low in zip(*(batch.column(k) for k in ("block", "high", "low")), strict=True):
                new = np.asarray(high.values), np.asarray(low.values)
                b = b.as_py()
                sums[b] = plus(sums[b], new) if b in sums else new
        yield from rows(0, sums)

    parts = fit.select("x").mapInArrow(summed, schema)
    shares = parts.repartition(SHARES, "block", F.pmod("task", F.lit(SHARES))).mapInArrow(merged, schema)
    found = shares.repartition(F.col("block")).mapInArrow(merged, schema).collect()
    out = np.zeros((2, width))
    for r in found:
        at = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
        out[0, at], out[1, at] = r["high"], r["low"]
    return out[0], out[1]


def _exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors and their sums by dimension, as whole numbers."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (d + 1)
        for batch in batches:
            x, _ = _matrix(batch.column(0), d)
            if len(x):
                small = max(abs(int(x.min())), abs(int(x.max()))) < 2**62 // len(x)
                sums = x.sum(axis=0).tolist() if small else x.astype(object).sum(axis=0).tolist()
                total = [a + b for a, b in zip(total, [*sums, len(x)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    found = fit.select("x").mapInArrow(summed, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = {r["i"]: int(r["s"]) for r in found}
    return sums.get(d, 0), [sums.get(i, 0) for i in range(d)]


@dataclass(frozen=True)
class Centre:
    """n vectors with sums S; the mean S/n in double-double."""

    n: int
    sums: list[int]
    mean: DoubleDouble

    def apart(self, x: np.ndarray) -> DoubleDouble:
        """x - S/n in double-double."""
        high = x.astype(np.float64)
        low = (x - np.where(np.abs(high) < 2**63, high, 0).astype(np.int64)).astype(np.float64) if np.abs(high).max(initial=0) > 2**53 else np.zeros_like(high)
        return plus((high, low), (np.broadcast_to(-self.mean[0], high.shape), np.broadcast_to(-self.mean[1], high.shape)))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)^2, exactly; null beyond the longs."""
        most = max([abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))]) * self.n + max(map(abs, self.sums), default=0)
        if most * most * max(1, len(self.sums)) < 2**63:
            z = x * self.n - np.array(self.sums, np.int64)
            return (z * z).sum(axis=1).tolist()
        z = x.astype(object) * self.n - np.array(self.sums, object)
        return [v if v < 2**63 else None for v in (z * z).sum(axis=1).tolist()]


def _centre(n: int, sums: list[int]) -> Centre:
    means = [Fraction(s, n) for s in sums]
    high = [float(m) for m in means]
    return Centre(n, sums, (np.array(high), np.array([float(m - Fraction(h)) for m, h in zip(means, high, strict=True)])))


def covariance(fit: DataFrame, d: int, centred: Callable[[np.ndarray], DoubleDouble], width: int, n: int) -> DoubleDouble:
    """Covariance, divisor n, of the ``width`` centred numbers made of each x-vector, as a square double-double matrix."""
    i, j = np.triu_indices(width)

    def products(x: np.ndarray) -> DoubleDouble:
        high, low = centred(x)
        a, b = split(high)
        p = high[:, i] * high[:, j]
        e = ((a[:, i] * a[:, j] - p) + a[:, i] * b[:, j] + b[:, i] * a[:, j]) + b[:, i] * b[:, j]
        return two_sum(p, e + (high[:, i] * low[:, j] + low[:, i] * high[:, j]))

    total = over(_total(fit, products, d, len(i)), n)
    out = np.zeros((2, width, width))
    for k in (0, 1):
        out[k][i, j] = out[k][j, i] = total[k]
    return out[0], out[1]


def _product(a: DoubleDouble, b: np.ndarray) -> DoubleDouble:
    """Matrix a (double-double) by matrix b, column by column of a."""
    acc = (np.zeros((len(a[0]), b.shape[1])), np.zeros((len(a[0]), b.shape[1])))
    for k in range(len(b)):
        row = np.broadcast_to(b[k], acc[0].shape)
        acc = plus(acc, times((np.broadcast_to(a[0][:, k, None], row.shape), np.broadcast_to(a[1][:, k, None], row.shape)), (row, np.zeros_like(row))))
    return acc


def _leading(v: DoubleDouble, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues of over CLEAR of the greatest, falling, with unit eigenvectors as columns; and the other vectors.

    Reduction to a tridiagonal matrix, divide and conquer on it (LAPACK's syevd, which numpy's eigh calls), then two
    steps of mending in double-double: what is left of each other vector in V x - e x, over the distance of the
    eigenvalues, is taken out. Vectors of equal eigenvalues stay as they are, orthogonal.
    """
    values, x = np.linalg.eigh(v[0])
    values, x = values[::-1].copy(), np.ascontiguousarray(x[:, ::-1])
    k = min(most, max(1, int((values > values[0] * CLEAR).sum())))
    at = np.arange(k)
    for _ in range(2):
        first = np.ascontiguousarray(x[:, :k])
        vx, t = _product(v, first), (np.ascontiguousarray(x.T), np.zeros_like(x))
        s, r = plus(_product(t, vx[0]), (x.T @ vx[1], np.zeros_like(vx[0]))), _product(t, first)
        values[:k] = s[0][at, at] / r[0][at, at]
        back = times((np.broadcast_to(values[:k], s[0].shape), np.zeros_like(s[0])), r)
        rest = plus(s, (-back[0], -back[1]))[0]
        gap = values[None, :k] - values[:, None]
        same = np.abs(gap) <= abs(values[0]) * 1e-15
        e = np.where(same, -r[0] / 2, rest / np.where(same, 1, gap))
        e[at, at] = (1 - r[0][at, at] - r[1][at, at]) / 2
        x[:, :k] = first + x @ e
    first, others = x[:, :k], x[:, k:]
    return values[:k], first / np.linalg.norm(first, axis=0), others - first @ (first.T @ others)


def principal(v: DoubleDouble, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of V, falling, and unit eigenvectors as rows.

    Eigenvalues far below the greatest are rounding to it. So the clear ones are taken, then V is looked at anew,
    in double-double, in the space that is left; an error of the vectors enters there by its square only.
    """
    values, vectors, basis, here = [], [], np.eye(len(v[0])), v
    top = None
    while len(values) < most and basis.shape[1]:
        e, x, others = _leading(here, most - len(values))
        top = e[0] if top is None else top
        real = e > max(top, 0) * LEAST_SHARE
        values, vectors = [*values, *e[real]], [*vectors, *(basis @ x[:, real]).T]
        if not real.all() or not others.shape[1] or len(values) >= most:
            break
        basis = np.ascontiguousarray(np.linalg.qr(basis @ others)[0])
        half = _product(v, basis)
        t = (np.ascontiguousarray(basis.T), np.zeros_like(basis.T))
        here = plus(_product(t, half[0]), (basis.T @ half[1], np.zeros((basis.shape[1],) * 2)))
        here = tuple((a + a.T) / 2 for a in here)
    return np.array(values), np.array(vectors).reshape(len(values), len(v[0]))


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return _project(self.centre, self.values, self.vectors, x)


def _project(centre: Centre, values: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> np.ndarray:
    high, low = centre.apart(x)
    return (high @ vectors.T + low @ vectors.T) / np.sqrt(values)


def fit(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """Whitening learned from each distinct vector ``x`` (array of long) once; None if there is none.

    The vectors' length is the one that most rows have, of equals the greatest; other rows are not learned from.
    """
    sizes = vectors.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return None
    d = sizes[0]["d"]
    rows = written(vectors.where(F.size("x") == d).select("x").distinct())
    n, sums = _exact_sums(rows, d)
    centre = _centre(n, sums)
    v = covariance(rows, d, centre.apart, d, n)
    values, axes = principal(v, components)
    trace = math.fsum([*np.diag(v[0]), *np.diag(v[1])])
    k = len(values)
    error = 0.0
    if k:
        white = lambda x: (_project(centre, values, axes, x), np.zeros((len(x), k)))
        mean = over(_total(rows, white, d, k), n)
        again = lambda x: plus(white(x), (np.broadcast_to(-mean[0], (len(x), k)), np.broadcast_to(-mean[1], (len(x), k))))
        c = covariance(rows, d, again, k, n)
        error = float(np.abs((c[0] - np.eye(k)) + c[1]).max())
    return Whitening(centre, values, axes, trace, error)


def whiten(vectors: DataFrame, w: Whitening | None, keep: list[str]) -> DataFrame:
    """The columns ``keep``, component, n, deviation, whitened, explained and identity_error of each row with ``x``.

    Components are numbered from 1 by falling eigenvalue; those without any variance are left out, so equal vectors
    alone give no row. Repeated rows stay. A vector of another length than the learned ones has null deviation and
    whitened. An empty table gives no row. ``keep`` must not hold the names of the new columns.
    """
    new = T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")
    data = vectors.select(*keep, F.col("x").alias("__x"))
    schema = T.StructType([*data.schema.fields[:-1], *new.fields])
    if w is None or not len(w.values):
        return data.sparkSession.createDataFrame([], schema)
    k, d = len(w.values), len(w.centre.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            x, fits = _matrix(column, d)
            white = np.full((len(column), k), np.nan)
            white[fits] = w.apply(x)
            found = iter(w.centre.deviation(x))
            deviation = pa.array([next(found) if f else None for f in fits], pa.int64())
            at = pa.array(np.repeat(np.arange(len(column)), k))
            flat = white.ravel()
            made = [
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(column))), pa.array(np.full(len(at), w.centre.n, np.int64)), deviation.take(at),
                pa.array(flat, mask=np.repeat(~fits, k)), pa.array(np.tile(w.values / w.trace, len(column))), pa.array(np.full(len(at), w.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[: len(keep)]), *made], names=schema.names)

    return data.mapInArrow(run, schema)
