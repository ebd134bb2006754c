"""Exact order statistics by narrowing histograms: no task holds more than the buckets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_statistic(df: DataFrame, value: str, k: int, buckets: int = 1024) -> float:
    """The k-th smallest value, from 0, of a column of finite numbers with more than k rows.

    Each round counts the values of the interval in ``buckets`` equal ranges and goes on with the range that holds
    the k-th, until all values of that range are the same: about one round for each factor of ``buckets``.
    """
    v = F.col(value).cast("double")
    rows = df.select(v.alias("v"))
    span = rows.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    low, high = span["low"], span["high"]
    while low < high:
        # halves first, so that the width of the widest interval does not overflow
        place = F.least(F.lit(buckets - 1), F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * buckets))
        inside = rows.where(F.col("v").between(low, high)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for r in sorted(inside.collect(), key=lambda x: x["b"]):  # as many rows as buckets
            if k < r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def quantile(df: DataFrame, value: str, q: float) -> float | None:
    """The quantile of a column, between the two order statistics beside it; nulls and NaN count for nothing, none if there is no value."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    n = rows.count()
    if not n:
        return None
    at = q * (n - 1)
    low = order_statistic(rows, value, math.floor(at))
    high = low if at == math.floor(at) else order_statistic(rows, value, math.floor(at) + 1)
    return low + (high - low) * (at - math.floor(at))
