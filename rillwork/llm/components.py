"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Minima are aggregated before the shuffle and joined back, so a hub's edges are never one group."""
    both = edges if not large else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that both sides of the join are plain shuffles: of those Spark splits a hub's edges among tasks
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    near = both.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node points to one other, which points to none: its root, since edges point lower."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    loose = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1")
    return loose.agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the least node that links lead to.

    Edges point from the greater node to the less. Every step keeps components as they are; at the end each node
    points to its root only. Each step is written, so lost executors cost one step. Loops and repeated links do no
    harm; an empty table gives no row.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:  # edges only ever come to point lower, so this ends
        edges = written(_stars(written(_stars(edges, True)), False))
        if _settled(edges):
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
