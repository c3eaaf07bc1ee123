"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _stars(e: DataFrame) -> bool:
    """Whether every node but the roots has one edge, and that leads to a root."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("out")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("out")))
    ends = ends.groupBy("n").agg(F.sum("out").alias("out"), F.min("out").alias("root"))
    return ends.where("out > 1 or (out = 1 and root = 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; ``root`` is the smallest node of its component.

    Alternates large-star and small-star steps (O(log^2 n) rounds). Minima are aggregated before the
    shuffle and joined back, so a node with very many edges is never one group. Self loops and null
    ends are ignored; no edges give no rows.
    """
    a, b = edges.columns
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = stored(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")

    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
