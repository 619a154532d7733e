"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossbook.session import stage


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Every node's larger (or, one way, all) neighbours move to its smallest neighbour."""
    e = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else edges
    low = e.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    moved = e.join(low, "a")
    if both_ways:
        return moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node of the edges (a, b) can reach.

    Nodes without an edge are not in the result. Each round is written to the shared folder, so
    lineage stays short. Rounds grow with the logarithm of the longest path.
    """
    down = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    state = None
    while True:
        large = _star(down, True).filter("a > b").distinct()
        small = stage(_star(large, False).filter("a > b").distinct(), "edges")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return small.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                small.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        state, down = now, small
