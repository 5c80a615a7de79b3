"""Connected components of an edge table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brightshelf.session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours of each node on its smallest one: the larger ones, or the smaller ones and itself."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "lowest")
    joined = both.join(least, "a")
    moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")) if large else joined.select("b", "low").toDF("a", "b").unionByName(least.toDF("a", "b"))
    return moved.where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (a, b); the component is its smallest node.

    Loops and repeated edges are harmless; the number of rounds grows with the logarithm of the
    number of nodes. Every round is written to the shared folder.
    """
    now = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        now = materialise(_star(materialise(_star(now, True), "large-star"), False), "small-star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
