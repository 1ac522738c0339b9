"""Connected components of an edge table by alternating stars, as joins and group-bys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountloom.session import pin


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``node, component`` for every node of an edge; the component is its smallest node.

    Nodes may be of any type with an order; nulls and loops are ignored, repeated
    edges count once.  Each round hangs the larger neighbours of a node, then the
    smaller ones, under the least of them, which needs a number of rounds that grows
    with the logarithm of the longest chain.  A node with most of the edges costs one
    row per task in the group-by and is split by the skew join; every round is written
    to the shared folder, so a lost executor repeats one round at most.
    """
    a, b = F.col(left), F.col(right)
    now = pin(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(),
              "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
                        F.sum(F.xxhash64("b", "a") % 1_000_003).alias("s")).collect()[0]
        if state["n"] == 0 or state == seen:
            break
        seen = state
        now = pin(_small_star(_large_star(now)), "stars")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", "m")).distinct()
