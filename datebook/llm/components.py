"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datebook.llm.common import checkpointed, release_shuffles


def _stars(sides: DataFrame) -> DataFrame:
    """``u, v`` with the least node of each star; a join and not a window, so a hub can be split."""
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return sides.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a``, ``b`` long); the component is its least node.

    Each round hangs every node on the least of its neighbours; it ends when a round changes nothing.
    Edges are kept in the shared checkpoint folder after each round, so neither the plan nor what a
    lost executor costs grows.  Null ends and loops are ignored.
    """
    edges = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        stars = _stars(large)
        small = stars.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(stars.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.filter("u <> v").distinct())
        del both, large, stars, small
        release_shuffles(edges.sparkSession)
        before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
