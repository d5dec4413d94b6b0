"""Connected components of link tables by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is hung on the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them; edges point from a to smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    others = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return others.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node of its component for each node that has a link.

    Links are undirected, may repeat and may join a node to itself (ignored, as are
    nulls). Rounds grow with the logarithm of a component's diameter; each round is
    written to the shared checkpoint folder, so a lost executor costs a re-read.
    Minima are summed before each shuffle, a hub's joins are left to the adaptive
    skew join, and no component is ever gathered. No links give an empty table.
    """
    spark = links.sparkSession
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    scratch: list[str] = []
    edges = stored(edges, scratch)
    state = None
    while True:
        after: list[str] = []
        stars = stored(_small_star(_large_star(edges)), after)
        seen = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(spark, scratch)
        if tuple(seen) == state:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges, scratch, state = stars, after, tuple(seen)
