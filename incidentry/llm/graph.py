"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: longs, a <> b), root being the component's smallest node.

    Every step is a partial aggregate and a join on the node; a node with very many links costs one row per map task in
    the aggregate. Links are checkpointed after each round (two steps), and only their number and the exact sums of two
    64-bit hashes of each reach the driver, to see that nothing changed.
    """
    links = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        links = checkpointed(_small_star(_large_star(links)))
        now = tuple(links.agg(F.count("*"), *[F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
                                                   for c in (("a", "b"), ("b", "a"))]).first())
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node to the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, to the smallest of them. ``links`` have a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
