"""Connected components of a graph given as links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize


def _large_stars(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour instead."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("n")).where("b > a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_stars(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    moved = down.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = least.select(F.col("n").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(kept).where("a != b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root of every linked node; the root is the smallest node reachable.

    links: columns a and b of one ordered type, any direction, repeats allowed, loops ignored. Two
    aggregations and two joins a round, on links alone; a hub is one row on the side it is joined
    with, so a large star can be split by the join. Each round is written to the shared folder. The
    number of rounds grows with the logarithm of a component's size; running out of them is an error.
    """
    links = materialize(links.select("a", "b").where("a != b").distinct(), "component-links")
    before = None
    for _ in range(rounds):
        links = materialize(_small_stars(_large_stars(links)), "component-links")
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            leaves = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
        before = state
    raise RuntimeError("components did not settle")
