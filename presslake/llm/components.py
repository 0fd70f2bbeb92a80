"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.llm.staging import forget, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From links ``a, b``: every node that has a link, and ``label``, its component's smallest node.

    Groups are only ever reduced to a minimum, which is partial before the shuffle, and each
    round is written to the shared folder. Rounds grow with the logarithm of the links; more
    than ``most_rounds`` raise, they are never cut short.
    """
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "components")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    for _ in range(most_rounds):
        following = written(_small_star(_large_star(edges)), "components")
        now = state(following)
        forget(edges)
        edges = following
        if now == before:
            leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
