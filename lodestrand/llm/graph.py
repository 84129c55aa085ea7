"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import Scratch

MAX_ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node of its component.

    Each round replaces the edges of every node by edges to its smallest neighbour; the edges stay as many or become
    fewer, and the number of rounds grows with the logarithm of the graph.  Every round is written to the shared
    folder, and the one before is dropped.  Self loops and repeated edges are harmless; null nodes must not occur.
    """
    now = scratch.write(_ordered(edges.select(F.col(left).alias("u"), F.col(right).alias("v"))), "links-0")
    before = _state(now)
    for k in range(1, MAX_ROUNDS + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = _ordered(both.join(least, "u").where("v > u").select("v", F.col("m").alias("w")).select(F.col("v").alias("u"), F.col("w").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = scratch.write(_ordered(small), f"links-{k}")
        scratch.drop(f"links-{k - 1}")
        after = _state(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _ordered(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, larger node first, without self loops."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
