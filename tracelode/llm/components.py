"""Connected components by alternating large and small stars, all in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: Edges of one file of a round, about.
FILE_EDGES = 100_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    ``edges`` has columns a and b of type long, in any direction, with repeats
    and loops allowed. Each round joins edges with the minimum of each node's
    neighbours, which is summed before the shuffle, so a node with very many
    neighbours does not gather in one task. As many files are written as the
    edges of the round before need, not one for each shuffle partition. Rounds grow with the logarithm of
    the longest path. No edges: no rows.
    """
    # Each edge runs from the larger node u to the smaller v.
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "component-edges")
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before, files = state, max(1, -(-state[0] // FILE_EDGES))
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(least, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        now = written(small.union(least).distinct().coalesce(files), "component-edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
