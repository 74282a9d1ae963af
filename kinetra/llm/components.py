"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v), v < u: every neighbour is linked to the least node of its neighbourhood.

    The least neighbour comes from a partially aggregated groupBy, so a hub costs one row per task; the join back
    is an ordinary equi-join whose large side Spark may split.
    """
    seen = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m"))
    near = seen.join(least.select("u", F.least("u", "m").alias("m")), "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) integer edges in any order -> (node, root), root the least node reachable; roots themselves are left out.

    Each round is checkpointed. It ends when a round changes nothing, told by a count and a sum of row hashes.
    An empty edge table gives an empty result; loops and repeated edges have no effect. Rounds grow with the logarithm
    of a component's size; one that does not settle in `rounds` (beyond any size that fits on disk) is an error.
    """
    now = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        now = durable(_star(_star(now, large=True), large=False))
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
