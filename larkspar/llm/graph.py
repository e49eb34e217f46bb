"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspar.llm.common import Kept


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v). Large: each node's greater neighbours are linked to the least of its neighbourhood; small: its lesser ones and itself.

    The least neighbour is an aggregate (combined before the shuffle) that is joined back, so that no node's neighbours are gathered in one row."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge table (u, v), root being the component's least node; nodes without an edge don't appear.

    Each round is written to the shared folder; the rounds end when count and checksum of the edges stay the same (O(log n) rounds). Self-loops, repeated
    edges and an empty table are fine."""
    now = Kept(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        state = tuple(now.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        after = Kept(_star(_star(now.df, True), False), "edges")
        now.drop()
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
