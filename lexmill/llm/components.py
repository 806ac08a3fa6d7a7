"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill.llm.common import discard, lookup_skewed, stored


def _min_neighbour(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and all its v. A u may hold any share of the pairs."""
    least = pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n"))
    return lookup_skewed(pairs, least, "u", "n")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (least node reachable) of every node in edges (a, b) but those that are their component's least.

    Steps repeat until the edges stay as they are: they are then stars around each component's least node. Each round is
    stored in the shared folder. Edges of a node with itself and repeated edges don't matter; no edges give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if found == state or not found[0]:
            break
        state = found
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(_min_neighbour(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")  # read three times
        small = _min_neighbour(large)
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = small.select("u", F.col("m").alias("v"))
        before, now = now, stored(moved.unionByName(own).distinct(), "edges")
        discard(before, large)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
