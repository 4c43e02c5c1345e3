"""Connected components of a graph given as edges, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """edges: a, b (long). Returns node, root: the smallest node that each node of an edge reaches.

    Each step sends a node's neighbours to its smallest one, so that hubs shrink instead of growing; every round is
    written to the shared folder, and the rounds end when a round changes nothing (they grow with the logarithm of the
    longest path). Minima are aggregated before they are shuffled, and written before they are joined, so that the tasks
    of a hub can be split.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        # large star: every larger neighbour of a node is tied to the least of the node and its neighbours
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = settle(large, "large")
        # small star: the node and its smaller neighbours are tied to the least of them
        least = settle(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        last, edges = edges, settle(small, "edges")
        discard(last, low, large, least)  # a round needs the edges of the one before and nothing older
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
