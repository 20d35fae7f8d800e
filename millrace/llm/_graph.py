"""Connected components by alternating large-star and small-star rounds; no link leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node reachable), for nodes with a link to another node.

    Union by smallest root: a large-star round hangs each node's larger neighbours under its smallest one, a small-star
    round does so for the smaller ones, until every node hangs under its root. Rounds grow with the logarithm of a
    chain's length. Null ends and links of a node to itself are left out; repeated links count once.
    """
    edges = cut(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct()
    )
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select("v", F.col("m").alias("u")).distinct()
        root = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(root, "v")
        edges = cut(
            moved.select("v", F.col("m").alias("u")).unionByName(moved.where(F.col("u") > F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct()
        )
        # Done when no node has two parents and no parent hangs under another.
        twice = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        below = edges.select(F.col("u").alias("v")).distinct().join(edges, "v", "left_semi").select("v")
        if not twice.select("v").unionByName(below).limit(1).collect():
            break
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
