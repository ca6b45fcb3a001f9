"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaffinity.llm.frames import checkpointed


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); a component is named by its least node.

    Alternates two steps until nothing changes: all larger neighbours of a node are tied to the
    least in its neighbourhood, then the node and its smaller neighbours are. Every step is a
    partial minimum and a join, so a node with many links needs no task of its own. Rounds grow
    with the logarithm of the longest chain.
    """
    edges = checkpointed(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    before = None
    while True:
        near = _both_ways(edges)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            lower.select("a", F.col("m").alias("b"))
        )
        edges = checkpointed(small.filter("a <> b").distinct())
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))
        ).first()
        if state == before:
            break
        before = state
    nodes = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return nodes.withColumnRenamed("a", "node").union(roots)
