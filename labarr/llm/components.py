"""Connected components of a graph given as an edge table, without gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (columns a, b): root is the smallest reachable.

    Large-star and small-star steps in turn: each links a node's neighbours to the
    smallest of its neighbourhood, so that the number of edges never grows and chains
    halve. The smallest is found by an aggregation with map-side combine, so a hub with
    millions of edges is reduced where its edges are. Ends when nothing changes; each
    step is a written table. Edges from a node to itself and repeated ones do not matter.
    """
    links = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    before = None
    for _ in range(most):
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: a node and its neighbours below go to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi != lo").unionByName(low.select("hi", F.col("m").alias("lo")))
        links = materialize(small.distinct(), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == before:
            return links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")).unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle within {most} rounds")
