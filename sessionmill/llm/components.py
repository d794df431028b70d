"""Connected components of a graph that is far larger than one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.session import discard, stored


def _directed(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _directed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _directed(tied.union(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of ``edges(u, v)`` can reach, as ``(node, component)``.

    Alternates large-star and small-star steps until the edges are stars around
    the smallest nodes. Both steps are an aggregation and a join, and each
    round's edges are written to the shared folder, so a lost executor costs one
    round. Each round lessens the sum of all edges' ends until nothing changes, so
    the rounds end by themselves. Nodes without an edge to another node do not appear. Null ends are
    ignored; repeated edges and loops change nothing.
    """
    edges = stored(_directed(edges.dropna()), "edges")
    settled = False
    while not settled:
        after = stored(_small_star(_large_star(edges)), "edges")
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, after)]
        discard(edges)
        edges, settled = after, sums[0] == sums[1]
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
