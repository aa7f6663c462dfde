"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.rows import checkpointed


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of node and neighbours."""
    ways = _both_ways(edges)
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (ways.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = (edges.join(least, "a").where("b <> least")
             .select(F.col("b").alias("a"), F.col("least").alias("b")))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _state(edges: DataFrame):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003),
                    F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) that is not the smallest of its
    component; root is the smallest. Loops and repeated edges do no harm.

    Alternating large and small stars. A round only shuffles edges; the minimum per node
    combines before its shuffle, so a node with many neighbours is no burden, and the join
    that hands it out is one AQE may split.
    """
    stars = checkpointed(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(stars)
    while before[0]:
        stars = checkpointed(_small_star(_large_star(stars)))
        after = _state(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
