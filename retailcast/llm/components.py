"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import stored


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo") % 1_000_003).alias("s")).first()
    return row["n"], row["s"] or 0


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges (columns a, b); the root is the smallest node reachable.

    Edges with a null end and loops are left out. Each step is an aggregate and a join of two stored
    tables, so a hub with many neighbours is combined map-side and its join partition can be split;
    the number of steps grows with the logarithm of the longest path.
    """
    current = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    before = _checksum(current)
    while before[0]:
        # every larger neighbour of a node is linked to the smallest one
        both = current.select(F.col("hi").alias("node"), F.col("lo").alias("near")).unionByName(
            current.select(F.col("lo").alias("node"), F.col("hi").alias("near"))
        )
        least = stored(both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("root")), "star")
        large = both.where("near > node").join(least, "node").select(F.col("near").alias("hi"), F.col("root").alias("lo"))
        large = stored(large.where("hi <> lo").distinct(), "edges")
        # every smaller neighbour of a node is linked to the smallest one, and so is the node
        down = stored(large.groupBy("hi").agg(F.min("lo").alias("root")), "star")
        small = large.join(down, "hi").select(F.col("lo").alias("hi"), F.col("root").alias("lo")).where("hi <> lo")
        current = stored(small.unionByName(down.select("hi", F.col("root").alias("lo"))).distinct(), "edges")
        after = _checksum(current)
        if after == before:
            break
        before = after
    nodes = current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.unionByName(current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
