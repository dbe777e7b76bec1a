"""Connected components by contraction, with joins and map-side sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._native import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is one of its nodes.

    Each round points every node to its lowest neighbour, follows the pointers
    once more and contracts the edges, so stars vanish at once and chains by
    more than half.  Rounds end when no edge is left.  A hot node is summed
    map-side and its joins can be split.
    """
    edges = cut(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mapping = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("to"))
        lowest = cut(lowest.select(F.col("a").alias("from"), "to"))
        onward = lowest.select(F.col("from").alias("to"), F.col("to").alias("next"))
        parent = cut(lowest.join(onward, "to", "left").select("from", F.coalesce("next", "to").alias("to")))
        if mapping is None:
            mapping = parent.select(F.col("from").alias("node"), F.col("to").alias("component"))
        else:
            mapping = mapping.join(parent, F.col("component") == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component"))
        mapping = cut(mapping)
        one = parent.select(F.col("from").alias("a"), F.col("to").alias("a2"))
        two = parent.select(F.col("from").alias("b"), F.col("to").alias("b2"))
        edges = cut(
            edges.join(one, "a").join(two, "b").where("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        )
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return mapping
