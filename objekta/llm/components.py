"""Distributed union-find: connected components of an edge list by alternating large-star and small-star steps.

Each step points nodes at the smallest neighbour they know, so that paths halve and the number of rounds grows with the
logarithm of a component's width. Every round is written to the shared folder, which cuts the lineage; a component of any
size is only ever met as aggregates (min) and joins, never as one group in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objekta.llm.common import cut

MOST_ROUNDS = 60


def _star(pairs: DataFrame) -> DataFrame:
    """Large star, then small star, of edges (a, b) with a > b."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    large = both.join(least, "a").where("b > a and b > low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("low"))
    small = large.join(least, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return small.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), a result of cut(); component is the smallest node of its component.

    Self loops, repeated edges and either direction are fine; edges with a null end are ignored; no edges, no rows.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, mark = cut(pairs, "components"), None
    for _ in range(MOST_ROUNDS):
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark, pairs = now, cut(_star(pairs), "components", pairs)
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cut(pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components", pairs)
