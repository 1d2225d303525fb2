"""Connected components by alternating stars (Kiveris et al., 2014), without links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot_split, materialize


def _star(pairs: DataFrame, total: int) -> DataFrame:
    """Each pair (u, v) becomes (v, m), m the least of u and its partners in ``pairs``; also (u, m)."""
    least = (pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_n")))
    spokes = join_hot_split(pairs, least, "u", "_n", total).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return (spokes.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .where("a <> b").distinct())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: long); a component's id is its least node.

    A hub's pairs may be a third of all: its least partner is a partial
    aggregate, given back by ``join_hot_split``.  Every round is written.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .where("a <> b").distinct(), "cc-links")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # Large star: greater partners are handed to the least one; small star: lesser partners are.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_n"))
        large = (join_hot_split(both, least, "u", "_n", 2 * state["n"]).where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        large = materialize(large, "cc-large")
        edges = materialize(_star(large, large.count()), "cc-small")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
