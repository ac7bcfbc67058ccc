"""Connected components of links between integer nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import forget, written


def _to_least(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: each node's neighbours (only the larger, or the smaller and itself) are joined to its least neighbour."""
    if larger:
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        arcs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = arcs.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (a, b): the least node that can be reached.

    Alternates two star steps until nothing changes; each step is an
    aggregation with map-side minima and a join that may split skewed keys.
    Nodes and links never reach the driver, only a count and a checksum do.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    mark = None
    while True:
        past, edges = edges, written(_to_least(_to_least(edges, True), False), "links")
        forget(past)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now
