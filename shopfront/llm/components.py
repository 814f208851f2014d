"""Connected components of an edge table by alternating stars.

Each round hooks every larger neighbour of a node to the node's smallest
neighbour, then every smaller one; the edges shrink to stars around the
smallest node of each component after a logarithmic number of rounds.  A round
is joins and partial aggregates over edges; it is cut in the shared checkpoint
folder, and only an edge count and checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(
        F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                          F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return small.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)`` of longs; component is its smallest node."""
    now = cut(edges.filter("u <> v").select("u", "v").distinct())
    mark = None
    while True:
        got = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("u", "v") % 1000003))).first()
        if tuple(got) == mark or not got[0]:
            break
        mark, now = tuple(got), cut(_stars(now))
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
