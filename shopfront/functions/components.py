"""Connected components of a table of links, by alternating stars.

Each round first hangs every node's larger neighbours under its smallest one,
then all smaller neighbours; after a logarithmic number of rounds every node
hangs under the smallest of its component.  A round is two aggregates by node,
joined back on the node (the links are the side that a join may split when
one node has very many), and ends in a checkpoint, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import cut


def _hang(links: DataFrame) -> DataFrame:
    """Every (a, b) as (b, smallest of a and all that a is linked to)."""
    least = links.groupBy(F.col("a").alias("_a")).agg(F.least(F.min("a"), F.min("b")).alias("_least"))
    return (links.join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("_least").alias("b"))
            .filter("a <> b"))


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node that it is connected to.

    Links with a null, from a node to itself or given twice add nothing but the node.
    """
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct()
    now = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        larger = _hang(both).filter("a > b").distinct()            # every node above its neighbours' smallest
        own = larger.groupBy(F.col("a").alias("_v")).agg(F.min("b").alias("_low"))
        moved = larger.join(own, F.col("a") == F.col("_v")).select(F.col("b").alias("a"), F.col("_low").alias("b"))
        kept = own.select(F.col("_v").alias("a"), F.col("_low").alias("b"))
        now = cut(moved.filter("a <> b").unionByName(kept).distinct())
    roots = now.groupBy(F.col("a").alias("_n")).agg(F.min("b").alias("_root"))
    return (nodes.join(roots, F.col("node") == F.col("_n"), "left")
            .select("node", F.coalesce("_root", "node").alias("root")))
