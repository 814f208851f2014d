"""Join shapes that keep a hot key from landing in one task.

Join strategy otherwise is the planner's: a side whose estimated size is under
``spark.sql.autoBroadcastJoinThreshold`` is broadcast, a larger one is a shuffle
join on the key, and adaptive execution re-plans with measured sizes and splits
skewed partitions (thresholds in ``shopfront.session``).  ``F.broadcast`` is
written out only for sides with a proven row bound: the 25-row nation dimension
of the fixtures and the carry tables of ``functions.scan`` and
``functions.slots`` (at most two rows a partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """``parents`` left outer join ``children``: the parents' columns, then the children's without ``child_key``.

    In a left outer join only the left side can be split, and the parents'
    side cannot be broadcast, so a parent that owns a third of all children is
    one task.  Here the children are joined by an inner join, where adaptive
    execution splits the children's side of a hot key and small parents are
    broadcast without shuffling the children; parents without children are
    added by an anti join with the children's keys (aggregated before the
    shuffle).  Neither side's columns may share a name; null keys meet nothing.
    """
    own = [c for c in children.columns if c != child_key]
    met = F.col(parent_key) == F.col(child_key)
    found = children.join(parents, met).select(*parents.columns, *own)
    keys = children.select(child_key).distinct()
    alone = parents.join(keys, met, "left_anti").select(
        *parents.columns, *[F.lit(None).cast(children.schema[c].dataType).alias(c) for c in own])
    return found.unionByName(alone)
