"""Nested documents as lines: each parent with its children, never held as one value.

``collect_list`` builds a parent's array in one row of one task.  Here a
document is a run of lines: a head line (the parent's fields and the opening of
the array), a line per child, and a closing line.  The lines are range-
partitioned and sorted by (parent, line kind, child order), so a parent with a
third of all children spans many partitions and no task holds more than one
child; ``key_scan`` gives each child its position, and all but a parent's first
child start with a comma.  Written in that order, the part files put together
are JSON documents one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import key_scan

HEAD, CHILD, CLOSE = 0, 1, 2


def as_json(columns: list[str]) -> Column:
    """One JSON object of ``columns``, null fields kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def nested_lines(parents: DataFrame, children: DataFrame, key: str, child_key: str, child_order: list[str],
                 name: str, partitions: int | None = None) -> DataFrame:
    """(key, kind, position, line) in document order: parents by ``key``, children by ``child_order``, nulls first.

    ``key`` is the parents' primary key.  ``name`` is the array's field;
    ``child_key`` is left out of the children's objects, and children without a
    parent are left out.  A parent without children gets an empty array.
    ``position`` counts the children so far (0 on the head line).
    """
    ordered = [f"_o{i}" for i in range(len(child_order))]
    fields = [c for c in children.columns if c != child_key]
    known = children.join(parents.select(F.col(key).alias("_key")), F.col(child_key) == F.col("_key"), "left_semi")
    rows = known.select(F.col(child_key).alias(key), F.lit(CHILD).alias("kind"), as_json(fields).alias("line"),
                        *[F.col(c).alias(o) for c, o in zip(child_order, ordered, strict=True)])
    empty = [F.lit(None).cast(rows.schema[o].dataType).alias(o) for o in ordered]
    own = as_json(parents.columns)
    head = F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(f',"{name}":['))
    ends = parents.select(key, F.explode(F.array(
        F.struct(F.lit(HEAD).alias("kind"), head.alias("line")),
        F.struct(F.lit(CLOSE).alias("kind"), F.lit("]}").alias("line")))).alias("_e"))
    rows = rows.unionByName(ends.select(key, "_e.kind", "_e.line", *empty))
    placed = key_scan(rows, [key], ["kind", *ordered, "line"], count_if=F.col("kind") == CHILD, count_name="position",
                      partitions=partitions)
    comma = (F.col("kind") == CHILD) & (F.col("position") > 1)
    return placed.select(key, "kind", "position", F.concat(F.when(comma, ",").otherwise(""), "line").alias("line"))


def write_documents(lines: DataFrame, path: str) -> None:
    """Write the lines of ``nested_lines`` as text; the part files in name order hold the documents in order."""
    lines.select("line").write.mode("overwrite").text(path)
