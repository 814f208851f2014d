"""Sources and sinks: table snapshots, nested JSON results, lineage cuts.

Snapshots are Parquet folders.  A change job never overwrites the folder it
reads: ``write_change`` writes the new snapshot of every table it touched
(and the outcome) under a new folder, which the caller then promotes.
``cut`` ends a long lineage by writing the frame to the shared folder the
cluster names in ``spark.checkpoint.dir`` (reliable checkpoint, not a
machine-local one), so a lost executor costs a re-read, not a recompute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                sort_within: list[str] | None = None) -> None:
    """Write a snapshot; ``sort_within`` clusters rows by key inside each file
    so Parquet min/max statistics prune row groups on later key lookups."""
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_change(change, base_path: str) -> dict[str, str]:
    """Write every new table of a ``Change`` and its outcome; returns the paths."""
    paths = {}
    for name, df in {**change.tables, "outcome": change.outcome}.items():
        if df is None:
            continue
        paths[name] = f"{base_path.rstrip('/')}/{name}"
        write_table(df, paths[name])
    return paths


def write_nested_json(df: DataFrame, path: str) -> None:
    """The reference's response shape: one JSON object per row, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
