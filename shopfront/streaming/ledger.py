"""A table that a stream keeps up to date: one base snapshot plus the batches since.

Each micro-batch writes its changed rows to ``<path>/delta/batch_id=N``; every
``compact_every`` batches the base and all deltas are merged into a new base
``<path>/base/upto=N``.  A reader takes the newest complete base and the deltas
after it, so it reads at most ``compact_every`` batches however long the stream
has run.  Both kinds of folder are overwritten by a retried batch, and a base
without its ``_SUCCESS`` marker is ignored, so a crash at any point leaves a
readable table.  Folders that no reader of the two newest bases needs are
removed after a compaction.

A row's key columns name it; of several rows with a key the one of the latest
batch counts.  Merging is one partial aggregate (``max_by`` the batch), so a hot
key is combined before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MergedTable:
    path: str
    keys: tuple[str, ...]
    compact_every: int = 10

    def _folder(self, *parts: str) -> str:
        return "/".join([self.path.rstrip("/"), *parts])

    def _numbers(self, spark: SparkSession, kind: str, name: str) -> list[int]:
        """The N of all complete ``<kind>/<name>=N`` folders, ascending (on any Hadoop file system)."""
        hadoop = spark._jvm.org.apache.hadoop.fs
        top = hadoop.Path(self._folder(kind))
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(top)
                      if s.getPath().getName().startswith(f"{name}=")
                      and fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))

    def _remove(self, spark: SparkSession, kind: str, name: str, numbers: list[int]) -> None:
        hadoop = spark._jvm.org.apache.hadoop.fs
        for n in numbers:
            gone = hadoop.Path(self._folder(kind, f"{name}={n}"))
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Add a micro-batch (``foreachBatch``); merge when its turn has come."""
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(self._folder("delta", f"batch_id={batch_id}"))
        bases = self._numbers(spark, "base", "upto")
        waiting = [n for n in self._numbers(spark, "delta", "batch_id") if not bases or n > bases[-1]]
        if len(waiting) >= self.compact_every:
            self.compact(spark)

    def pending(self, spark: SparkSession) -> list[int]:
        """Batches that a reader has to merge with the newest base."""
        bases = self._numbers(spark, "base", "upto")
        return [n for n in self._numbers(spark, "delta", "batch_id") if not bases or n > bases[-1]]

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The latest row of every key; None before the first batch."""
        bases, waiting = self._numbers(spark, "base", "upto"), self.pending(spark)
        parts = [spark.read.parquet(self._folder("base", f"upto={bases[-1]}"))
                 .withColumn("_batch", F.lit(bases[-1]).cast("long"))] if bases else []
        parts += [spark.read.parquet(self._folder("delta", f"batch_id={n}"))
                  .withColumn("_batch", F.lit(n).cast("long")) for n in waiting]
        if not parts:
            return None
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        values = [c for c in rows.columns if c not in (*self.keys, "_batch")]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_batch").alias("_row"))
        return latest.select(*self.keys, *[F.col("_row").getField(c).alias(c) for c in values])

    def compact(self, spark: SparkSession) -> None:
        """Merge everything into a new base; keep the one before for readers that have started on it."""
        waiting = self.pending(spark)
        if not waiting:
            return
        before = self._numbers(spark, "base", "upto")
        self.read(spark).write.mode("overwrite").parquet(self._folder("base", f"upto={waiting[-1]}"))
        self._remove(spark, "base", "upto", before[:-1])
        if before:
            self._remove(spark, "delta", "batch_id",
                         [n for n in self._numbers(spark, "delta", "batch_id") if n <= before[-1]])


def start(stream: DataFrame, table: MergedTable, checkpoint: str, mode: str = "update", available_now: bool = True):
    """Run ``stream`` into ``table``; returns the streaming query."""
    writer = (stream.writeStream.outputMode(mode).foreachBatch(lambda batch, n: table.write(batch, n))
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
