"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopfront.session import ensure_checkpoint_dir

#: Rows per Arrow batch: texts may be long, so batches hold few of them.
BATCH_ROWS = 256

#: A-Z to a-z and nothing else (for ``F.translate``).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Bound the memory that a Python worker needs for one batch of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder: computed once, and safe from lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def packed(docs: DataFrame, *also: str | Column) -> DataFrame:
    """doc_id, text (and ``also``), and the whole row as ``_row``, so that no further column can clash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select("doc_id", "text", *also, whole.alias("_row"))


def unpacked(rows: DataFrame) -> DataFrame:
    """The columns that ``packed`` put in ``_row``."""
    return rows.select(*[F.col("_row").getField(f.name).alias(f.name) for f in rows.schema["_row"].dataType])


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 modulo 4 (null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, most: int, by: str | None = None) -> DataFrame:
    """At most ``most`` rows (of each value of ``by``): those with the smallest hash of ``key``.

    Only keys are ranked; the last scan picks the rows by a broadcast of at
    most ``most`` keys per value.  Ties keep the smaller key.  With ``by``, a
    count of keys per hash range (65,536 ranges a value, added up before the
    shuffle) first tells how far in hash order a value's sample reaches, so
    that no task ranks more than ``most`` keys and one range of a value.
    """
    hashed = F.xxhash64(F.col(key))
    order = [hashed, F.col(key)]
    if by is None:
        ids = rows.select(key).orderBy(*order).limit(most)
    else:
        keys = rows.select(key, by, F.shiftright(hashed, 48).alias("_range"))
        up_to = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        reach = (keys.groupBy(by, "_range").agg(F.count("*").alias("_n"))
                 .withColumn("_before", F.coalesce(F.sum("_n").over(up_to), F.lit(0))).filter(F.col("_before") < most)
                 .groupBy(F.col(by).alias("_by")).agg(F.max("_range").alias("_last")))
        near = keys.join(F.broadcast(reach), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") <= F.col("_last")),
                         "left_semi")
        w = Window.partitionBy(by).orderBy(*order)
        ids = near.select(key, by).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).select(key)
    return rows.join(F.broadcast(ids.distinct()), key, "left_semi")


class ChunkTable:
    """Bounded table of chunk -> value that segments each distinct chunk once.

    ``segment`` gets a list of unseen chunks and returns their values.  Chunks
    over ``longest`` characters are never kept.  When ``limit`` chunks have come
    into use, those that were not used for as long are forgotten.
    """

    def __init__(self, segment: Callable[[list[str]], list], limit: int = 250_000, longest: int = 64):
        self.segment, self.limit, self.longest = segment, limit, longest
        self.known, self.older = {}, {}

    def values(self, chunks: list[str]) -> list:
        """Values of distinct chunks, in their order."""
        found = list(map(self.known.get, chunks))
        places, missing = [], []
        for i in [i for i, v in enumerate(found) if v is None]:
            c = chunks[i]
            if c in self.older:
                found[i] = self.known[c] = self.older[c]
            elif c not in self.known:
                places.append(i)
                missing.append(c)
        for i, c, v in zip(places, missing, self.segment(missing), strict=True):
            found[i] = v
            if len(c) <= self.longest:
                self.known[c] = v
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        return found

    def join(self, rows: list[list[str]], combine: Callable = list) -> Iterator:
        """Values of each row's chunks, joined back by position with ``combine``."""
        wanted: set[str] = set()
        for row in rows:
            wanted.update(row)
        wanted = wanted.difference(self.known)
        missing = list(wanted.difference(self.older))
        self.known.update((c, self.older[c]) for c in wanted.difference(missing))
        self.known.update(zip(missing, self.segment(missing), strict=True))
        get = self.known.__getitem__
        for row in rows:
            yield combine(map(get, row))
        for c in missing:
            if len(c) > self.longest:
                del self.known[c]
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}


def packed_bytes(values: np.ndarray, size: int) -> bytes:
    """Little-endian values as planes of bytes, the highest first (sorted values then compress)."""
    planes = np.ascontiguousarray(values.astype("<u8").view("u1").reshape(-1, 8)[:, :size].T)
    return planes[::-1].tobytes()


def unpacked_bytes(data: bytes, size: int) -> np.ndarray:
    """The values of ``packed_bytes``."""
    planes = np.frombuffer(data, "u1").reshape(size, -1)[::-1]
    out = np.zeros((planes.shape[1], 8), "u1")
    out[:, :size] = planes.T
    return out.view("<u8")[:, 0]
