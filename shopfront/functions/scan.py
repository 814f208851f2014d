"""Per-key running counts, running sums and previous values that stay bounded on a hot key.

A window ``partitionBy(key).orderBy(...)`` sends every row of a key to one
task, so a key holding a third of the rows becomes a third of the job in a
single task.  ``key_scan`` computes the same running count / lag without
that: it range-partitions on the composite (key, order) — the range
partitioner samples that composite, so one hot key is cut into many
partitions of bounded size — and then

1. in each sorted partition a vectorized pass (``mapInArrow``; carried columns
   pass through as they are, so NaN and far dates stay) computes the running sums and previous value per key segment;
2. a key that continues from earlier partitions takes its carry (sums so
   far, last value) from a table built from the partitions' first and last
   rows; only the first key of a partition can continue from an earlier
   one, so the carry table has at most one row per partition and is
   broadcast on that proven bound (the partition count).

The branch that builds the carry table and the main branch read the same
range exchange, which Spark reuses (one sampling, one partitioner; a lost
map output is recomputed with that same partitioner).  With exchange reuse
switched off the partitioned rows are checkpointed first instead.

All ordering is ascending with nulls first; callers turn other orders into
ascending sort columns first.  ``order`` must make rows unique within a key
(end it with an id) so a recomputed partition sorts the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

_PID, _PFIRST, _PLAST, _LLAG = "_scan_pid", "_scan_pfirst", "_scan_plast", "_scan_llag"


def _f(i: int) -> str:
    return f"_scan_f{i}"


def _loc(i: int) -> str:
    return f"_scan_l{i}"


def _shifted(col: pa.Array, before: pa.Array) -> pa.Array:
    """``col`` one row later, with the one-row array ``before`` in front."""
    return pa.concat_arrays([before, col.slice(0, len(col) - 1)])


def _same_key(batch: pa.RecordBatch, keys: list[str], last: dict | None) -> np.ndarray:
    """Row i has the key of row i-1 (row 0: of the carried ``last`` key); nulls equal nulls, NaN equals NaN."""
    same = np.ones(batch.num_rows, bool)
    for k in keys:
        col = batch.column(k)
        prev = _shifted(col, last[k] if last else pa.nulls(1, col.type))
        eq = pc.or_(pc.fill_null(pc.equal(col, prev), False), pc.and_(col.is_null(), prev.is_null()))
        if pa.types.is_floating(col.type):
            eq = pc.or_(eq, pc.fill_null(pc.and_(pc.is_nan(col), pc.is_nan(prev)), False))
        same &= eq.to_numpy(zero_copy_only=False)
    if last is None:
        same[0] = False
    return same


def _local_pass(keys: list[str], n_sums: int, lag_of: str | None):
    """Arrow batches in, the same columns plus the local results out; no carried column is converted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, carry_v, pending, first = None, [0] * n_sums, None, None, True
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            same = _same_key(b, keys, last)
            begin = np.maximum.accumulate(np.where(same, -1, np.arange(n)))  # the row's segment starts there; -1: before
            out, names = list(b.columns), list(b.schema.names)
            for i in range(n_sums):
                total = np.cumsum(b.column(_f(i)).to_numpy(zero_copy_only=False).astype(np.int64))
                local = total - np.where(begin > 0, total[np.maximum(begin - 1, 0)], 0) + np.where(begin < 0, carry[i], 0)
                carry[i] = int(local[-1])
                out.append(pa.array(local))
                names.append(_loc(i))
            out.append(pa.array(np.arange(n) == 0 if first else np.zeros(n, bool)))
            names.append(_PFIRST)
            if lag_of is not None:
                col = b.column(lag_of)
                rows = pa.concat_arrays([pa.nulls(1, col.type) if carry_v is None else carry_v, col])
                out.append(rows.take(pa.array(np.arange(n), mask=~same)))
                names.append(_LLAG)
                carry_v = col.slice(n - 1, 1)
            last, first = {k: b.column(k).slice(n - 1, 1) for k in keys}, False
            if pending is not None:
                yield _with_last(*pending, False)
            pending = (out, names)
        if pending is not None:
            yield _with_last(*pending, True)
    return run


def _with_last(columns: list, names: list[str], ends: bool) -> pa.RecordBatch:
    flag = np.zeros(len(columns[0]), bool)
    flag[-1] = ends
    return pa.RecordBatch.from_arrays([*columns, pa.array(flag)], [*names, _PLAST])


def key_scan(df: DataFrame, keys: list[str], order: list[str], count_if: Column | None = None,
             lag_of: str | None = None, count_name: str = "running_count",
             lag_name: str = "previous", sum_of: Column | None = None,
             sums: dict[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` plus, per row, within its key in ``order`` (ascending, nulls first):

    * ``count_name`` — rows so far including this one for which ``count_if``
      holds (every row when ``count_if`` is None: the 1-based row number);
      with ``sum_of`` (an integral column; nulls count 0) the running sum of
      it instead;
    * ``sums`` — several such running sums in one pass, by output name
      (replaces ``count_name`` / ``count_if`` / ``sum_of``);
    * ``lag_name`` — ``lag_of`` of the previous row of the key (when given).

    Same results as ``F.sum(...).over(w)`` / ``F.lag(...).over(w)`` with
    ``w = Window.partitionBy(keys).orderBy(order)``.

    ``partitions`` — range partitions; default ``shopfront.scan.partitions``
    from the session, else ``spark.sql.shuffle.partitions``.  Adaptive
    execution does not resize a repartition with a fixed count, so on a
    large input set it to about input bytes / 128 MB.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("shopfront.scan.partitions", None)
                          or spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    if sums is None:
        flag = F.lit(1) if count_if is None else F.when(count_if, 1).otherwise(0)
        if sum_of is not None:
            flag = sum_of
        sums = {count_name: flag}
    names = list(sums)
    d = df
    for i, name in enumerate(names):
        d = d.withColumn(_f(i), F.coalesce(sums[name].cast("long"), F.lit(0)))
    d = d.repartitionByRange(n, *sort).withColumn(_PID, F.spark_partition_id())
    if spark.conf.get("spark.sql.exchange.reuse", "true").lower() != "true":
        # both branches below must see one partitioning; without exchange reuse
        # pin it in the shared checkpoint folder instead of sampling twice
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(spark)
        d = d.checkpoint(eager=True)

    fields = list(d.schema.fields) + [StructField(_loc(i), LongType()) for i in range(len(names))] \
        + [StructField(_PFIRST, BooleanType())]
    if lag_of is not None:
        fields.append(StructField(_LLAG, d.schema[lag_of].dataType))
    fields.append(StructField(_PLAST, BooleanType()))
    local = d.sortWithinPartitions(*sort).mapInArrow(_local_pass(keys, len(names), lag_of), StructType(fields))

    # Carry table from the partitions' first and last rows only (<= 2n rows; a
    # key's rows in an earlier partition are that partition's tail, so its
    # contribution is the last row's local sums).  Built from ``local`` (not
    # ``d``) so both branches share one identical range exchange, which Spark
    # reuses: one sampling, one set of partition bounds.
    n_cols = [f"_n{i}" for i in range(len(names))]
    v_type = StructType([StructField("v", d.schema[lag_of].dataType)]) if lag_of is not None else None
    first = F.struct(F.lit(0).alias("_tag"), *[F.lit(0).cast("long").alias(c) for c in n_cols],
                     *([F.lit(None).cast(v_type).alias("_v")] if lag_of is not None else []))
    last = F.struct(F.lit(1).alias("_tag"), *[F.col(_loc(i)).alias(c) for i, c in enumerate(n_cols)],
                    *([F.struct(F.col(lag_of).alias("v")).alias("_v")] if lag_of is not None else []))
    edges = (local.filter(F.col(_PFIRST) | F.col(_PLAST))
             .select(*keys, _PID, F.explode(F.filter(F.array(F.when(F.col(_PFIRST), first),
                                                             F.when(F.col(_PLAST), last)),
                                                     lambda e: e.isNotNull())).alias("_e"))
             .select(*keys, _PID, "_e.*"))
    # a first row sorts before its own partition's last row, so it sees only earlier partitions
    before = Window.partitionBy(*keys).orderBy(_PID, "_tag").rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.withColumn("_seen", F.sum("_tag").over(before))
    for i, c in enumerate(n_cols):
        carry = carry.withColumn(f"_off{i}", F.coalesce(F.sum(c).over(before), F.lit(0)))
    if lag_of is not None:
        carry = carry.withColumn("_carry_v", F.last("_v", ignorenulls=True).over(before).getField("v"))
    # only the first key of a partition continues from an earlier one: <= n rows
    carry = carry.filter((F.col("_tag") == 0) & (F.col("_seen") > 0)).select(
        *[F.col(k).alias(f"_ck_{k}") for k in keys], F.col(_PID).alias("_c_pid"),
        *[f"_off{i}" for i in range(len(names))], *(["_carry_v"] if lag_of is not None else []))

    cond = F.col(_PID) == F.col("_c_pid")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_ck_{k}"))
    out = local.join(F.broadcast(carry), cond, "left")
    for i, name in enumerate(names):
        out = out.withColumn(name, F.col(_loc(i)) + F.coalesce(F.col(f"_off{i}"), F.lit(0)))
    if lag_of is not None:
        out = out.withColumn(lag_name, F.when(F.col(_PFIRST) & F.col("_c_pid").isNotNull(), F.col("_carry_v"))
                             .otherwise(F.col(_LLAG)))
    return out.select(*df.columns, *names, *([lag_name] if lag_of is not None else []))
