"""One slot per key that holds at most one id: what it holds before and after every row, in order.

A row may put an id (taken if the slot is empty) or drop one (the slot is
emptied if it holds just that id).  Whether a row has an effect depends on all
rows of its key before it, yet a key may hold a third of the rows, so they are
not gathered: the rows are range-partitioned on (key, order), which cuts a hot
key into many tasks, and

1. every task reduces the part of its first key to a transition: what the slot
   holds at the end if it comes in empty, and, for each id dropped in the part
   but put before it, what it holds if that id comes in.  (Any other incoming
   id is still there at the end.)  Transitions compose, so
2. a pass over each key's transitions in partition order gives what comes in
   to each part, at most one value a partition, which is broadcast on that
   proven bound (as in ``scan``), and
3. a second pass over the same partitions (one reused exchange) replays the
   rows from there.

Nothing runs before the result is used.  Ids are put once each; ``order`` is
unique within a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import ensure_checkpoint_dir

_PID, _PUT, _DROP, _IN = "_slot_pid", "_slot_put", "_slot_drop", "_slot_in"


def _whole(values) -> list[int | None]:
    return [None if pd.isna(v) else int(v) for v in values]


def _after(held: int | None, put: int | None, drop: int | None) -> int | None:
    if held is None:
        return put
    return None if drop == held else held


def transition(puts: list[int | None], drops: list[int | None]) -> tuple[int | None, dict[int, int | None]]:
    """What a part turns an empty slot into, and each id that it drops but does not put."""
    empty_ends = None         # what an empty slot before this row ends as
    first_drop: dict[int, int | None] = {}   # id -> what the slot ends as after its first drop from here on
    for put, drop in zip(reversed(puts), reversed(drops)):
        if drop is not None:
            first_drop[drop] = empty_ends
        if put is not None:
            # emptied again by its first drop, else it stays
            empty_ends = first_drop.pop(put) if put in first_drop else put
    return empty_ends, first_drop


def _transitions(key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, puts, drops, pid, last, held, moved = None, [], [], None, None, None, False
        for rows in batches:
            if rows.empty:
                continue
            pid = int(rows[_PID].iloc[0])
            keys = [None if pd.isna(k) else k for k in rows[key]]
            if first is None:
                first = (keys[0],)
            for k, put, drop in zip(keys, _whole(rows[_PUT]), _whole(rows[_DROP])):
                if not moved and k == first[0]:
                    puts.append(put)
                    drops.append(drop)
                    continue
                if not moved or k != last:
                    moved, last, held = True, k, None
                held = _after(held, put, drop)
        if first is None:
            return
        ends, map_ = transition(puts, drops)
        out = [(first[0], pid, None, ends), *[(first[0], pid, i, e) for i, e in map_.items()]]
        if moved:
            out.append((last, pid, None, held))
        frame = pd.DataFrame(out, columns=["k", "pid", "i", "ends"])
        yield frame.astype({"pid": "int64", "i": "Int64", "ends": "Int64"})
    return run


def _incoming(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (k, pid, i with null first) -> what comes in to each part but a key's first."""
    at, held, ends = None, None, None
    for rows in batches:
        out = []
        for k, pid, i, e in zip([None if pd.isna(k) else k for k in rows["k"]], rows["pid"], _whole(rows["i"]), _whole(rows["ends"])):
            if at is None or at[0] != k:
                at, held, ends = (k, pid), None, None     # a key's first part comes in empty
            elif at[1] != pid:
                at, held = (k, pid), ends
                if held is not None:
                    out.append((k, pid, held))
                ends = held
            if i is None:
                ends = e if held is None else held
            elif held is not None and i == held:
                ends = e
        yield pd.DataFrame(out, columns=["k", "pid", _IN])


def _replay(key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for rows in batches:
            before, after = [], []
            keys = [None if pd.isna(k) else k for k in rows[key]]
            for k, put, drop, came in zip(keys, _whole(rows[_PUT]), _whole(rows[_DROP]), _whole(rows[_IN])):
                if last is None or last[0] != k:
                    last, held = (k,), came
                before.append(held)
                held = _after(held, put, drop)
                after.append(held)
            yield rows.drop(columns=[_IN]).assign(held_before=pd.array(before, "Int64"), held_after=pd.array(after, "Int64"))
    return run


def slot_scan(df: DataFrame, key: str, order: str, put: Column, drop: Column, partitions: int | None = None) -> DataFrame:
    """``df`` and ``held_before``, ``held_after``: the id in the slot of the row's key around the row.

    ``put``, ``drop`` are ids or null.  Null keys are one key.  ``partitions`` as in ``scan.key_scan``.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("shopfront.scan.partitions", None)
                          or spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(key).asc_nulls_first(), F.col(order).asc_nulls_first()]
    rows = (df.withColumns({_PUT: put.cast("long"), _DROP: drop.cast("long")})
            .repartitionByRange(n, *sort).withColumn(_PID, F.spark_partition_id()))
    if spark.conf.get("spark.sql.exchange.reuse", "true").lower() != "true":
        ensure_checkpoint_dir(spark)
        rows = rows.checkpoint(eager=True)
    kind = df.schema[key].dataType
    parts = rows.sortWithinPartitions(*sort).mapInPandas(_transitions(key), StructType(
        [StructField("k", kind), StructField("pid", LongType()), StructField("i", LongType()), StructField("ends", LongType())]))
    came = (parts.repartition(F.col("k")).sortWithinPartitions(F.col("k").asc_nulls_first(), "pid", F.col("i").asc_nulls_first())
            .mapInPandas(_incoming, StructType([StructField("k", kind), StructField("pid", LongType()), StructField(_IN, LongType())])))
    fed = rows.join(F.broadcast(came), F.col(key).eqNullSafe(F.col("k")) & (F.col(_PID) == F.col("pid")), "left")
    out = StructType([*rows.schema.fields, StructField("held_before", LongType()), StructField("held_after", LongType())])
    # sorted after the join: the optimizer may take away a sort below one
    done = fed.select(*rows.columns, _IN).sortWithinPartitions(*sort).mapInPandas(_replay(key), out)
    return done.select(*df.columns, "held_before", "held_after")
