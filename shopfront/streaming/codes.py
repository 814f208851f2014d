"""T3 as a funnel: where each user's newest one-time code stands, with timers.

A request opens a code and replaces an older one; a correct attempt within the
time limit verifies it, the third wrong one locks it, and it expires when its
time is over, whether or not anybody tries again.  Expiry without an attempt is
an event-time timer: it fires once the watermark has passed the deadline.

State is one small row a user while a code is open and nothing once the code is
verified, locked or expired, so the state store holds open codes alone.

Events at the same instant count in event_id order; an attempt exactly at the
deadline is in time.  Attempts without an open code change nothing.  Events
older than the watermark are dropped by Spark; a user that is null is a user of
its own; a null ``correct`` is a wrong attempt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import last_by
from .streams import CODE_TTL_MS, MAX_WRONG

STATUSES = ("open", "verified", "locked", "expired")
STATUS_OUT = "user_id long, request_id long, issued_ms long, status string, at_ms long"
STATUS_STATE = "request_id long, issued_ms long, wrong int"


def _status_step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (user,) = key
    out: list[tuple] = []
    code = state.get if state.exists else None

    def end(status: str, at: int) -> None:
        nonlocal code
        out.append((user, code[0], code[1], status, at))
        code = None

    if state.hasTimedOut:
        end("expired", code[1] + CODE_TTL_MS)
    else:
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"])
        for event, ts, kind, correct in zip(rows["event_id"], rows["ts"], rows["kind"], rows["correct"]):
            now = int(pd.Timestamp(ts).value // 1_000_000)
            if code is not None and now - code[1] > CODE_TTL_MS:
                end("expired", code[1] + CODE_TTL_MS)
            if kind == "request":
                code = (int(event), now, 0)
                out.append((user, int(event), now, "open", now))
            elif code is not None and correct is not None and bool(correct):
                end("verified", now)
            elif code is not None:
                code = (code[0], code[1], code[2] + 1)
                if code[2] >= MAX_WRONG:
                    end("locked", now)
        if code is not None and code[1] + CODE_TTL_MS < state.getCurrentWatermarkMs():
            end("expired", code[1] + CODE_TTL_MS)
    if code is None:
        if state.exists:
            state.remove()
    else:
        state.update(code)
        state.setTimeoutTimestamp(code[1] + CODE_TTL_MS + 1)
    yield pd.DataFrame(out, columns=["user_id", "request_id", "issued_ms", "status", "at_ms"])


def code_status_stream(ev: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Every change of a code's status as it happens (``code_events`` rows in, append mode).

    ``at_ms``: the request, the deciding attempt, or the deadline of an expired code.
    """
    return ev.withWatermark("ts", delay).groupBy("user_id").applyInPandasWithState(
        _status_step, STATUS_OUT, STATUS_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def current_status(changes: DataFrame) -> DataFrame:
    """Per user the newest code and its status, from the rows that the stream emitted."""
    order = [F.col("issued_ms"), F.col("request_id"), F.when(F.col("status") == "open", 0).otherwise(1)]
    return last_by(changes, ["user_id"], order, ["request_id", "status", "at_ms"])


def funnel(current: DataFrame) -> DataFrame:
    """Users by status of their newest code."""
    return current.groupBy("status").agg(F.count("*").alias("n_users"))


def code_status_batch(ev: DataFrame, until_ms: int | None = None) -> DataFrame:
    """Batch twin: per user the newest request's status when the clock shows ``until_ms`` (default: the last event).

    Only grouped aggregates and key joins: the newest request of a user, then
    the attempts after it.  The first correct attempt in time and the third
    wrong one are partial aggregates, so one user with a third of all events
    is combined before the shuffle.
    """
    ms = F.floor(F.unix_micros("ts") / 1000)
    until = F.lit(until_ms).cast("long") if until_ms is not None else ev.select(F.max(ms)).scalar()
    order = [F.col("ts"), F.col("event_id")]
    newest = last_by(ev.filter("kind = 'request'"), ["user_id"], order, ["event_id", "ts"]).select(
        F.col("user_id").alias("_user"), F.col("event_id").alias("request_id"), F.col("ts").alias("issued"))
    after = ev.filter("kind = 'attempt'").join(newest, F.col("user_id").eqNullSafe(F.col("_user"))).filter(
        F.struct("ts", "event_id") > F.struct("issued", "request_id"))
    in_time = after.withColumn("_ms", ms).filter(
        F.col("_ms") - F.floor(F.unix_micros("issued") / 1000) <= CODE_TTL_MS)
    at = F.struct("ts", "event_id", "_ms")
    right = in_time.filter("correct").groupBy("_user").agg(F.min(at).alias("_right"))
    # wrong attempts before the first right one: only the MAX_WRONG smallest of a user are of interest
    wrong = in_time.filter(~F.coalesce(F.col("correct"), F.lit(False)))
    lock = nth_smallest(wrong, "_user", at, MAX_WRONG).withColumnRenamed("_nth", "_lock")
    rows = (newest.join(right.withColumnRenamed("_user", "_ru"), F.col("_user").eqNullSafe(F.col("_ru")), "left")
            .join(lock.withColumnRenamed("_user", "_lu"), F.col("_user").eqNullSafe(F.col("_lu")), "left"))
    locked = F.col("_lock").isNotNull() & (F.col("_right").isNull() | (F.col("_lock") < F.col("_right")))
    issued_ms = F.floor(F.unix_micros("issued") / 1000)
    over = until - issued_ms > CODE_TTL_MS
    status = (F.when(locked, "locked").when(F.col("_right").isNotNull(), "verified").when(over, "expired")
              .otherwise("open"))
    when = (F.when(locked, F.col("_lock._ms")).when(F.col("_right").isNotNull(), F.col("_right._ms"))
            .when(over, issued_ms + CODE_TTL_MS).otherwise(issued_ms))
    return rows.select(F.col("_user").alias("user_id"), "request_id", status.alias("status"),
                       when.cast("long").alias("at_ms"))


def nth_smallest(rows: DataFrame, key: str, value, n: int) -> DataFrame:
    """(key, _nth): the n-th smallest ``value`` (a unique struct) per key that has that many.

    Peels minima off: round i aggregates what is above the (i-1)-th minimum, each a partial aggregate.
    """
    left = rows.withColumn("_v", value).select(key, "_v")
    low = left.groupBy(key).agg(F.min("_v").alias("_nth"))
    for _ in range(n - 1):
        least = low.select(F.col(key).alias("_key"), "_nth")
        left = (left.join(least, F.col(key).eqNullSafe(F.col("_key"))).filter(F.col("_v") > F.col("_nth"))
                .select(key, "_v"))
        low = left.groupBy(key).agg(F.min("_v").alias("_nth"))
    return low
