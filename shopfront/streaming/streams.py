"""Structured Streaming versions of the shop's running processes.

Each stream has a batch twin over the same rows; the tests run the stream
with ``availableNow`` over Parquet files and compare it with the twin.
Event time is cast from the source's zone-less ``ts`` to TIMESTAMP because
watermarks need it.

T1 stock ledger       dedup within the watermark + running sums + stock left (update mode); ``ledger`` keeps the table
T2 live cart          applyInPandasWithState keyed by user and product bucket; idle rows leave the state
T3 code verification  applyInPandasWithState keyed by user (outcome of attempts); ``codes`` has the funnel with timers
T4 unpaid orders      stream-stream left outer interval join with watermarks, moved on by ticks
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.scan import key_scan
from .ledger import MergedTable, start

# A one-time code lives 10 minutes and the third wrong try locks it.
CODE_TTL_MS = 10 * 60 * 1000
MAX_WRONG = 3


def _k() -> Column:
    return F.regexp_extract("props", r"([0-9]+)", 1).cast("long")


def file_stream(spark: SparkSession, folder: str, table: str, max_files: int | None = None) -> DataFrame:
    """A file stream over ``folder``'s ``<table>*.parquet`` files (schema taken from them).

    A micro-batch takes all files that are there, or ``max_files`` of them.
    """
    schema = spark.read.option("pathGlobFilter", f"{table}*.parquet").parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*.parquet")
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    return stream.parquet(folder)


# ------------------------------------------------------------------ T1

def order_lines(events: DataFrame) -> DataFrame:
    """Purchase events as order lines: (line_id, product_id, quantity, ts)."""
    return events.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("line_id"), _k().alias("product_id"),
        (F.lit(1) + F.col("event_id") % 3).cast("int").alias("quantity"),
        F.col("ts").cast("timestamp").alias("ts"))


def stock_ledger_stream(lines: DataFrame, watermark: str = "1 hour", products: DataFrame | None = None) -> DataFrame:
    """Running units per product; a line seen twice within the watermark counts once.

    With ``products`` (a table, not a stream) each row also has the product's
    stock_quantity and stock_left.
    """
    sold = (lines.withWatermark("ts", watermark)
            .dropDuplicatesWithinWatermark(["line_id"])
            .groupBy("product_id")
            .agg(F.sum("quantity").cast("long").alias("units_sold"), F.count(F.lit(1)).alias("n_lines")))
    return with_stock_left(sold, products) if products is not None else sold


def stock_ledger_batch(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Batch twin of T1 with the stock left per product (stock - units sold)."""
    sold = (lines.dropDuplicates(["line_id"]).groupBy("product_id")
            .agg(F.sum("quantity").cast("long").alias("units_sold"), F.count(F.lit(1)).alias("n_lines")))
    return with_stock_left(sold, products)


def with_stock_left(sold: DataFrame, products: DataFrame) -> DataFrame:
    p = products.select(F.col("id").alias("product_id"), "stock_quantity")
    return (sold.join(p, "product_id", "left")
            .withColumn("stock_left", (F.col("stock_quantity") - F.col("units_sold")).cast("long")))


def ledger_table(path: str, compact_every: int = 10) -> MergedTable:
    """Where ``write_ledger`` keeps the totals per product."""
    return MergedTable(path, ("product_id",), compact_every)


def write_ledger(stream: DataFrame, path: str, checkpoint: str, trigger_once: bool = True, compact_every: int = 10):
    """Keep the ledger table at ``path`` up to date with each micro-batch's changed totals."""
    return start(stream, ledger_table(path, compact_every), checkpoint, "update", trigger_once)


def ledger_view(spark: SparkSession, path: str) -> DataFrame:
    """Latest running totals per product: one base and fewer batches than ``compact_every`` are read."""
    return ledger_table(path).read(spark)


# ------------------------------------------------------------------ T2

def cart_events(events: DataFrame) -> DataFrame:
    """Events as basket actions: view=add 1, click=set quantity, error=remove, signup=clear, purchase=order."""
    kind = (F.when(F.col("event_type") == "view", "add").when(F.col("event_type") == "click", "set")
            .when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "clear")
            .when(F.col("event_type") == "purchase", "order"))
    return events.select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"),
        F.when(kind.isin("add", "set", "remove"), _k()).alias("product_id"),
        F.when(kind == "add", F.lit(1)).when(kind == "set", F.lit(1) + F.floor("value") % 5)
         .cast("int").alias("quantity"))


def live_cart_batch(ev: DataFrame) -> DataFrame:
    """Batch twin of T2: each user's cart after all events, in closed form.

    Per (user, product): t0 = the later of the user's last clear/order and
    the pair's last remove; the row exists when some add follows t0; its
    quantity is the last set after the first such add plus the adds after
    that set, else the sum of adds after t0.  Only grouped aggregates and
    key joins: no per-user ordering pass.
    """
    order = F.struct("ts", "event_id")
    clears = ev.filter(F.col("kind").isin("clear", "order")).groupBy("user_id").agg(F.max(order).alias("_clr"))
    items = ev.filter(F.col("kind").isin("add", "set", "remove")).join(clears, "user_id", "left")
    items = items.filter(F.col("_clr").isNull() | (order > F.col("_clr")))
    rem = items.filter(F.col("kind") == "remove").groupBy("user_id", "product_id").agg(F.max(order).alias("_rm"))
    live = items.join(rem, ["user_id", "product_id"], "left").filter(F.col("_rm").isNull() | (order > F.col("_rm")))
    first_add = live.filter(F.col("kind") == "add").groupBy("user_id", "product_id").agg(F.min(order).alias("_a1"))
    live = live.join(first_add, ["user_id", "product_id"], "inner")
    last_set = (live.filter((F.col("kind") == "set") & (order > F.col("_a1")))
                .groupBy("user_id", "product_id")
                .agg(F.max(F.struct("ts", "event_id", "quantity")).alias("_s")))
    live = live.join(last_set, ["user_id", "product_id"], "left")
    after_set = F.col("_s").isNull() | (order > F.struct(F.col("_s.ts"), F.col("_s.event_id")))
    adds = F.sum(F.when((F.col("kind") == "add") & after_set, F.col("quantity")).otherwise(0))
    return (live.groupBy("user_id", "product_id")
            .agg(adds.alias("_adds"), F.first("_s", ignorenulls=True).alias("_s"))
            .select("user_id", "product_id",
                    (F.coalesce(F.col("_s.quantity"), F.lit(0)) + F.col("_adds")).cast("int").alias("quantity")))


CART_OUT = "user_id long, bucket int, product_id long, quantity int, version long"
CART_STATE = "products array<bigint>, quantities array<int>, touched array<bigint>, version long"
#: Parts of one user's cart; a user with a third of all events is spread over so many keys.
CART_BUCKETS = 16


def cart_parts(ev: DataFrame, buckets: int = CART_BUCKETS) -> DataFrame:
    """Cart events with the ``bucket`` of their product; a clear or order goes to all buckets of its user.

    Events on a product without a product id, or of no kind, are left out.
    """
    whole = F.col("kind").isin("clear", "order")
    own = F.array(F.pmod(F.xxhash64("product_id"), F.lit(buckets)).cast("int"))
    every = F.array(*[F.lit(i) for i in range(buckets)])
    return (ev.filter(whole | (F.col("kind").isin("add", "set", "remove") & F.col("product_id").isNotNull()))
            .withColumn("bucket", F.explode(F.when(whole, every).otherwise(own))))


def _cart_step(ttl_ms: int | None):
    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        user, bucket = key
        cart: dict[int, tuple[int, int]] = {}  # product -> quantity, last change in milliseconds
        version = -1
        if state.exists:
            products, quantities, touched, version = state.get
            cart = dict(zip(products, zip(quantities, touched)))
        before = {p: q for p, (q, _) in cart.items()}
        if state.hasTimedOut:
            version = max(version + 1, state.getCurrentWatermarkMs() * 1000)
        else:
            rows = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"])
            for ts, kind, pid, qty in zip(rows["ts"], rows["kind"], rows["product_id"], rows["quantity"]):
                now = int(pd.Timestamp(ts).value // 1_000_000)
                if ttl_ms is not None and kind in ("add", "set") and int(pid) in cart and now - cart[int(pid)][1] > ttl_ms:
                    del cart[int(pid)]
                if kind in ("clear", "order"):
                    cart.clear()
                elif kind == "add":
                    cart[int(pid)] = (cart.get(int(pid), (0, 0))[0] + int(qty), now)
                elif kind == "set" and int(pid) in cart:
                    cart[int(pid)] = (int(qty), now)
                elif kind == "remove":
                    cart.pop(int(pid), None)
            version = max(version + 1, int(pd.Timestamp(rows["ts"].max()).value // 1000))
        if ttl_ms is not None:
            seen = state.getCurrentWatermarkMs()
            cart = {p: (q, at) for p, (q, at) in cart.items() if at + ttl_ms >= seen}
        if cart:
            state.update((list(cart), [q for q, _ in cart.values()], [at for _, at in cart.values()], version))
            if ttl_ms is not None:
                state.setTimeoutTimestamp(min(at for _, at in cart.values()) + ttl_ms + 1)
        elif ttl_ms is not None:
            if state.exists:
                state.remove()
        else:
            state.update(([], [], [], version))
        if cart or before:
            out = [(user, bucket, p, q, version) for p, (q, _) in sorted(cart.items())] \
                or [(user, bucket, None, None, version)]
            yield pd.DataFrame(out, columns=["user_id", "bucket", "product_id", "quantity", "version"])
    return run


def live_cart_stream(ev: DataFrame, ttl: str | None = None, delay: str = "1 hour", buckets: int = CART_BUCKETS) -> DataFrame:
    """Per user and product bucket, that part of the cart after each micro-batch that changed it.

    State per key is the part of the cart (bounded by its products).  With
    ``ttl`` (like '30 days') a product that nobody has touched for longer is
    dropped by an event-time timer, its change is emitted, and a key without
    products leaves the state store; events older than the watermark (``delay``)
    are then dropped by Spark.  An empty part is one row with a null product;
    the latest ``version`` per key is current.
    """
    parts, timeout, ttl_ms = cart_parts(ev, buckets), GroupStateTimeout.NoTimeout, None
    if ttl is not None:
        parts, timeout = parts.withWatermark("ts", delay), GroupStateTimeout.EventTimeTimeout
        ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    return parts.groupBy("user_id", "bucket").applyInPandasWithState(
        _cart_step(ttl_ms), CART_OUT, CART_STATE, "append", timeout)


def latest_cart(emitted: DataFrame) -> DataFrame:
    """Current carts from the rows ``live_cart_stream`` emitted (latest version per user and bucket)."""
    # max per key as a partial aggregate joined back (no window gathering a user's rows)
    latest = emitted.groupBy(F.col("user_id").alias("_u"), F.col("bucket").alias("_b")).agg(F.max("version").alias("_v"))
    same = (F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("bucket") == F.col("_b")) & (F.col("version") == F.col("_v")))
    return (emitted.join(latest, same).filter(F.col("product_id").isNotNull())
            .select("user_id", "product_id", "quantity"))


# ------------------------------------------------------------------ T3

def code_events(events: DataFrame) -> DataFrame:
    """click = a code request, view = an attempt (correct when floor(value) % 4 = 0)."""
    return events.filter(F.col("event_type").isin("click", "view")).select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "click", "request").otherwise("attempt").alias("kind"),
        (F.floor("value") % 4 == 0).alias("correct"))


def verification_batch(ev: DataFrame) -> DataFrame:
    """Batch twin of T3: the outcome of every attempt.

    Sessions start at each request (running count of requests per user).
    In a session the first terminal attempt — late (> 10 min after the
    request), correct, or the third wrong one — decides 'expired',
    'verified' or 'locked' and removes the code; earlier attempts are
    'invalid'; later ones, and attempts before any request, are
    'no code'.
    """
    # one key_scan over (user; ts, event_id): the session number (requests so far)
    # and the wrong attempts so far; a session's count is the difference to its
    # request row.  One user with a third of all events is split over many tasks.
    is_req = F.col("kind") == "request"
    wrong = F.when((F.col("kind") == "attempt") & ~F.col("correct"), 1).otherwise(0)
    s = key_scan(ev, ["user_id"], ["ts", "event_id"],
                 sums={"session": F.when(is_req, 1).otherwise(0), "_wrong_run": wrong})
    req = s.filter(is_req).select("user_id", "session", F.col("ts").alias("issued"),
                                  F.col("_wrong_run").alias("_wrong_at_issue"))
    a = s.filter(F.col("kind") == "attempt").join(req, ["user_id", "session"], "left")
    age_ms = F.floor(F.unix_micros("ts") / 1000) - F.floor(F.unix_micros("issued") / 1000)
    late = age_ms > CODE_TTL_MS
    a = a.withColumn("_wrong_before", F.col("_wrong_run") - wrong - F.coalesce(F.col("_wrong_at_issue"), F.lit(0)))
    terminal = late | F.col("correct") | (F.col("_wrong_before") >= MAX_WRONG - 1)
    a = a.withColumn("_terminal", terminal)
    first_term = a.filter("_terminal").groupBy("user_id", "session").agg(
        F.min(F.struct("ts", "event_id")).alias("_t"))
    a = a.join(first_term, ["user_id", "session"], "left")
    me = F.struct("ts", "event_id")
    outcome = (F.when(F.col("issued").isNull(), "no code")
               .when(F.col("_t").isNotNull() & (me > F.col("_t")), "no code")
               .when(F.col("_t").isNotNull() & (me == F.col("_t")),
                     F.when(late, "expired").when(F.col("correct"), "verified").otherwise("locked"))
               .otherwise("invalid"))
    return a.select("event_id", "user_id", outcome.alias("outcome"))


CODE_OUT = "event_id long, user_id long, outcome string"
CODE_STATE = "has_code boolean, issued_ms long, wrong int"


def _code_step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    (user,) = key
    has_code, issued, wrong = (state.get if state.exists else (False, 0, 0))
    pdf = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"])
    out = []
    for eid, ts, kind, correct in zip(pdf["event_id"], pdf["ts"], pdf["kind"], pdf["correct"]):
        ms = int(pd.Timestamp(ts).value // 1_000_000)
        if kind == "request":
            has_code, issued, wrong = True, ms, 0
            continue
        if not has_code:
            out.append((eid, user, "no code"))
        elif ms - issued > CODE_TTL_MS:
            has_code = False
            out.append((eid, user, "expired"))
        elif correct:
            has_code = False
            out.append((eid, user, "verified"))
        else:
            wrong += 1
            if wrong >= MAX_WRONG:
                has_code = False
                out.append((eid, user, "locked"))
            else:
                out.append((eid, user, "invalid"))
    state.update((has_code, issued, wrong))
    yield pd.DataFrame(out, columns=["event_id", "user_id", "outcome"])


def verification_stream(ev: DataFrame) -> DataFrame:
    """Attempt outcomes as the events arrive; state is one small row per user."""
    return ev.groupBy("user_id").applyInPandasWithState(
        _code_step, CODE_OUT, CODE_STATE, "append", GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------------ T4

def order_starts(orders: DataFrame) -> DataFrame:
    """Online orders waiting for payment (the temporary ones) with their start time."""
    return orders.filter(F.col("is_temporary") == F.lit(True)).select(
        F.col("id").alias("order_id"), "user_id", F.col("created_at").cast("timestamp").alias("start_ts"))


def payment_results(lineitem: DataFrame) -> DataFrame:
    """Payment results: one per line, at its ship date."""
    return lineitem.select(F.col("l_orderkey").alias("result_order_id"),
                           F.col("l_shipdate").cast("timestamp").alias("result_ts"))


def _within(timeout: str) -> Column:
    return ((F.col("result_order_id") == F.col("order_id")) & (F.col("result_ts") >= F.col("start_ts"))
            & (F.col("result_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {timeout}")))


#: Keys of ticks on either side of a join: no id has them and they do not meet.  (A null key would be
#: filtered out below the watermark, and the tick with it.)
LEFT_TICK, RIGHT_TICK = -(2 ** 63), 2 ** 63 - 1


def with_ticks(stream: DataFrame, key: str, tick_key: int, time_col: str, ticks: DataFrame) -> DataFrame:
    """``stream`` and, for each row of ``ticks`` (tick_ts), a row that has nothing but its time and ``tick_key``.

    A join's watermark is that of its slowest side: a side that falls silent
    holds back the other side's results for good.  Ticks (from any clock that
    knows that everything up to then has been delivered) move it on.
    """
    given = {key: F.lit(tick_key), time_col: F.col("tick_ts")}
    return stream.unionByName(ticks.select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema.fields]))


def unpaid_stream(starts: DataFrame, results: DataFrame, timeout: str = "30 days",
                  delay: str = "1 day", ticks: DataFrame | None = None) -> DataFrame:
    """T4: orders with no payment result within ``timeout`` of their start.

    A left outer interval join; watermarks on both sides bound the state,
    and an unmatched order is emitted once the watermark passes its
    deadline.  Matched rows are dropped, so the output is the unpaid set.
    ``ticks`` (a stream with tick_ts) settle orders when no data comes.
    """
    if ticks is not None:
        starts = with_ticks(starts, "order_id", LEFT_TICK, "start_ts", ticks)
        results = with_ticks(results, "result_order_id", RIGHT_TICK, "result_ts", ticks)
    s = starts.withWatermark("start_ts", delay)
    r = results.withWatermark("result_ts", delay)
    # written over both sides, so that it stays above the join: below it, it would keep ticks from the watermark
    real = F.coalesce("result_order_id", "order_id") != LEFT_TICK
    return s.join(r, _within(timeout), "leftOuter").filter(F.col("result_order_id").isNull() & real) \
        .select("order_id", "user_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"))


def unpaid_batch(starts: DataFrame, results: DataFrame, timeout: str = "30 days") -> DataFrame:
    """Batch twin of T4 (an anti join on the order key with the interval condition)."""
    return starts.join(results, _within(timeout), "left_anti").select(
        "order_id", "user_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"))
