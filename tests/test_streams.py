"""Streams (availableNow over several Parquet files) equal their batch twins."""

import datetime as dt
import os
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from shopfront.sources.fixtures import Shop
from shopfront.streaming import codes, ledger
from shopfront.streaming import streams as T


def _split(spark, df, folder, table, part_col, n_parts):
    """Write ``df`` as ``n_parts`` files ``<table>_<i>.parquet`` in ``part_col`` order."""
    os.makedirs(folder, exist_ok=True)
    bounds = df.select(F.percentile_approx(part_col, [i / n_parts for i in range(1, n_parts)])).first()[0]
    edges = [None, *bounds, None]
    for i in range(n_parts):
        lo, hi = edges[i], edges[i + 1]
        part = df
        if lo is not None:
            part = part.filter(F.col(part_col) > lo)
        if hi is not None:
            part = part.filter(F.col(part_col) <= hi)
        part.toPandas().to_parquet(os.path.join(folder, f"{table}_{i:02d}.parquet"), index=False,
                                  coerce_timestamps="us", allow_truncated_timestamps=True)
        time.sleep(0.05)   # file streams take files in modification order


@pytest.fixture(scope="module")
def event_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("events"))
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    _split(spark, ev, d, "events", "event_id", 4)
    return d


def _run_to_memory(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_stock_ledger_stream_equals_batch(spark, event_dir, tmp_path):
    lines = T.order_lines(T.file_stream(spark, event_dir, "events", max_files=1))
    q = T.write_ledger(T.stock_ledger_stream(lines), str(tmp_path / "ledger"), str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    assert q.exception() is None
    got = rows(T.ledger_view(spark, str(tmp_path / "ledger")), ["product_id"])
    s = Shop(spark, SF_SMALL)
    want = rows(T.stock_ledger_batch(T.order_lines(s.raw.events), s.products)
                .select("product_id", "units_sold", "n_lines"), ["product_id"])
    assert got == want


def test_stock_ledger_ignores_replayed_lines(spark, event_dir, tmp_path):
    d = str(tmp_path / "dup")
    os.makedirs(d)
    for f in sorted(os.listdir(event_dir)):
        data = open(os.path.join(event_dir, f), "rb").read()
        open(os.path.join(d, f), "wb").write(data)
        time.sleep(0.05)
    # the last file arrives twice; its rows are within the watermark
    last = sorted(os.listdir(event_dir))[-1]
    open(os.path.join(d, "events_99.parquet"), "wb").write(open(os.path.join(event_dir, last), "rb").read())
    lines = T.order_lines(T.file_stream(spark, d, "events", max_files=1))
    q = T.write_ledger(T.stock_ledger_stream(lines, "7 days"), str(tmp_path / "l2"), str(tmp_path / "c2"))
    q.awaitTermination(300)
    got = rows(T.ledger_view(spark, str(tmp_path / "l2")), ["product_id"])
    s = Shop(spark, SF_SMALL)
    want = rows(T.stock_ledger_batch(T.order_lines(s.raw.events), s.products)
                .select("product_id", "units_sold", "n_lines"), ["product_id"])
    assert got == want


def _replay_carts(events):
    carts = {}
    for e in sorted(events, key=lambda r: (r["ts"], r["event_id"])):
        c = carts.setdefault(e["user_id"], {})
        if e["kind"] in ("clear", "order"):
            c.clear()
        elif e["kind"] == "add":
            c[e["product_id"]] = c.get(e["product_id"], 0) + e["quantity"]
        elif e["kind"] == "set" and e["product_id"] in c:
            c[e["product_id"]] = e["quantity"]
        elif e["kind"] == "remove":
            c.pop(e["product_id"], None)
    return sorted((u, p, q) for u, c in carts.items() for p, q in c.items())


def test_live_cart_stream_batch_and_replay_agree(spark, event_dir):
    emitted = _run_to_memory(T.live_cart_stream(T.cart_events(T.file_stream(spark, event_dir, "events", max_files=1))),
                             "t2_cart")
    stream = sorted((r["user_id"], r["product_id"], r["quantity"]) for r in rows(T.latest_cart(emitted)))
    ev = T.cart_events(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    batch = sorted((r["user_id"], r["product_id"], r["quantity"]) for r in rows(T.live_cart_batch(ev)))
    assert stream == batch == _replay_carts(rows(ev))
    assert len(batch) > 0


def _replay_codes(events):
    state, out = {}, {}
    for e in sorted(events, key=lambda r: (r["ts"], r["event_id"])):
        st = state.setdefault(e["user_id"], {"code": False, "issued": None, "wrong": 0})
        if e["kind"] == "request":
            st.update(code=True, issued=e["ts"], wrong=0)
            continue
        if not st["code"]:
            out[e["event_id"]] = "no code"
            continue
        age_ms = (e["ts"] - st["issued"]).total_seconds() * 1000
        if age_ms > T.CODE_TTL_MS:
            st["code"] = False
            out[e["event_id"]] = "expired"
        elif e["correct"]:
            st["code"] = False
            out[e["event_id"]] = "verified"
        else:
            st["wrong"] += 1
            if st["wrong"] >= T.MAX_WRONG:
                st["code"] = False
                out[e["event_id"]] = "locked"
            else:
                out[e["event_id"]] = "invalid"
    return out


def test_verification_stream_batch_and_replay_agree(spark, event_dir):
    got = _run_to_memory(T.verification_stream(T.code_events(T.file_stream(spark, event_dir, "events", max_files=1))),
                         "t3_codes")
    stream = {r["event_id"]: r["outcome"] for r in rows(got)}
    ev = T.code_events(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    batch = {r["event_id"]: r["outcome"] for r in rows(T.verification_batch(ev))}
    assert stream == batch == _replay_codes(rows(ev))
    assert set(batch.values()) >= {"no code", "expired"}


def test_code_expiry_boundary(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    ev = spark.createDataFrame([
        (1, 7, t0, "request", False), (2, 7, t0 + dt.timedelta(minutes=10), "attempt", True),
        (3, 8, t0, "request", False), (4, 8, t0 + dt.timedelta(minutes=10, milliseconds=1), "attempt", True),
        (5, 9, t0, "request", False), (6, 9, t0 + dt.timedelta(seconds=1), "attempt", False),
        (7, 9, t0 + dt.timedelta(seconds=2), "attempt", False), (8, 9, t0 + dt.timedelta(seconds=3), "attempt", True),
        (9, 9, t0 + dt.timedelta(seconds=4), "request", False), (10, 9, t0 + dt.timedelta(seconds=5), "attempt", False),
        (11, 9, t0 + dt.timedelta(seconds=6), "attempt", True)],
        "event_id long, user_id long, ts timestamp, kind string, correct boolean")
    got = {r["event_id"]: r["outcome"] for r in rows(T.verification_batch(ev))}
    assert got == {2: "verified", 4: "expired", 6: "invalid", 7: "invalid", 8: "verified",
                   10: "invalid", 11: "verified"}


def test_third_wrong_try_locks(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame(
        [(1, 7, t0, "request", False)] + [(i, 7, t0 + dt.timedelta(seconds=i), "attempt", i == 5)
                                         for i in range(2, 6)],
        "event_id long, user_id long, ts timestamp, kind string, correct boolean")
    got = {r["event_id"]: r["outcome"] for r in rows(T.verification_batch(ev))}
    assert got == {2: "invalid", 3: "invalid", 4: "locked", 5: "no code"}


T0 = dt.datetime(2024, 3, 1, 12, 0, 0)
CODE_EVENTS = "event_id long, user_id long, ts timestamp, kind string, correct boolean"
CART_EVENTS = "event_id long, user_id long, ts timestamp, kind string, product_id long, quantity int"


def _files(spark, folder, table, schema, *batches):
    """One file a batch, in this order."""
    os.makedirs(folder, exist_ok=True)
    for i, batch in enumerate(batches):
        pq.write_table(spark.createDataFrame(batch, schema).toArrow(), os.path.join(folder, f"{table}_{i:02d}.parquet"))
        time.sleep(0.05)


def _stream(spark, folder, table):
    """The files one by one, with ts as an event time."""
    source = T.file_stream(spark, folder, table, max_files=1)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(df, mode="append", name="drained"):
    """All rows of a stream over files, and the last progress that has state figures."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    with_state = [p for p in q.recentProgress if p["stateOperators"]]
    return df.sparkSession.table(name), with_state


# ---- T1: one base, few batches, stock left

def test_ledger_compacts_and_holds_stock_left(spark, tmp_path):
    s = Shop(spark, SF_SMALL)
    d, path = str(tmp_path / "ev"), str(tmp_path / "ledger")
    _split(spark, spark.read.parquet(f"{SF_SMALL}/events.parquet"), d, "events", "event_id", 7)
    lines = T.order_lines(T.file_stream(spark, d, "events", max_files=1))
    q = T.write_ledger(T.stock_ledger_stream(lines, products=s.products), path, str(tmp_path / "c"), compact_every=3)
    q.awaitTermination(300)
    assert q.exception() is None
    table = T.ledger_table(path, 3)
    assert len(table.pending(spark)) < 3 and len(os.listdir(f"{path}/base")) <= 2
    assert len([f for f in os.listdir(f"{path}/delta") if f.startswith("batch_id")]) <= 6
    want = T.stock_ledger_batch(T.order_lines(s.raw.events), s.products)
    cols = ["product_id", "units_sold", "n_lines", "stock_quantity", "stock_left"]
    assert rows(T.ledger_view(spark, path).select(cols), ["product_id"]) == rows(want.select(cols), ["product_id"])


def test_merged_table_survives_retries_and_broken_bases(spark, tmp_path):
    t = ledger.MergedTable(str(tmp_path / "t"), ("k",), compact_every=2)
    assert t.read(spark) is None

    def batch(*pairs):
        return spark.createDataFrame(list(pairs), "k string, v int")

    def now():
        return sorted(((r.k, r.v) for r in t.read(spark).collect()), key=repr)
    t.write(batch(("a", 1), (None, 5)), 0)
    t.write(batch(("a", 2), ("b", 1)), 1)          # compacts
    t.write(batch(("a", 2), ("b", 7)), 1)          # a retried batch that is in the base changes nothing
    assert t.pending(spark) == [] and now() == [("a", 2), ("b", 1), (None, 5)]
    t.write(batch(("b", None)), 2)
    t.write(batch(("c", 3)), 2)                    # a retried batch overwrites its first try
    os.makedirs(f"{tmp_path}/t/base/upto=9")       # a base that was never finished
    assert now() == [("a", 2), ("b", 1), ("c", 3), (None, 5)] and t.pending(spark) == [2]
    t.write(batch(("b", None), ("a", 9)), 3)
    assert now() == [("a", 9), ("b", None), ("c", 3), (None, 5)] and t.pending(spark) == []


# ---- T2: buckets and idle rows

def test_cart_of_a_hot_user_is_spread(spark):
    ev = spark.createDataFrame([(i, 1, T0, "add", i, 1) for i in range(400)] + [(900, 1, T0, "clear", None, None)],
                               CART_EVENTS)
    per = [r["count"] for r in T.cart_parts(ev).groupBy("user_id", "bucket").count().collect()]
    assert len(per) == T.CART_BUCKETS and max(per) < 60 and sum(per) == 400 + T.CART_BUCKETS


def test_idle_cart_rows_leave_the_state(spark, tmp_path):
    d = str(tmp_path / "cart")
    day = dt.timedelta(days=1)
    first = [(i, i % 5, T0 + dt.timedelta(minutes=i), "add", i % 7, 1) for i in range(70)]
    later = [(100, 1, T0 + 2 * day, "set", 1, 9), (101, 2, T0 + 2 * day, "add", 2, 4), (102, 3, T0 + 2 * day, "order", None, None),
             (103, 4, T0 + 2 * day, "remove", 4, None), (104, 4, T0 + 2 * day, "add", None, 1), (105, 4, T0 + 2 * day, None, 1, 1)]
    much_later = [(200, 77, T0 + 40 * day, "add", 1, 1)]
    end = [(201, 77, T0 + 41 * day, "add", 1, 1)]
    _files(spark, d, "cart", CART_EVENTS, first, later, much_later, end)
    source = _stream(spark, d, "cart")
    emitted, progress = _drain(T.live_cart_stream(source, ttl="10 days"), name="t2_ttl")
    assert sorted(map(tuple, T.latest_cart(emitted).collect())) == [(77, 1, 2)]
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(sizes) > 10 and sizes[-1] == 1
    kept, _ = _drain(T.live_cart_stream(source), name="t2_kept")
    want = _replay_carts([e | {"kind": e["kind"] if e["product_id"] is not None or e["kind"] in ("clear", "order") else None}
                          for e in rows(spark.read.parquet(d))])
    assert sorted(map(tuple, T.latest_cart(kept).collect())) == want


def test_a_product_comes_back_after_it_was_idle(spark, tmp_path):
    """With a time limit the stream equals a replay that forgets idle products, in and between batches."""
    d, hour = str(tmp_path / "cart"), dt.timedelta(hours=1)
    _files(spark, d, "cart", CART_EVENTS,
           [(1, 1, T0, "add", 5, 3), (2, 1, T0 + 5 * hour, "add", 5, 1), (3, 2, T0, "add", 5, 3)],
           [(4, 2, T0 + hour, "add", 5, 1), (5, 1, T0 + 5 * hour, "set", 5, 8), (6, 3, T0 + 5 * hour, "add", 1, 1)],
           [(7, 2, T0 + 9 * hour, "set", 5, 2), (8, 3, T0 + 9 * hour, "add", 1, 1), (9, 1, T0 + 6 * hour, "add", 5, 1)])
    emitted, _ = _drain(T.live_cart_stream(_stream(spark, d, "cart"), ttl="2 hours", delay="8 hours"),
                        name="t2_back")
    assert sorted(map(tuple, T.latest_cart(emitted).collect())) == [(1, 5, 9), (3, 1, 1)]


# ---- T3: funnel with timers

def _replay_status(events, until_ms):
    """user -> (request, status, at), by a clock that also rings without events."""
    now, out = {}, {}
    for e in sorted(events, key=lambda r: (r["ts"], r["event_id"])):
        ms = int(e["ts"].replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        u = e["user_id"]
        code = now.get(u)
        if code and ms - code["at"] > T.CODE_TTL_MS:
            out[u], code = (code["id"], "expired", code["at"] + T.CODE_TTL_MS), None
        if e["kind"] == "request":
            code = {"id": e["event_id"], "at": ms, "wrong": 0}
            out[u] = (e["event_id"], "open", ms)
        elif code and e["correct"]:
            out[u], code = (code["id"], "verified", ms), None
        elif code:
            code["wrong"] += 1
            if code["wrong"] == T.MAX_WRONG:
                out[u], code = (code["id"], "locked", ms), None
        now[u] = code
    for u, code in now.items():
        if code and until_ms - code["at"] > T.CODE_TTL_MS:
            out[u] = (code["id"], "expired", code["at"] + T.CODE_TTL_MS)
    return out


def _status(df):
    return {r.user_id: (r.request_id, r.status, r.at_ms) for r in df.collect()}


def _code_day():
    """Users 0-59, all kinds of endings; events of a user are some minutes apart."""
    import random
    rng, out, n = random.Random(3), [], 0
    for user in [*range(60), None]:
        t = T0 + dt.timedelta(seconds=rng.randint(0, 3000))
        for _ in range(rng.randint(1, 14)):
            n += 1
            out.append((n, user, t, rng.choice(["request", "attempt", "attempt"]), rng.choice([True, False, False, None])))
            t += dt.timedelta(seconds=rng.choice([0, 1, 200, 599, 600, 601, 900]), milliseconds=rng.choice([0, 0, 1]))
    return sorted(out, key=lambda r: (r[2], r[0]))


def test_code_funnel_stream_batch_and_replay_agree(spark, tmp_path):
    day = _code_day()
    end = [(10_000, 999, T0 + dt.timedelta(days=1), "request", None)]
    stop = [(10_001, 999, T0 + dt.timedelta(days=1, minutes=1), "attempt", False)]
    k = len(day) // 3
    _files(spark, str(tmp_path / "c"), "codes", CODE_EVENTS, day[:k], day[k:2 * k], day[2 * k:], end, stop)
    events = spark.createDataFrame(day + end + stop, CODE_EVENTS)
    until = int((T0 + dt.timedelta(days=1)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    want = _replay_status(rows(events), until)
    changes, progress = _drain(codes.code_status_stream(_stream(spark, str(tmp_path / "c"), "codes")),
                               name="t3_funnel")
    assert _status(codes.current_status(changes)) == want == _status(codes.code_status_batch(events, until))
    ends = {s for _, s, _ in want.values()}
    assert ends == set(codes.STATUSES)
    funnel = {r.status: r.n_users for r in codes.funnel(codes.current_status(changes)).collect()}
    assert funnel == {s: sum(x[1] == s for x in want.values()) for s in ends}
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(sizes) > 5 and sizes[-1] == 1       # only the open code of user 999


def test_a_code_expires_without_another_attempt(spark, tmp_path):
    minute = dt.timedelta(minutes=1)
    _files(spark, str(tmp_path / "c"), "codes", CODE_EVENTS, [(1, 7, T0, "request", None)],
           [(2, 8, T0 + 30 * minute, "request", None)], [(3, 8, T0 + 31 * minute, "attempt", True)])
    changes, _ = _drain(codes.code_status_stream(_stream(spark, str(tmp_path / "c"), "codes")), name="t3_exp")
    t = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert sorted((r.user_id, r.status, r.at_ms - t) for r in changes.collect()) == [
        (7, "expired", T.CODE_TTL_MS), (7, "open", 0), (8, "open", 1_800_000), (8, "verified", 1_860_000)]


def test_code_status_batch_on_data_and_empty(spark):
    ev = T.code_events(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    until = max(int(r["ts"].replace(tzinfo=dt.timezone.utc).timestamp() * 1000) for r in rows(ev))
    assert _status(codes.code_status_batch(ev)) == _replay_status(rows(ev), until)
    assert codes.code_status_batch(ev.filter("event_id < 0")).count() == 0


# ---- T4: settled orders

def _t4(spark, folder, ticks):
    s = Shop(spark, SF_SMALL)
    _split(spark, s.orders.select("id", "user_id", "created_at", "is_temporary"), folder, "orders", "created_at", 4)
    _split(spark, s.raw.lineitem.select("l_orderkey", "l_shipdate"), folder, "lineitem", "l_shipdate", 4)
    _files(spark, folder, "ticks", "tick_ts timestamp", *[[(t,)] for t in ticks])
    st = T.order_starts(T.file_stream(spark, folder, "orders", max_files=1))
    rs = T.payment_results(T.file_stream(spark, folder, "lineitem", max_files=1))
    out, progress = _drain(T.unpaid_stream(st, rs, "30 days", "1 day", T.file_stream(spark, folder, "ticks", max_files=1)),
                           name="t4_" + os.path.basename(folder))
    batch = T.unpaid_batch(T.order_starts(s.orders), T.payment_results(s.raw.lineitem), "30 days")
    return ({r["order_id"]: r for r in rows(out)}, {r["order_id"]: r for r in rows(batch)}, progress)


def test_unpaid_stream_equals_batch_when_ticks_settle_everything(spark, tmp_path):
    far = dt.datetime(2100, 1, 1)
    # four ticks before the data ends hold nothing back; the last two settle all orders and flush
    ticks = [dt.datetime(1990, 1, 1)] * 4 + [far, far + dt.timedelta(days=40), far + dt.timedelta(days=80)]
    got, batch, progress = _t4(spark, str(tmp_path / "all"), ticks)
    assert got == batch and len(batch) > 0
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(sizes) > 100 and sizes[-1] <= 2 * len(ticks)  # ticks at most


def test_unpaid_stream_equals_the_settled_part(spark, tmp_path):
    """A tick in the middle of the time range settles what was due by then, and nothing later."""
    s = Shop(spark, SF_SMALL)
    mid = T.order_starts(s.orders).select(F.percentile_approx(F.unix_seconds("start_ts"), 0.5)).first()[0]
    tick = dt.datetime.fromtimestamp(mid, dt.timezone.utc).replace(tzinfo=None) + dt.timedelta(days=31)
    d = str(tmp_path / "part")
    s.orders.filter("is_temporary").select("id", "user_id", "created_at", "is_temporary").toPandas().to_parquet(
        _made(d, "orders_0.parquet"), index=False, coerce_timestamps="us")
    s.raw.lineitem.select("l_orderkey", "l_shipdate").toPandas().to_parquet(
        _made(d, "lineitem_0.parquet"), index=False, coerce_timestamps="us")
    _files(spark, d, "ticks", "tick_ts timestamp", [(tick,)], [(tick,)], [(tick,)])
    st = T.order_starts(T.file_stream(spark, d, "orders"))
    rs = T.payment_results(T.file_stream(spark, d, "lineitem"))
    # results are ahead of their time; the slowest side, the orders up to the tick, sets the watermark
    starts = st.filter(F.col("start_ts") <= F.lit(tick))
    out, _ = _drain(T.unpaid_stream(starts, rs, "30 days", "0 seconds", T.file_stream(spark, d, "ticks", max_files=1)), name="t4_part")
    batch = rows(T.unpaid_batch(T.order_starts(s.orders), T.payment_results(s.raw.lineitem), "30 days"))
    settled = {r["order_id"] for r in batch if r["start_ts"] + dt.timedelta(days=30) < tick}
    assert {r["order_id"] for r in rows(out)} == settled and 0 < len(settled) < len(batch)


def _made(folder, name):
    os.makedirs(folder, exist_ok=True)
    return os.path.join(folder, name)
