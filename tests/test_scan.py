"""key_scan against the window it replaces, on a table where one key holds
most rows and therefore spans many range partitions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

import pyarrow as pa

from conftest import rows
from shopfront.functions.scan import _f, _loc, _local_pass, key_scan


def _skewed(spark, n=6000):
    # key 7 holds ~2/3 of all rows; nulls in key and in the lagged column
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 != 0, F.lit(7)).when(F.col("id") % 11 == 0, F.lit(None))
         .otherwise(F.col("id") % 50).cast("int").alias("k"),
        ((F.col("id") * 7919) % 1000).alias("t"),
        F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit("v"), (F.col("id") % 5).cast("string")))
         .alias("v"),
        (F.col("id") % 4 == 0).alias("flag"))


def test_running_count_and_lag_match_window(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        df = _skewed(spark)
        got = key_scan(df, ["k"], ["t", "id"], count_if=F.col("flag"), lag_of="v",
                       count_name="c", lag_name="p")
        w = Window.partitionBy("k").orderBy("t", "id")
        want = df.select("*", F.sum(F.when(F.col("flag"), 1).otherwise(0)).over(w).alias("c"),
                         F.lag("v").over(w).alias("p"))
        assert rows(got, ["id"]) == rows(want, ["id"])
        # the hot key really was split across partitions
        parts = (df.repartitionByRange(16, F.col("k").asc_nulls_first(), "t", "id")
                 .filter(F.col("k") == 7).select(F.spark_partition_id().alias("p")).distinct().count())
        assert parts > 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_row_number_with_two_keys(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        df = _skewed(spark, 3000).withColumn("k2", (F.col("id") % 2).cast("int"))
        got = key_scan(df, ["k", "k2"], ["t", "id"], count_name="rn")
        w = Window.partitionBy("k", "k2").orderBy("t", "id")
        want = df.withColumn("rn", F.row_number().over(w).cast("long"))
        assert rows(got, ["id"]) == rows(want, ["id"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_running_sum_matches_window(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        df = _skewed(spark, 4000).withColumn("amt", F.when(F.col("id") % 17 == 0, F.lit(None))
                                             .otherwise(F.col("t") - 300))
        got = key_scan(df, ["k"], ["t", "id"], sum_of=F.col("amt"), count_name="s")
        w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
        want = df.withColumn("s", F.coalesce(F.sum(F.coalesce("amt", F.lit(0))).over(w), F.lit(0)))
        assert rows(got, ["id"]) == rows(want, ["id"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def _replay_brand(orig, ops, as_of):
    """Plain sequential replay of the brand-review rules (the brute-force check)."""
    state = {u: dict(present=True, id=i, rating=r, comment=c, created=t) for u, (i, r, c, t) in orig.items()}
    errors = {}
    for seq, op, u, i, r, c in sorted(ops):
        s = state.get(u, dict(present=False))
        err = None
        if op == "add":
            if s["present"]:
                err = "You have already submitted a brand review"
            else:
                s = dict(present=True, id=max(x[0] for x in orig.values()) + 1 + seq, rating=r, comment=c, created=as_of)
        elif op == "update":
            if s["present"]:
                s = dict(s, rating=r, comment=c)
            else:
                err = "Review not found"
        elif s["present"] and s["id"] == i:
            s = dict(present=False)
        else:
            err = "Review not found or you do not have permission to delete it"
        state[u] = s
        errors[seq] = err
    final = sorted((s["id"], u, s["rating"], s["comment"], s["created"]) for u, s in state.items() if s["present"])
    return errors, final


def test_brand_review_chain_matches_replay(spark):
    import datetime
    import random

    from shopfront.operators import changes as C
    rnd = random.Random(7)
    t0 = datetime.datetime(2024, 1, 1)
    as_of = datetime.datetime(2024, 2, 1)
    orig = {1: (501, 4, "o1", t0), 3: (503, 2, "o3", t0)}
    ops, seq = [], 0
    for u, n in ((1, 400), (2, 30), (3, 12), (4, 1)):   # user 1 is hot: a long add/delete chain
        for _ in range(n):
            seq += rnd.randint(1, 3)
            op = rnd.choice(["add", "add", "delete", "delete", "update"])
            rid = rnd.choice([501, 503, *(504 + seq - d for d in range(1, 7))]) if op == "delete" else seq
            ops.append((seq, op, u, rid, rnd.randint(1, 5), f"c{seq}"))
    # delete ids that hit recent adds make long chains
    br = spark.createDataFrame([(i, u, r, c, t) for u, (i, r, c, t) in orig.items()],
                               "id long, user_id long, rating int, comment string, created_at timestamp_ntz")
    df = spark.createDataFrame(ops, "seq long, op string, user_id long, id long, rating int, comment string")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        ch = C.brand_review_changes(br, df, as_of)
        got_err = {r["seq"]: r["error"] for r in ch.outcome.collect()}
        got_final = sorted((r["id"], r["user_id"], r["rating"], r["comment"], r["created_at"])
                           for r in ch.tables["brand_reviews"].collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want_err, want_final = _replay_brand(orig, ops, as_of)
    assert got_err == want_err
    assert got_final == want_final
    assert sum(e is None for e in want_err.values()) > 50   # the hot user really alternates


def test_brand_review_plan_is_lazy(spark):
    """Building the job runs nothing; an id that another review has is not taken over."""
    from shopfront.operators import changes as C
    br = spark.createDataFrame([(1, 7, 4, "x", None), (3, 9, 5, "y", None)],
                               "id long, user_id long, rating int, comment string, created_at timestamp_ntz")
    ops = spark.createDataFrame([(0, "add", 8, 3, 5, "z"), (1, "delete", 8, 3, None, None), (2, "delete", 7, 1, None, None),
                                 (3, "add", 7, 1, 2, "again"), (4, "delete", 7, 7, None, None), (5, "add", None, 1, 3, "n")],
                                "seq long, op string, user_id long, id long, rating int, comment string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("brand-build", "building")
    try:
        ch = C.brand_review_changes(br, ops, "2024-02-01")
        assert not tracker.getJobIdsForGroup("brand-build")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    no = "Review not found or you do not have permission to delete it"
    assert [r["error"] for r in rows(ch.outcome, ["seq"])] == [None, no, None, None, None, None]
    assert sorted((r["id"], r["comment"]) for r in rows(ch.tables["brand_reviews"])) == [(3, "y"), (4, "z"), (9, "n")]


def test_slot_transitions_compose():
    import random

    from shopfront.functions.slots import _after, transition
    rnd = random.Random(5)
    for _ in range(300):
        puts, drops, n = [], [], rnd.randint(1, 25)
        for i in range(n):
            kind = rnd.random()
            puts.append(100 + i if kind < 0.45 else None)
            drops.append(rnd.choice([1, 2, *range(100, 100 + n)]) if kind > 0.5 else None)
        for held in (None, 1, 2, 3):
            now = held
            for p, d in zip(puts, drops):
                now = _after(now, p, d)
            ends, dropped = transition(puts, drops)
            assert now == (ends if held is None else dropped.get(held, held))


def test_partition_count_knob(spark):
    df = _skewed(spark, 2000)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = rows(df.withColumn("rn", F.row_number().over(w).cast("long")), ["id"])
    assert rows(key_scan(df, ["k"], ["t", "id"], count_name="rn", partitions=5), ["id"]) == want
    spark.conf.set("shopfront.scan.partitions", "11")
    try:
        assert rows(key_scan(df, ["k"], ["t", "id"], count_name="rn"), ["id"]) == want
    finally:
        spark.conf.unset("shopfront.scan.partitions")


def test_address_book_hot_user_matches_window(spark):
    from shopfront.operators import people
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        a = spark.range(3000).select(
            F.col("id"),
            F.when(F.col("id") % 3 != 0, F.lit(1)).otherwise(F.col("id") % 40).cast("long").alias("user_id"),
            F.concat(F.lit("line "), F.col("id").cast("string")).alias("address_line1"),
            F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 5 == 0).alias("is_default"),
            F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(
                F.timestamp_seconds(F.lit(1700000000) + (F.col("id") * 37) % 500)).cast("timestamp_ntz")
             .alias("created_at"))
        got = people.address_book(a)
        w = Window.partitionBy("user_id").orderBy(F.col("is_default").desc_nulls_first(),
                                                  F.col("created_at").desc_nulls_first(), F.col("id"))
        want = a.withColumn("position", F.row_number().over(w))
        assert got.columns == want.columns
        assert rows(got, ["id"]) == rows(want, ["id"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def _verification_by_window(ev):
    """The per-user window formulation of T3's batch twin (one task per user)."""
    from shopfront.streaming.streams import CODE_TTL_MS, MAX_WRONG
    w_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = ev.withColumn("session", F.sum(F.when(F.col("kind") == "request", 1).otherwise(0)).over(w_user))
    req = s.filter(F.col("kind") == "request").select("user_id", "session", F.col("ts").alias("issued"))
    a = s.filter(F.col("kind") == "attempt").join(req, ["user_id", "session"], "left")
    w_sess = Window.partitionBy("user_id", "session").orderBy("ts", "event_id")
    late = (F.floor(F.unix_micros("ts") / 1000) - F.floor(F.unix_micros("issued") / 1000)) > CODE_TTL_MS
    a = a.withColumn("_wb", F.coalesce(F.sum(F.when(~F.col("correct"), 1).otherwise(0)).over(
        w_sess.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    a = a.withColumn("_term", late | F.col("correct") | (F.col("_wb") >= MAX_WRONG - 1))
    ft = a.filter("_term").groupBy("user_id", "session").agg(F.min(F.struct("ts", "event_id")).alias("_t"))
    a = a.join(ft, ["user_id", "session"], "left")
    me = F.struct("ts", "event_id")
    out = (F.when(F.col("issued").isNull(), "no code")
           .when(F.col("_t").isNotNull() & (me > F.col("_t")), "no code")
           .when(F.col("_t").isNotNull() & (me == F.col("_t")),
                 F.when(late, "expired").when(F.col("correct"), "verified").otherwise("locked"))
           .otherwise("invalid"))
    return a.select("event_id", "user_id", out.alias("outcome"))


def test_verification_hot_user_matches_window(spark):
    from shopfront.streaming.streams import verification_batch
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        ev = spark.range(4000).select(
            F.col("id").alias("event_id"),
            F.when(F.col("id") % 4 != 0, F.lit(1)).otherwise(F.col("id") % 30).cast("long").alias("user_id"),
            F.timestamp_seconds(F.lit(1700000000) + F.col("id") * 97 + (F.col("id") % 13) * 60).alias("ts"),
            F.when(F.col("id") % 6 == 0, "request").otherwise("attempt").alias("kind"),
            F.when(F.col("id") % 17 == 0, F.lit(None)).otherwise(F.col("id") % 5 == 0).alias("correct"))
        got = rows(verification_batch(ev), ["event_id"])
        assert got == rows(_verification_by_window(ev), ["event_id"])
        assert {"verified", "locked", "invalid", "no code"} <= {r["outcome"] for r in got}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_wishlist_hot_pair_matches_replay(spark):
    import datetime
    import random

    from shopfront.operators import changes as C
    rnd = random.Random(11)
    t0 = datetime.datetime(2024, 1, 1)
    snap = [(1, 1, 10, t0), (2, 2, 20, t0)]
    ops = []
    for seq in range(1, 2500):
        pair = (1, 10) if seq % 4 else (rnd.randint(1, 5), rnd.choice([10, 20, 30]))   # (1, 10) is hot
        ops.append((seq, rnd.choice(["add", "remove"]), *pair))
    present = {(u, p) for _, u, p, _ in snap}
    want = {}
    for seq, op, u, p in ops:
        if op == "add":
            want[seq] = "Item already in wishlist" if (u, p) in present else None
            present.add((u, p))
        else:
            want[seq] = None if (u, p) in present else "Item not found in wishlist"
            present.discard((u, p))
    w = spark.createDataFrame(snap, "id long, user_id long, product_id long, created_at timestamp_ntz")
    o = spark.createDataFrame(ops, "seq long, op string, user_id long, product_id long")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        ch = C.merge_wishlist(w, o, "2024-02-01")
        got = {r["seq"]: r["error"] for r in ch.outcome.collect()}
        final = {(r["user_id"], r["product_id"]) for r in ch.tables["wishlist"].collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == want
    assert final == present


def test_range_exchange_is_reused(spark):
    # both branches must read one range shuffle (one sampling, one set of bounds)
    df = _skewed(spark, 3000)
    got = key_scan(df, ["k"], ["t", "id"], count_if=F.col("flag"), lag_of="v")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    assert "ReusedExchange" in plan


def test_carried_columns_stay_as_they_are(spark):
    """NaN, nulls, far dates and nested values in carried, lagged and key columns."""
    import datetime as dt
    far = dt.datetime(9999, 12, 31, 23, 59, 59)
    data = [(i, float("nan") if i % 3 == 0 else None if i % 3 == 1 else float(i % 2), far if i % 2 else None, [i, None])
            for i in range(400)]
    df = spark.createDataFrame(data, "id long, x double, end timestamp_ntz, xs array<int>")
    show = lambda d: sorted(map(str, d.collect()))
    w = Window.partitionBy("x").orderBy("id")
    for lagged in ("end", "x", "xs"):
        got = key_scan(df, ["x"], ["id"], lag_of=lagged, count_name="c", lag_name="p", partitions=7)
        want = df.select("*", F.count(F.lit(1)).over(w).alias("c"), F.lag(lagged).over(w).alias("p"))
        assert show(got) == show(want)
    empty = key_scan(df.filter("id < 0"), ["x"], ["id"], lag_of="end", count_name="c", lag_name="p")
    assert empty.count() == 0


def test_batch_of_one_row_that_continues_a_key():
    batch = lambda ks, ns: pa.RecordBatch.from_pydict({"k": pa.array(ks, "int64"), _f(0): pa.array(ns, "int64")})
    parts = [([1, 1, 2], [1, 2, 4]), ([2], [5]), ([2], [6]), ([3], [7]), ([3, 3], [8, 9])]
    out = pa.Table.from_batches(_local_pass(["k"], 1, None)(iter([batch(*p) for p in parts])))
    assert out[_loc(0)].to_pylist() == [1, 3, 4, 9, 15, 7, 15, 24]
