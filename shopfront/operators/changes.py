"""Table-change jobs C1-C16: snapshot + change rows -> new snapshot + outcome.

Every job is a set of joins and grouped aggregates over the whole batch, so
all users' changes apply in one pass.  Change rows carry a unique ``seq``
(arrival order); where the reference's effect depends on order, the
last (or first) row per key is taken with a max/min over a struct, a
partial aggregate that a hot key cannot overload.  New rows get
``id = max(existing id) + 1 + seq`` so ids stay unique without a global
numbering pass.  The caller writes the returned snapshots (``sources.io``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_by, last_by
from ..functions.components import component_roots
from ..functions.scan import key_scan
from ..functions.slots import slot_scan
from ..sources.io import cut
from ..sources.model import LINKS, ORDER_STATUSES, PAYMENT_METHODS

NTZ = "timestamp_ntz"


@dataclass
class Change:
    """Result of a change job: new table snapshots and one outcome row per change."""
    tables: dict[str, DataFrame] = field(default_factory=dict)
    outcome: DataFrame | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.outcome if name == "outcome" else self.tables[name]


def _ts(as_of) -> Column:
    return F.lit(as_of).cast(NTZ)


def _next_id(existing: DataFrame, seq: Column) -> Column:
    """A fresh id per change row: one more than the table's max id, plus the row's seq (from 0)."""
    base = existing.select(F.coalesce(F.max("id") + 1, F.lit(0)).cast("long")).scalar()
    return F.when(seq < 0, F.raise_error(F.lit("seq must not be negative"))).otherwise(base + seq).cast("long")


def _align(df: DataFrame, like: DataFrame) -> DataFrame:
    """Select ``like``'s columns (missing ones as typed nulls) in its order."""
    cols = []
    for f in like.schema.fields:
        cols.append(F.col(f.name).cast(f.dataType) if f.name in df.columns
                    else F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*[c.alias(f.name) for c, f in zip(cols, like.schema.fields)])


# ---------------------------------------------------------------- baskets

def merge_cart(cart: DataFrame, adds: DataFrame, as_of) -> Change:
    """Add (user, product, quantity): existing rows grow, new keys insert.

    Many adds of one key in a batch sum up; the new row takes the id of its
    first add and ``selected = false``.  Every existing row of the key grows
    (the table has no unique key on (user, product)).
    """
    per_key = adds.groupBy("user_id", "product_id").agg(
        F.sum("quantity").alias("_add"), F.min("seq").alias("_first_seq"))
    updated = (cart.join(per_key, ["user_id", "product_id"], "left")
               .withColumn("quantity", (F.col("quantity") + F.coalesce("_add", F.lit(0))).cast("int"))
               .drop("_add", "_first_seq"))
    fresh = (per_key.join(cart.select("user_id", "product_id").distinct(), ["user_id", "product_id"], "left_anti")
             .select(_next_id(cart, F.col("_first_seq")).alias("id"), "user_id", "product_id",
                     F.col("_add").cast("int").alias("quantity"), F.lit(False).alias("selected"),
                     _ts(as_of).alias("created_at")))
    new_cart = _align(updated, cart).unionByName(_align(fresh, cart))
    existed = cart.select("user_id", "product_id").distinct().withColumn("_had", F.lit(True))
    outcome = (adds.join(existed, ["user_id", "product_id"], "left")
               .join(per_key.select("user_id", "product_id", "_first_seq"), ["user_id", "product_id"])
               .select("seq", "user_id", "product_id",
                       F.when(F.col("_had") | (F.col("seq") != F.col("_first_seq")), "updated")
                        .otherwise("inserted").alias("action")))
    return Change({"cart": new_cart}, outcome)


def edit_cart(cart: DataFrame, edits: DataFrame) -> Change:
    """Set quantity / set selected / remove by (id, user), clear by user.

    ``edits``: seq, op ('set_quantity' | 'set_selected' | 'remove' | 'clear'),
    id, user_id, quantity, selected.  A row is gone from the first remove or
    clear that hits it; edits after that, and edits of rows that are not
    the caller's, answer 'Cart item not found'.  The last surviving edit of
    each field wins.
    """
    rows = cart.select(F.col("id").alias("_rid"), F.col("user_id").alias("_ruid"))
    removes = edits.filter(F.col("op") == "remove").groupBy(F.col("id").alias("_did"), F.col("user_id").alias("_duid")) \
        .agg(F.min("seq").alias("_rm_seq"))
    clears = edits.filter(F.col("op") == "clear").groupBy(F.col("user_id").alias("_cuid")) \
        .agg(F.min("seq").alias("_clr_seq"))
    gone = (rows.join(removes, (F.col("_rid") == F.col("_did")) & (F.col("_ruid") == F.col("_duid")), "left")
            .join(clears, F.col("_ruid") == F.col("_cuid"), "left")
            .select("_rid", "_ruid", F.least("_rm_seq", "_clr_seq").alias("_gone_seq")))
    targeted = edits.filter(F.col("op") != "clear").join(
        gone, (F.col("id") == F.col("_rid")) & (F.col("user_id") == F.col("_ruid")), "left")
    live = F.col("_rid").isNotNull() & (F.col("_gone_seq").isNull() | (F.col("seq") < F.col("_gone_seq"))
                                        | ((F.col("op") == "remove") & (F.col("seq") == F.col("_gone_seq"))))
    targeted = targeted.withColumn("_ok", live)
    outcome = targeted.select("seq", "op", "id", "user_id",
                              F.when(F.col("_ok"), F.lit(None).cast("string"))
                               .otherwise("Cart item not found").alias("error")).unionByName(
        edits.filter(F.col("op") == "clear").select("seq", "op", "id", "user_id",
                                                    F.lit(None).cast("string").alias("error")))
    ok = targeted.filter("_ok")
    q = last_by(ok.filter(F.col("op") == "set_quantity"), ["id"], [F.col("seq")], ["quantity"]) \
        .withColumnRenamed("quantity", "_q").withColumnRenamed("id", "_qid")
    s = last_by(ok.filter(F.col("op") == "set_selected"), ["id"], [F.col("seq")], ["selected"]) \
        .withColumnRenamed("selected", "_s").withColumnRenamed("id", "_sid")
    kept = cart.join(gone.filter(F.col("_gone_seq").isNotNull()).select(F.col("_rid").alias("id")), "id", "left_anti")
    new_cart = (kept.join(q, F.col("id") == F.col("_qid"), "left").join(s, F.col("id") == F.col("_sid"), "left")
                .withColumn("quantity", F.coalesce(F.col("_q").cast("int"), "quantity"))
                .withColumn("selected", F.when(F.col("_sid").isNotNull(), F.col("_s")).otherwise(F.col("selected"))))
    return Change({"cart": _align(new_cart, cart)}, outcome)


def merge_wishlist(wishlist: DataFrame, ops: DataFrame, as_of) -> Change:
    """``ops`` (seq, op 'add' | 'remove', user_id, product_id) in seq order.

    add: inserts when the pair is absent, else 'Item already in wishlist';
    remove: deletes when present, else 'Item not found in wishlist'.  The
    state before an op is the snapshot's for the first op of a pair and
    "present" exactly when the previous op was an add.
    """
    had = wishlist.select("user_id", "product_id", F.col("id").alias("_old_id"),
                          F.col("created_at").alias("_old_created")).groupBy("user_id", "product_id") \
        .agg(F.min(F.struct("_old_id", "_old_created")).alias("_old"))
    # previous op of the pair via key_scan: a hot pair is split over many tasks
    o = key_scan(ops.join(had, ["user_id", "product_id"], "left"), ["user_id", "product_id"], ["seq"],
                 lag_of="op", count_name="_n_ops", lag_name="_prev").drop("_n_ops")
    before = F.when(F.col("_prev").isNull(), F.col("_old").isNotNull()).otherwise(F.col("_prev") == "add")
    o = o.withColumn("_present_before", before).withColumn(
        "error", F.when((F.col("op") == "add") & F.col("_present_before"), "Item already in wishlist")
                  .when((F.col("op") == "remove") & ~F.col("_present_before"), "Item not found in wishlist"))
    outcome = o.select("seq", "op", "user_id", "product_id", "error")
    # one partial aggregate per pair: last op, any successful remove, last successful add
    ok = F.col("error").isNull()
    touched = o.groupBy("user_id", "product_id").agg(
        F.max_by("op", "seq").alias("_last_op"),
        F.max(F.when((F.col("op") == "remove") & ok, F.lit(True))).alias("_removed"),
        F.max(F.when((F.col("op") == "add") & ok, F.col("seq"))).alias("_add_seq"))
    # untouched and kept-old rows stay as they are; re-added pairs get a new row
    drop_old = touched.filter(F.col("_removed").isNotNull()).select("user_id", "product_id")
    kept = wishlist.join(drop_old, ["user_id", "product_id"], "left_anti")
    fresh = (touched.filter((F.col("_last_op") == "add") & F.col("_add_seq").isNotNull())
             .select(_next_id(wishlist, F.col("_add_seq")).alias("id"), "user_id", "product_id",
                     _ts(as_of).alias("created_at")))
    return Change({"wishlist": _align(kept, wishlist).unionByName(_align(fresh, wishlist))}, outcome)


# ---------------------------------------------------------------- orders

def ingest_orders(orders: DataFrame, order_items: DataFrame, products: DataFrame, cart: DataFrame,
                  requests: DataFrame, lines: DataFrame, as_of) -> Change:
    """C4: place a batch of orders.

    ``requests``: seq, user_id, payment_method, total_amount, and any further
    column of ``orders`` (the shipping fields), which is taken over;
    ``lines``: seq, product_id, quantity, and a unique ``line_seq`` (from 0)
    if ``order_items`` has an id (a new item gets max(id) + 1 + line_seq).
    The method must be 'cod' or
    'online' ('Invalid payment method'); an order naming an unknown product
    is refused whole ('Product not found').  A null total becomes 0.  Line
    prices are copied from products.  cod: status 'pending', stock drops by
    the ordered quantity (it may go negative), the buyer's cart is emptied;
    online: 'pending_payment', temporary, stock and cart untouched.
    """
    price = products.select(F.col("id").alias("_pid"), F.col("price").alias("_price"))
    priced = lines.join(price, F.col("product_id") == F.col("_pid"), "left")
    missing = priced.filter(F.col("_pid").isNull()).select("seq").distinct().withColumn("_missing", F.lit(True))
    req = requests.join(missing, "seq", "left")
    error = (F.when(~F.coalesce(F.col("payment_method").isin(list(PAYMENT_METHODS)), F.lit(False)),
                    "Invalid payment method")
             .when(F.col("_missing").isNotNull(), "Product not found"))
    req = req.withColumn("error", error).withColumn("order_id", F.when(F.col("error").isNull(),
                                                                        _next_id(orders, F.col("seq"))))
    ok = req.filter(F.col("error").isNull())
    is_cod = F.col("payment_method") == "cod"
    decided = {
        "id": F.col("order_id"), "user_id": F.col("user_id"),
        "total_amount": F.coalesce(F.col("total_amount").cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)")),
        "status": F.when(is_cod, "pending").otherwise("pending_payment"),
        "created_at": _ts(as_of), "payment_method": F.col("payment_method"),
        "payment_method_type": F.col("payment_method"), "payment_status": F.lit("pending"),
        "is_temporary": ~is_cod}
    given = [c for c in orders.columns if c in requests.columns and c not in decided]
    new_orders = ok.select(*[c.alias(name) for name, c in decided.items()], *given)
    item_id = []
    if "id" in order_items.columns:
        if "line_seq" not in lines.columns:
            raise ValueError("order_items has ids: lines need a unique line_seq")
        item_id = [_next_id(order_items, F.col("line_seq")).alias("id")]
    new_items = (priced.join(ok.select("seq", "order_id", "payment_method"), "seq", "inner")
                 .select(*item_id, "order_id", "product_id", F.col("quantity").cast("int").alias("quantity"),
                         F.col("_price").alias("price_at_time"), "payment_method"))
    cod_units = new_items.filter(F.col("payment_method") == "cod").groupBy("product_id") \
        .agg(F.sum("quantity").alias("_units"))
    new_products = _subtract_stock(products, cod_units)
    cod_users = ok.filter(is_cod).select(F.col("user_id")).distinct()
    outcome = req.select("seq", "user_id", "payment_method", "error", "order_id",
                         F.when(F.col("error").isNull(), F.when(is_cod, "pending").otherwise("pending_payment"))
                          .alias("status"))
    return Change({
        "orders": _align(orders, orders).unionByName(_align(new_orders, orders)),
        "order_items": _align(order_items, order_items).unionByName(_align(new_items, order_items)),
        "products": new_products,
        "cart": cart.join(cod_users, "user_id", "left_anti"),
    }, outcome)


def _subtract_stock(products: DataFrame, units: DataFrame) -> DataFrame:
    """stock_quantity -= units per product (a null stock stays null, as in SQL)."""
    u = units.select(F.col("product_id").alias("_upid"), "_units")
    return (products.join(u, F.col("id") == F.col("_upid"), "left")
            .withColumn("stock_quantity", F.when(F.col("_units").isNull(), F.col("stock_quantity"))
                        .otherwise((F.col("stock_quantity") - F.col("_units")).cast("int")))
            .drop("_upid", "_units"))


def confirm_payments(orders: DataFrame, order_items: DataFrame, products: DataFrame, cart: DataFrame,
                     payments: DataFrame) -> Change:
    """``payments`` (seq, order_id, user_id, payment_id) confirm own temporary orders.

    The first payment of an order confirms it (status 'confirmed', paid,
    permanent, method 'online'); stock drops by its items and the buyer's
    cart is emptied.  Others answer 'Order not found or not a temporary order'.
    """
    temp = orders.filter(F.col("is_temporary") == F.lit(True)).select(
        F.col("id").alias("_oid"), F.col("user_id").alias("_ouid"))
    matched = payments.join(temp, (F.col("order_id") == F.col("_oid")) & (F.col("user_id") == F.col("_ouid")), "left")
    first = matched.filter(F.col("_oid").isNotNull()).groupBy(F.col("order_id").alias("_foid")) \
        .agg(F.min("seq").alias("_first_seq"))
    matched = matched.join(first, F.col("order_id") == F.col("_foid"), "left")
    ok_flag = F.col("_oid").isNotNull() & (F.col("seq") == F.col("_first_seq"))
    outcome = matched.select("seq", "order_id", "user_id", "payment_id",
                             F.when(ok_flag, F.lit(None).cast("string"))
                              .otherwise("Order not found or not a temporary order").alias("error"))
    win = matched.filter(ok_flag).select(F.col("order_id").alias("_wid"), F.col("payment_id").alias("_pay"),
                                         F.col("user_id").alias("_wuid"))
    o = orders.join(win, F.col("id") == F.col("_wid"), "left")
    hit = F.col("_wid").isNotNull()
    fixed = {"status": "confirmed", "payment_status": "paid", "is_temporary": False,
             "payment_method": "online", "payment_method_type": "online"}
    cols = []
    for f in orders.schema.fields:
        if f.name in fixed:
            cols.append(F.when(hit, F.lit(fixed[f.name])).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name))
        elif f.name == "payment_id":
            cols.append(F.when(hit, F.col("_pay")).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(f.name))
    for name in ("payment_status", "payment_id"):
        if name not in orders.columns:
            cols.append(F.when(hit, F.lit("paid") if name == "payment_status" else F.col("_pay"))
                        .cast("string").alias(name))
    new_orders = o.select(*cols)
    units = order_items.join(win.select(F.col("_wid").alias("order_id")), "order_id", "left_semi") \
        .groupBy("product_id").agg(F.sum("quantity").alias("_units"))
    users = win.select(F.col("_wuid").alias("user_id")).distinct()
    return Change({"orders": new_orders, "products": _subtract_stock(products, units),
                   "cart": cart.join(users, "user_id", "left_anti")}, outcome)


def cancel_temporary(orders: DataFrame, order_items: DataFrame, cancels: DataFrame) -> Change:
    """``cancels`` (seq, order_id, user_id) delete own temporary orders and their items."""
    temp = orders.filter(F.col("is_temporary") == F.lit(True)).select(
        F.col("id").alias("_oid"), F.col("user_id").alias("_ouid"))
    m = cancels.join(temp, (F.col("order_id") == F.col("_oid")) & (F.col("user_id") == F.col("_ouid")), "left")
    first = m.filter(F.col("_oid").isNotNull()).groupBy(F.col("order_id").alias("_foid")).agg(F.min("seq").alias("_fs"))
    m = m.join(first, F.col("order_id") == F.col("_foid"), "left")
    ok_flag = F.col("_oid").isNotNull() & (F.col("seq") == F.col("_fs"))
    outcome = m.select("seq", "order_id", "user_id",
                       F.when(ok_flag, F.lit(None).cast("string"))
                        .otherwise("Order not found or not a temporary order").alias("error"))
    gone = m.filter(ok_flag).select(F.col("order_id").alias("id")).distinct()
    return Change({"orders": orders.join(gone, "id", "left_anti"),
                   "order_items": order_items.join(gone.withColumnRenamed("id", "order_id"), "order_id", "left_anti")},
                  outcome)


def purge_stale(orders: DataFrame, order_items: DataFrame, older_than) -> Change:
    """Delete temporary orders created before ``older_than`` (left behind by failed payments)."""
    stale = orders.filter((F.col("is_temporary") == F.lit(True)) & (F.col("created_at") < _ts(older_than)))
    gone = stale.select("id")
    return Change({"orders": orders.join(gone, "id", "left_anti"),
                   "order_items": order_items.join(gone.withColumnRenamed("id", "order_id"), "order_id", "left_anti")},
                  stale.select(F.col("id").alias("order_id"), "user_id", "created_at"))


def change_order_status(orders: DataFrame, changes: DataFrame, as_of) -> Change:
    """``changes`` (seq, order_id, status); whitelist, then the last valid change wins."""
    valid = F.coalesce(F.col("status").isin(list(ORDER_STATUSES)), F.lit(False))  # a null status is invalid
    known = orders.select(F.col("id").alias("_oid"))
    c = changes.join(known, F.col("order_id") == F.col("_oid"), "left")
    outcome = c.select("seq", "order_id", "status",
                       F.when(~valid, "Invalid status").when(F.col("_oid").isNull(), "Order not found")
                        .alias("error"))
    last = last_by(c.filter(valid & F.col("_oid").isNotNull()), ["order_id"], [F.col("seq")], ["status"]) \
        .select(F.col("order_id").alias("_cid"), F.col("status").alias("_new_status"))
    o = orders.join(last, F.col("id") == F.col("_cid"), "left")
    hit = F.col("_cid").isNotNull()
    o = o.withColumn("status", F.when(hit, F.col("_new_status")).otherwise(F.col("status")))
    if "updated_at" not in orders.columns:
        o = o.withColumn("updated_at", F.lit(None).cast(NTZ))
    o = o.withColumn("updated_at", F.when(hit, _ts(as_of)).otherwise(F.col("updated_at")))
    return Change({"orders": o.drop("_cid", "_new_status")}, outcome)


def apply_coupons(cart: DataFrame, coupons: DataFrame, allocations: DataFrame) -> Change:
    """Write Q17 line discounts onto cart rows; count one use per applied cart.

    ``allocations`` are Q17 rows: cart_id (= user_id), code, product_id,
    coupon_id, valid, line_discount.  Every cart row of (user, product)
    gets the discount of that product's last allocation (by line_no, then
    code), so a cart with two rows of one product keeps two rows; coupons
    gain the number of carts that used them.
    """
    ok = allocations.filter(F.col("valid"))
    d = (ok.groupBy(F.col("cart_id").alias("_u"), F.col("product_id").alias("_p"))
         .agg(F.max(F.struct("line_no", "code", "line_discount")).alias("_last"))
         .select("_u", "_p", F.col("_last.line_discount").cast("decimal(12,4)").alias("_disc")))
    c = cart.join(d, (F.col("user_id") == F.col("_u")) & (F.col("product_id") == F.col("_p")), "left")
    if "discount_amount" not in cart.columns:
        c = c.withColumn("discount_amount", F.lit(None).cast("decimal(12,4)"))
    c = c.withColumn("discount_amount", F.when(F.col("_u").isNotNull(), F.col("_disc"))
                     .otherwise(F.col("discount_amount"))).drop("_u", "_p", "_disc")
    uses = ok.select("coupon_id", "cart_id", "code").distinct().groupBy(F.col("coupon_id").alias("_cid")) \
        .agg(F.count(F.lit(1)).alias("_uses"))
    cp = (coupons.join(uses, F.col("id") == F.col("_cid"), "left")
          .withColumn("times_used", (F.coalesce("times_used", F.lit(0)) + F.coalesce("_uses", F.lit(0))).cast("int"))
          .drop("_cid", "_uses"))
    return Change({"cart": c, "coupons": cp}, ok.select("cart_id", "code", "product_id", "line_discount"))


# ---------------------------------------------------------------- generic patches

def patch_rows(table: DataFrame, patches: DataFrame, keep_cols: list[str], overwrite_cols: list[str],
               as_of, key: str = "id", stamp: str | None = "updated_at", missing: str = "Not found",
               owner: str | None = None) -> Change:
    """Partial update by ``key`` in seq order.

    ``keep_cols`` take the last non-null patched value (COALESCE(new, old));
    ``overwrite_cols`` take the last patch's value even when null.  Patched
    rows get ``stamp`` = as_of; patches of unknown keys answer ``missing``.
    With ``owner``, so do patches whose column of that name is not the row's.
    """
    known = table.select(F.col(key).alias("_k"), *([F.col(owner).alias("_owner")] if owner else []))
    same = F.col(key) == F.col("_k")
    if owner:
        same = same & (F.col(owner) == F.col("_owner"))
    p = patches.join(known, same, "left").drop("_owner")
    outcome = p.select("seq", key, F.when(F.col("_k").isNull(), missing).alias("error"))
    p = p.filter(F.col("_k").isNotNull())
    aggs = [F.max(F.col("seq")).alias("_last_seq")]
    for c in keep_cols:
        aggs.append(F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("seq").alias("s"), F.col(c).alias("v"))))
                    .alias(f"_keep_{c}"))
    for c in overwrite_cols:
        aggs.append(F.max(F.struct(F.col("seq").alias("s"), F.col(c).alias("v"))).alias(f"_over_{c}"))
    per_key = p.groupBy(F.col(key).alias("_pk")).agg(*aggs)
    t = table.join(per_key, F.col(key) == F.col("_pk"), "left")
    hit = F.col("_pk").isNotNull()
    cols = []
    for f in table.schema.fields:
        c = f.name
        if c in keep_cols:
            cols.append(F.coalesce(F.col(f"_keep_{c}.v").cast(f.dataType), F.col(c)).alias(c))
        elif c in overwrite_cols:
            cols.append(F.when(hit, F.col(f"_over_{c}.v").cast(f.dataType)).otherwise(F.col(c)).alias(c))
        elif c == stamp:
            cols.append(F.when(hit, _ts(as_of)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    if stamp and stamp not in table.columns:
        cols.append(F.when(hit, _ts(as_of)).alias(stamp))
    return Change({"table": t.select(*cols)}, outcome)


# ---------------------------------------------------------------- catalog inserts

_NUM_PREFIX = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"
_INT_PREFIX = r"^\s*([+-]?\d+)"


def _js_float(c: Column) -> Column:
    """parseFloat: the leading decimal number of the text, else null (NaN)."""
    s = F.regexp_extract(c, _NUM_PREFIX, 1)
    return F.when(s != "", s.try_cast("double"))


def _js_int(c: Column) -> Column:
    """parseInt(x, 10): the leading integer of the text, else null (NaN)."""
    s = F.regexp_extract(c, _INT_PREFIX, 1)
    return F.when(s != "", s.try_cast("long"))


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


#: Optional columns of a new product: they are taken over, empty texts as null.
PRODUCT_EXTRAS = ("usage_instructions", "size", "benefits", "ingredients", "product_details",
                  "image_url", "image_url2", "image_url3")


def add_products(products: DataFrame, categories: DataFrame, rows: DataFrame, as_of) -> Change:
    """Admin product inserts (all fields as submitted text).

    Checks in order: name, price and category present; category id an
    integer; category exists; price, stock and offer parse; offer 0..100;
    price and stock fit their columns (numeric(10,2), integer): a row that
    does not is refused alone.
    The category's name is copied into ``category``; stock and offer default
    to 0; of PRODUCT_EXTRAS, those that ``rows`` and ``products`` both have
    are taken over, with empty texts as null.
    """
    cats = categories.select(F.col("id").alias("_cid"), F.col("name").alias("_cname"))
    r = rows.withColumn("_cat", _js_int(F.col("category_id")))
    r = r.join(cats, F.col("_cat") == F.col("_cid"), "left")
    price = _js_float(F.col("price"))
    stock = _js_int(F.when(_blank(F.col("stock_quantity")), F.lit("0")).otherwise(F.col("stock_quantity")))
    offer = _js_int(F.when(_blank(F.col("offer_percentage")), F.lit("0")).otherwise(F.col("offer_percentage")))
    error = (F.when(_blank(F.col("name")) | _blank(F.col("price")) | _blank(F.col("category_id")),
                    "Name, price, and category are required")
             .when(F.col("_cat").isNull(), "Invalid category ID format")
             .when(F.col("_cid").isNull(), "Invalid category ID")
             .when(price.isNull(), "Invalid price format")
             .when(stock.isNull(), "Invalid stock quantity format")
             .when(offer.isNull() | (offer < 0) | (offer > 100),
                   "Invalid offer percentage. Must be between 0 and 100")
             .when(price.try_cast("decimal(10,2)").isNull(), "Price out of range")
             .when(stock.try_cast("int").isNull(), "Stock quantity out of range"))
    r = r.withColumn("error", error).withColumn("_price", price).withColumn("_stock", stock).withColumn("_offer", offer)
    ok = r.filter(F.col("error").isNull())
    new = ok.select(
        _next_id(products, F.col("seq")).alias("id"), "name",
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.col("_price").cast("decimal(10,2)").alias("price"),
        F.col("_cname").alias("category"), F.col("_cat").alias("category_id"),
        F.col("_stock").cast("int").alias("stock_quantity"),
        F.col("_offer").cast("int").alias("offer_percentage"),
        _ts(as_of).alias("created_at"),
        *[F.when(~_blank(F.col(c)), F.col(c)).alias(c) for c in PRODUCT_EXTRAS if c in rows.columns])
    outcome = r.select("seq", "name", "error",
                       F.when(F.col("error").isNull(), _next_id(products, F.col("seq"))).alias("product_id"))
    return Change({"products": _align(products, products).unionByName(_align(new, products))}, outcome)


def add_reviews(reviews: DataFrame, products: DataFrame, rows: DataFrame, as_of) -> Change:
    """C11: ``rows`` (seq, user_id, product_id, rating, comment).

    Product must exist ('Product not found'); one review per (user,
    product): an existing one or an earlier row of the batch wins ('You
    have already reviewed this product'); rating must be 1..5 (the table's
    CHECK; 'Rating must be between 1 and 5').
    """
    prods = products.select(F.col("id").alias("_pid"))
    existing = reviews.select("user_id", "product_id").distinct().withColumn("_had", F.lit(True))
    firsts = first_by(rows.filter((F.col("rating") >= 1) & (F.col("rating") <= 5)),
                      ["user_id", "product_id"], [F.col("seq")], ["seq"]).withColumnRenamed("seq", "_first")
    r = (rows.join(prods, F.col("product_id") == F.col("_pid"), "left")
         .join(existing, ["user_id", "product_id"], "left")
         .join(firsts, ["user_id", "product_id"], "left"))
    error = (F.when(F.col("_pid").isNull(), "Product not found")
             .when(F.col("_had").isNotNull() | (F.col("_first") < F.col("seq")),
                   "You have already reviewed this product")
             .when((F.col("rating") < 1) | (F.col("rating") > 5) | F.col("rating").isNull(),
                   "Rating must be between 1 and 5"))
    r = r.withColumn("error", error)
    ok = r.filter(F.col("error").isNull())
    new = ok.select(_next_id(reviews, F.col("seq")).alias("id"), "product_id", "user_id",
                    F.col("rating").cast("int").alias("rating"), "comment", _ts(as_of).alias("created_at"))
    return Change({"reviews": _align(reviews, reviews).unionByName(_align(new, reviews))},
                  r.select("seq", "user_id", "product_id", "error"))


def brand_review_changes(brand_reviews: DataFrame, rows: DataFrame, as_of) -> Change:
    """C11 (brand): ``rows`` (seq, op 'add' | 'update' | 'delete', user_id, id, rating, comment).

    One review per user.  add: refused when the user has one ('You have
    already submitted a brand review'); update: rating and comment of the
    user's review ('Review not found'); delete: by (id, user) ('Review not
    found or you do not have permission to delete it').  Ops of a user apply
    in seq order.  A rating outside 1..5 (or null) changes nothing ('Rating
    must be between 1 and 5').  A new review's id is max(id) + 1 + seq,
    whatever id its row names; the id of a delete may be one of those.

    Which review a user has before each op is a ``slot_scan``: one lazy plan,
    and a user with a third of all ops is spread over many tasks.  Rating and
    comment of the review that is left come from the last op on it, a partial
    aggregate.
    """
    start = F.lit(-(2 ** 63)).cast("long")          # a review that predates the batch is put first
    touched = rows.select("user_id").distinct()
    old = (brand_reviews.groupBy("user_id").agg(F.min(F.struct("id", "rating", "comment", "created_at")).alias("_o"))
           .join(touched, "user_id", "left_semi"))
    rated = F.coalesce(F.col("rating").between(1, 5), F.lit(False))
    ops = rows.select("user_id", "seq", "op",
                      F.when(F.col("op") == "add", _next_id(brand_reviews, F.col("seq"))).otherwise(F.col("id"))
                       .cast("long").alias("id"), rated.alias("_rated"))
    held = slot_scan(
        ops.unionByName(old.select("user_id", start.alias("seq"), F.lit("stored").alias("op"),
                                   F.col("_o.id").cast("long").alias("id"), F.lit(True).alias("_rated"))),
        "user_id", "seq", put=F.when(F.col("op").isin("add", "stored") & F.col("_rated"), F.col("id")),
        drop=F.when(F.col("op") == "delete", F.col("id")))
    present = F.col("held_before").isNotNull()
    err = (F.when((F.col("op") == "add") & present, "You have already submitted a brand review")
           .when((F.col("op") == "update") & ~present, "Review not found")
           .when(F.col("op").isin("add", "update") & ~F.col("_rated"), "Rating must be between 1 and 5")
           .when((F.col("op") == "delete") & ~(present & F.coalesce(F.col("id") == F.col("held_before"), F.lit(False))),
                 "Review not found or you do not have permission to delete it"))
    outcome = held.filter("op <> 'stored'").select("user_id", "seq", err.alias("error"))
    # per user the review that is left, and the op that wrote it last
    last = held.groupBy("user_id").agg(
        F.max_by("held_after", "seq").alias("_rid"),
        F.max(F.when(F.col("op").isin("add", "update", "stored") & err.isNull(), F.col("seq"))).alias("_wrote"))
    left = last.filter("_rid is not null").select(F.col("user_id").alias("_u"), "_rid", "_wrote")
    wrote = rows.select(F.col("user_id").alias("_wu"), F.col("seq").alias("_wseq"), F.col("rating").alias("_wr"),
                        F.col("comment").alias("_wc"))
    fin = (left.join(wrote, F.col("_u").eqNullSafe(F.col("_wu")) & (F.col("_wrote") == F.col("_wseq")), "left")
           .join(old.select(F.col("user_id").alias("_ou"), "_o"), F.col("_u").eqNullSafe(F.col("_ou")), "left"))
    is_old = F.coalesce(F.col("_rid") == F.col("_o.id"), F.lit(False))
    final = fin.select(
        F.col("_rid").alias("id"), F.col("_u").alias("user_id"),
        F.when(F.col("_wrote") == start, F.col("_o.rating")).otherwise(F.col("_wr")).alias("rating"),
        F.when(F.col("_wrote") == start, F.col("_o.comment")).otherwise(F.col("_wc")).alias("comment"),
        F.when(is_old, F.col("_o.created_at")).otherwise(_ts(as_of)).alias("created_at"))
    untouched = brand_reviews.join(touched, "user_id", "left_anti")
    return Change({"brand_reviews": _align(untouched, brand_reviews).unionByName(_align(final, brand_reviews))},
                  outcome)


#: What a category change is answered; fixed values.
NAME_TAKEN, NO_CATEGORY = "Category name already exists", "Category not found"
HAS_CHILDREN = "Cannot delete category with existing subcategories"
HAS_PRODUCTS = "Cannot delete category with existing products"

_CLAIMS = "group string, ord long, seq long, what string, id long, lname string"


def _claim_replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Holders of names, group by group in order; per claim whether it was refused (``taken``).

    Rows come sorted by (group, ord).  What is remembered is the holders of
    the current group's names, never its rows.
    """
    group, holders, held_by = None, {}, {}
    for rows in batches:
        taken = []
        for g, seq, what, who, name in zip(rows["group"], rows["seq"], rows["what"], rows["id"], rows["lname"]):
            if g != group:
                group, holders, held_by = g, {}, {}
            who = None if pd.isna(who) else int(who)
            by = holders.setdefault(name, set())
            if what == "stored":
                by.add(who)
                held_by[who] = name
                taken.append(False)
            elif what == "update":
                refused = name != "" and bool(by - {who})
                taken.append(refused)
                if not refused:
                    holders.get(held_by.get(who), set()).discard(who)
                    by.add(who)
                    held_by[who] = name
            else:  # insert, or a look at the name that changes nothing
                taken.append(bool(by))
                if what == "insert" and not by:
                    by.add(-1 - int(seq))
        yield pd.DataFrame({"seq": rows["seq"], "what": rows["what"], "lname": rows["lname"], "taken": taken})


def _claim_outcomes(categories: DataFrame, rows: DataFrame) -> DataFrame:
    """(seq, taken) of every row that names a category, as if the rows came one by one.

    Names that some category has or gets in the batch depend on each other
    through it; such names form a group (connected components), and groups
    are independent.  Inside a group only renamings of stored categories can
    free a name, so between two of them one look and the first insert of a
    name decide for all rows with that name: the replay reads the renamings
    and at most two rows a name and gap, however many rows ask for it.
    """
    stored = categories.select(F.col("id").alias("_sid"), F.lower("name").alias("_sname"))
    r = rows.select("seq", "id", F.lower("name").alias("lname")).filter("lname is not null")
    r = r.join(stored.select("_sid"), F.col("id") == F.col("_sid"), "left").withColumn(
        "renames", F.col("_sid").isNotNull()).drop("_sid")
    renames = r.filter("renames").select("id", "lname")
    held = stored.join(renames.select("id").distinct(), F.col("_sid") == F.col("id"), "left_semi")
    has = renames.unionByName(held.select(F.col("_sid").alias("id"), F.col("_sname").alias("lname"))).distinct()
    hub = has.groupBy(F.col("lname").alias("_n")).agg(F.min("id").alias("_hub"))
    roots = component_roots(has.join(hub, F.col("lname") == F.col("_n")).select(
        F.col("id").alias("a"), F.col("_hub").alias("b")))
    of_name = cut(hub.join(roots, F.col("_hub") == F.col("node"))
                  .select("_n", F.concat(F.lit("i"), F.col("root").cast("string")).alias("_g")))

    def grouped(df: DataFrame, name: str) -> DataFrame:
        return (df.join(of_name, F.col(name) == F.col("_n"), "left")
                .withColumn("group", F.coalesce("_g", F.concat(F.lit("n"), F.col(name)))).drop("_n", "_g"))

    claims = cut(key_scan(grouped(r, "lname"), ["group"], ["seq"], count_if=F.col("renames"), count_name="gap"))
    others = claims.filter(~F.col("renames"))
    first = others.groupBy("group", "gap", "lname").agg(
        F.min("seq").alias("_look"), F.min(F.when(F.col("id").isNull(), F.col("seq"))).alias("_insert"))
    asked = claims.select("lname").distinct().unionByName(has.select("lname")).distinct()
    known = stored.join(asked, F.col("_sname") == F.col("lname"), "left_semi")
    start, none = F.lit(-(2 ** 62)), F.lit(None).cast("long")
    feed = (grouped(known, "_sname").select("group", start.alias("ord"), none.alias("seq"), F.lit("stored").alias("what"),
                                            F.col("_sid").alias("id"), F.col("_sname").alias("lname"))
            .unionByName(claims.filter("renames").select("group", (F.col("seq") * 2).alias("ord"), "seq",
                                                         F.lit("update").alias("what"), "id", "lname"))
            .unionByName(first.select("group", (F.col("_look") * 2).alias("ord"), F.col("_look").alias("seq"),
                                      F.lit("look").alias("what"), none.alias("id"), "lname"))
            .unionByName(first.filter("_insert is not null").select(
                "group", (F.col("_insert") * 2 + 1).alias("ord"), F.col("_insert").alias("seq"),
                F.lit("insert").alias("what"), none.alias("id"), "lname")))
    done = cut(feed.repartition("group").sortWithinPartitions("group", "ord").mapInPandas(
        _claim_replay, "seq long, what string, lname string, taken boolean"))
    renamed = done.filter("what = 'update'").select("seq", "taken")
    looks = done.filter("what = 'look'").select(F.col("seq").alias("_look"), F.col("taken").alias("_held"))
    rest = (others.join(first.select(F.col("group").alias("_fg"), F.col("gap").alias("_fgap"),
                                     F.col("lname").alias("_fn"), "_look", "_insert"),
                        (F.col("group") == F.col("_fg")) & (F.col("gap") == F.col("_fgap")) & (F.col("lname") == F.col("_fn")))
            .join(looks, "_look"))
    return renamed.unionByName(rest.select(
        "seq", (F.col("_held") | F.coalesce(F.col("_insert") < F.col("seq"), F.lit(False))).alias("taken")))


def upsert_categories(categories: DataFrame, rows: DataFrame, as_of) -> Change:
    """``rows`` (seq, id, name, description, parent_id, image_url if the table has it); id null = insert.

    The rows apply one after the other in seq order.  A name may not equal
    another category's name at that moment, case-blind ('Category name
    already exists'): a refused row holds no name, and a renamed category
    gives its old name back.  An update of an unknown id answers 'Category
    not found' if its name is free; an update without a name (null or empty)
    asks for none.  Updates COALESCE name, description and image_url and
    overwrite parent_id.
    """
    image = [c for c in ("image_url",) if c in rows.columns and c in categories.columns]
    ids = categories.select(F.col("id").alias("_known"))
    taken = _claim_outcomes(categories, rows).select(F.col("seq").alias("_cseq"), "taken")
    r = (rows.join(taken, F.col("seq") == F.col("_cseq"), "left")
         .join(ids, F.col("id") == F.col("_known"), "left"))
    asks = F.col("id").isNull() | (F.col("name") != "")
    error = (F.when(asks & F.col("taken"), NAME_TAKEN)
             .when(F.col("id").isNotNull() & F.col("_known").isNull(), NO_CATEGORY))
    r = r.withColumn("error", error)
    ok = r.filter(F.col("error").isNull())
    inserts = ok.filter(F.col("id").isNull()).select(
        _next_id(categories, F.col("seq")).alias("id"), "name", "description", "parent_id", *image,
        _ts(as_of).alias("created_at"))
    patched = patch_rows(categories, ok.filter(F.col("id").isNotNull()).select(
        "seq", "id", "name", "description", "parent_id", *image), ["name", "description", *image], ["parent_id"], as_of,
        stamp=None).tables["table"]
    return Change({"categories": _align(patched, categories).unionByName(_align(inserts, categories))},
                  r.select("seq", "id", "name", "error"))


def _delete_times(categories: DataFrame, used: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, gone): the seq of the delete that removes each category that goes.

    A category goes with its first delete after its last child has gone, if it
    has no products.  Decided level by level from the leaves up; each round
    settles all categories whose children are settled, so there are as many
    rounds as levels of categories that the batch deletes.
    """
    asked = ids.groupBy("id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    links = categories.select(F.col("id").alias("child"), F.col("parent_id").alias("parent")).filter("parent is not null")
    may = (categories.select("id").distinct().join(asked, "id").join(used, F.col("id") == F.col("_up"), "left_anti"))
    # a child that may not go keeps its parent, so only links between those that may are followed
    stuck = (links.join(may.select(F.col("id").alias("_m")), F.col("child") == F.col("_m"), "left_anti")
             .select(F.col("parent").alias("_stuck")).distinct())
    left = cut(may.join(stuck, F.col("id") == F.col("_stuck"), "left_anti").select("id"))
    inside = links.join(may.select(F.col("id").alias("_m")), F.col("child") == F.col("_m"), "left_semi")
    inside = cut(inside.join(left.select(F.col("id").alias("_p")), F.col("parent") == F.col("_p"), "left_semi"))
    gone = None
    while True:
        waits = inside if gone is None else inside.join(
            gone.select(F.col("id").alias("_g")), F.col("child") == F.col("_g"), "left_anti")
        ready = left.join(waits.select(F.col("parent").alias("_w")).distinct(), F.col("id") == F.col("_w"), "left_anti")
        if gone is None:
            after = ready.withColumn("_after", F.lit(-(2 ** 63)))
        else:
            ready = ready.join(gone.select(F.col("id").alias("_g")), F.col("id") == F.col("_g"), "left_anti")
            last_child = (inside.join(gone.withColumnRenamed("id", "_g"), F.col("child") == F.col("_g"))
                          .groupBy("parent").agg(F.max("gone").alias("_after")))
            after = ready.join(last_child, F.col("id") == F.col("parent"), "left").select("id", F.coalesce(
                "_after", F.lit(-(2 ** 63))).alias("_after"))
        step = cut(ids.join(after.withColumnRenamed("id", "_aid"), F.col("id") == F.col("_aid"))
                   .filter(F.col("seq") > F.col("_after")).groupBy("id").agg(F.min("seq").alias("gone")))
        if step.isEmpty():
            return gone if gone is not None else step
        gone = step if gone is None else cut(gone.unionByName(step))


def delete_categories(categories: DataFrame, products: DataFrame, ids: DataFrame) -> Change:
    """``ids`` (seq, id): refuse with subcategories, then with products, then when missing.

    The deletes apply one after the other in seq order: a parent goes if its
    last child went before it in the batch.  A category that is its own
    ancestor always has a child and stays.
    """
    used = products.filter(F.col("category_id").isNotNull()).select(F.col("category_id").alias("_up")).distinct()
    gone = _delete_times(categories, used, ids)
    went = gone.select(F.col("id").alias("_gid"), F.col("gone").alias("_gone"))
    # until when a category has children: for good if one of them stays
    subs = (categories.filter(F.col("parent_id").isNotNull()).join(went, F.col("id") == F.col("_gid"), "left")
            .groupBy(F.col("parent_id").alias("_sp")).agg(F.max(F.coalesce("_gone", F.lit(2 ** 63 - 1))).alias("_until")))
    known = categories.select(F.col("id").alias("_known")).distinct()
    r = (ids.join(subs, F.col("id") == F.col("_sp"), "left").join(used, F.col("id") == F.col("_up"), "left")
         .join(known, F.col("id") == F.col("_known"), "left").join(went, F.col("id") == F.col("_gid"), "left"))
    error = (F.when(F.col("_until") >= F.col("seq"), HAS_CHILDREN)
             .when(F.col("_up").isNotNull(), HAS_PRODUCTS)
             .when(F.col("_known").isNull() | (F.col("seq") > F.col("_gone")), NO_CATEGORY))
    r = r.withColumn("error", error)
    return Change({"categories": categories.join(gone, "id", "left_anti")}, r.select("seq", "id", "error"))


def replace_coupon_products(coupon_products: DataFrame, sets: DataFrame) -> Change:
    """C14: replace a coupon's product set.

    ``sets`` is flat: one row per member (seq unique per row, set_id,
    coupon_id, product_id); an empty set is one row with a null product.
    The highest set_id per coupon wins and replaces all its links;
    coupons without a set keep theirs; duplicates in a set collapse.  A new
    link takes the id max(id) + 1 + the seq of its first row.
    """
    winner = sets.groupBy("coupon_id").agg(F.max("set_id").alias("_win"))
    members = (sets.join(winner, "coupon_id").filter(F.col("set_id") == F.col("_win"))
               .filter(F.col("product_id").isNotNull())
               .groupBy("coupon_id", "product_id").agg(F.min("seq").alias("_seq")))
    kept = coupon_products.join(winner.select("coupon_id"), "coupon_id", "left_anti")
    fresh = members.select(_next_id(coupon_products, F.col("_seq")).alias("id"), "coupon_id", "product_id")
    outcome = winner.join(members.groupBy("coupon_id").agg(F.count(F.lit(1)).alias("n_products")),
                          "coupon_id", "left").select(
        "coupon_id", F.col("_win").alias("set_id"), F.coalesce("n_products", F.lit(0)).alias("n_products"))
    return Change({"coupon_products": _align(kept, coupon_products).unionByName(_align(fresh, coupon_products))},
                  outcome)


def create_coupons(coupons: DataFrame, rows: DataFrame, as_of, coupon_products: DataFrame | None = None,
                   links: DataFrame | None = None) -> Change:
    """C14 (create): code upper-cased, minimum defaults to 0, a taken code is refused.

    ``links`` (seq unique per link, coupon_seq = the coupon row's seq,
    product_id) are the products of the new coupons; links of refused
    coupons are dropped, repeated ones collapse to the first.
    """
    taken = coupons.select(F.upper("code").alias("_ucode")).withColumn("_taken", F.lit(True))
    firsts = first_by(rows.withColumn("_ucode", F.upper("code")), ["_ucode"], [F.col("seq")], ["seq"]) \
        .withColumnRenamed("seq", "_first")
    r = rows.withColumn("_ucode", F.upper("code")).join(taken, "_ucode", "left").join(firsts, "_ucode", "left")
    r = r.withColumn("error", F.when(F.col("_taken").isNotNull() | (F.col("_first") < F.col("seq")),
                                     "Coupon code already exists"))
    ok = r.filter(F.col("error").isNull())
    new = ok.select(_next_id(coupons, F.col("seq")).alias("id"), F.col("_ucode").alias("code"), "description",
                    "discount_type", "discount_value",
                    F.coalesce("min_purchase_amount", F.lit(0)).alias("min_purchase_amount"),
                    "max_discount_amount", "start_date", "end_date", "usage_limit",
                    F.lit(0).alias("times_used"), F.lit(True).alias("is_active"), _ts(as_of).alias("created_at"))
    tables = {"coupons": _align(coupons, coupons).unionByName(_align(new, coupons))}
    if links is not None:
        made = ok.select(F.col("seq").alias("_made"), _next_id(coupons, F.col("seq")).alias("coupon_id"))
        fresh = (links.filter(F.col("product_id").isNotNull()).groupBy("coupon_seq", "product_id")
                 .agg(F.min("seq").alias("_seq")).join(made, F.col("coupon_seq") == F.col("_made"))
                 .select(_next_id(coupon_products, F.col("_seq")).alias("id"), "coupon_id", "product_id"))
        tables["coupon_products"] = _align(coupon_products, coupon_products).unionByName(
            _align(fresh, coupon_products))
    return Change(tables, r.select("seq", "code", "error"))


# ---------------------------------------------------------------- cascades and defaults

def cascade_delete(tables: dict[str, DataFrame], root: str, ids: DataFrame) -> Change:
    """Delete ``ids`` (column id) of ``root`` following the schema's links.

    A root id still referenced through a RESTRICT link is refused
    ('restricted by <child>.<column>'), an id that ``root`` does not hold is
    'not found'.  CASCADE links delete the children,
    level by level along the fixed link list; SET NULL links clear the
    referencing column.  Tables absent from ``tables`` are skipped.  Every
    step is a semi/anti join on the link key.
    """
    wanted = ids.select("id").distinct()
    blocked = None
    for link in LINKS:
        if link.parent == root and link.on_delete == "restrict" and link.child in tables:
            refs = tables[link.child].select(F.col(link.column).alias("id")).filter(F.col("id").isNotNull())
            b = wanted.join(refs, "id", "left_semi").withColumn(
                "error", F.lit(f"restricted by {link.child}.{link.column}"))
            blocked = b if blocked is None else blocked.unionByName(b)
    root_ids = wanted if blocked is None else wanted.join(blocked.select("id"), "id", "left_anti")

    doomed: dict[str, DataFrame] = {root: root_ids}    # ids to delete, per table with children
    queue = [root]
    while queue:
        parent = queue.pop(0)
        for link in LINKS:
            if (link.parent != parent or link.on_delete != "cascade" or link.child not in tables
                    or link.child == parent or "id" not in tables[link.child].columns):
                continue
            if not any(l.parent == link.child for l in LINKS):
                continue    # a leaf: removed below by its link columns, its ids are not needed
            kids = tables[link.child].join(doomed[parent].withColumnRenamed("id", link.column),
                                           link.column, "left_semi").select("id")
            doomed[link.child] = doomed[link.child].unionByName(kids) if link.child in doomed else kids
            if link.child not in queue:
                queue.append(link.child)

    out: dict[str, DataFrame] = {}
    for name, df in tables.items():
        cur = df
        if name in doomed:
            cur = cur.join(doomed[name], "id", "left_anti")
        for link in LINKS:
            if link.child != name or link.parent not in doomed or link.child == link.parent:
                continue
            gone = doomed[link.parent].withColumnRenamed("id", link.column)
            if link.on_delete == "cascade":
                cur = cur.join(gone, link.column, "left_anti")
            elif link.on_delete == "set null":
                g = gone.select(F.col(link.column).alias("_gone"), F.lit(True).alias("_g"))
                cur = (cur.join(g, F.col(link.column) == F.col("_gone"), "left")
                       .withColumn(link.column, F.when(F.col("_g").isNotNull(), F.lit(None))
                                   .otherwise(F.col(link.column)).cast(df.schema[link.column].dataType))
                       .drop("_gone", "_g"))
        for link in LINKS:   # self links (category parents) set null
            if link.child == name and link.parent == name and name in doomed and link.on_delete == "set null":
                g = doomed[name].select(F.col("id").alias("_gone"), F.lit(True).alias("_g"))
                cur = (cur.join(g, F.col(link.column) == F.col("_gone"), "left")
                       .withColumn(link.column, F.when(F.col("_g").isNotNull(), F.lit(None))
                                   .otherwise(F.col(link.column)).cast(df.schema[link.column].dataType))
                       .drop("_gone", "_g"))
        out[name] = cur
    known = tables[root].select("id", F.lit(True).alias("_known")).distinct()
    outcome = wanted.join(known, "id", "left")
    outcome = outcome.join(blocked, "id", "left") if blocked is not None \
        else outcome.withColumn("error", F.lit(None).cast("string"))
    outcome = outcome.select("id", F.when(F.col("_known").isNull(), "not found").otherwise(F.col("error")).alias("error"))
    return Change(out, outcome)


def enforce_default_address(addresses: DataFrame, changes: DataFrame, as_of) -> Change:
    """``changes`` (seq, op 'add' | 'set_default', user_id, id, fields..., is_default).

    add: a user's first address becomes default; an added default clears
    the user's others.  set_default: the row (id, user) becomes the only
    default ('Address not found').  The last default-making change of a
    user wins, so at most one default remains.
    """
    counts = addresses.groupBy(F.col("user_id").alias("_cu")).agg(F.count(F.lit(1)).alias("_n"))
    adds = changes.filter(F.col("op") == "add").join(counts, F.col("user_id") == F.col("_cu"), "left")
    first_add = adds.groupBy("user_id").agg(F.min("seq").alias("_first_add"))
    adds = adds.join(first_add, "user_id")
    makes_default = F.coalesce(F.col("is_default"), F.lit(False)) | (F.col("_n").isNull() & (F.col("seq") == F.col("_first_add")))
    adds = adds.withColumn("_default", makes_default).withColumn("_new_id", _next_id(addresses, F.col("seq")))
    known = addresses.select(F.col("id").alias("_aid"), F.col("user_id").alias("_auid"))
    sets = changes.filter(F.col("op") == "set_default").join(
        known, (F.col("id") == F.col("_aid")) & (F.col("user_id") == F.col("_auid")), "left")
    set_err = F.when(F.col("_aid").isNull(), "Address not found")
    defaults = (adds.filter("_default").select("user_id", "seq", F.col("_new_id").alias("_did"))
                .unionByName(sets.filter(F.col("_aid").isNotNull()).select("user_id", "seq", F.col("id").alias("_did"))))
    winner = last_by(defaults, ["user_id"], [F.col("seq")], ["_did"])
    new_rows = adds.select(F.col("_new_id").alias("id"), "user_id",
                           *[c for c in addresses.columns if c not in ("id", "user_id", "is_default", "created_at")
                             and c in changes.columns],
                           F.lit(False).alias("is_default"), _ts(as_of).alias("created_at"))
    allrows = _align(addresses, addresses).unionByName(_align(new_rows, addresses))
    out = (allrows.join(winner.withColumnRenamed("user_id", "_wu"), F.col("user_id") == F.col("_wu"), "left")
           .withColumn("is_default", F.when(F.col("_wu").isNotNull(), F.col("id") == F.col("_did"))
                       .otherwise(F.col("is_default"))).drop("_wu", "_did"))
    outcome = adds.select("seq", "op", "user_id", F.col("_new_id").alias("id"), F.lit(None).cast("string").alias("error")) \
        .unionByName(sets.select("seq", "op", "user_id", "id", set_err.alias("error")))
    return Change({"addresses": out}, outcome)
