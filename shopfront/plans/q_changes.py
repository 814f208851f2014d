"""Registered change jobs C1-C16 with DuckDB oracles of their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import promotions
from ..sources import change_inputs as I
from ..sources.fixtures import QUOTE_AS_OF, Shop, quote_carts
from . import q_promotions as QP
from .registry import register

AS = f"TIMESTAMP '{I.AS_OF}'"
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_NUM = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"
_INT = r"^\s*([+-]?\d+)"

INPUTS = {
    "c_adds": f"""
SELECT event_id AS seq, user_id, {_K} AS product_id, CAST(1 + event_id % 3 AS INTEGER) AS quantity
FROM events WHERE event_type = 'purchase'""",
    "c_edits": f"""
SELECT e.event_id AS seq,
       CASE WHEN e.event_id % 40 = 3 THEN 'clear' WHEN e.event_id % 4 = 0 THEN 'set_quantity'
            WHEN e.event_id % 4 = 1 THEN 'set_selected' ELSE 'remove' END AS op,
       COALESCE(c.id, e.event_id + {I.UNKNOWN_PRODUCT_OFFSET}) AS id, e.user_id,
       CAST(1 + floor(e.value) % 5 AS INTEGER) AS quantity, e.event_id % 2 = 0 AS selected
FROM (SELECT *, {_K} AS k FROM events WHERE event_type = 'click') e
LEFT JOIN shop_cart c ON c.user_id = e.user_id AND c.product_id = e.k""",
    "c_wops": f"""
SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'remove' ELSE 'add' END AS op,
       user_id, {_K} AS product_id
FROM events WHERE event_type = 'view'""",
    "c_req": """
SELECT o_orderkey AS seq, o_custkey AS user_id,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'cod' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'card'
            ELSE 'online' END AS payment_method,
       CAST(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS DECIMAL(10,2)) AS total_amount
FROM orders""",
    "c_lines": f"""
SELECT l_orderkey AS seq,
       CASE WHEN l_linenumber = 7 THEN l_partkey + {I.UNKNOWN_PRODUCT_OFFSET} ELSE l_partkey END AS product_id,
       CAST(l_quantity AS INTEGER) AS quantity
FROM lineitem""",
    "c_pay": """
SELECT o_orderkey AS seq, o_orderkey AS order_id, o_custkey AS user_id,
       'pay_' || CAST(o_orderkey AS VARCHAR) AS payment_id
FROM orders""",
    "c_cancel": "SELECT o_orderkey AS seq, o_orderkey AS order_id, o_custkey AS user_id FROM orders",
    "c_status": """
SELECT o_orderkey AS seq, o_orderkey + 7 AS order_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'shipped' WHEN '2-HIGH' THEN 'cancelled'
            WHEN '3-MEDIUM' THEN 'processing' WHEN '4-NOT SPECIFIED' THEN 'on hold' ELSE 'delivered' END AS status
FROM orders""",
    "c_patch": """
SELECT id AS seq, id,
       CASE WHEN id % 3 = 0 THEN NULL ELSE name || ' v2' END AS name,
       CASE WHEN id % 3 = 1 THEN NULL ELSE 'new ' || description END AS description,
       CAST(CASE WHEN id % 3 = 2 THEN NULL ELSE price + 1 END AS DECIMAL(10,2)) AS price,
       CAST(CASE WHEN id % 3 = 0 THEN NULL ELSE 5 END AS INTEGER) AS offer_percentage
FROM shop_products""",
    "c_prows": """
SELECT p_partkey AS seq,
       CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name || ' II' END AS name,
       p_type AS description,
       CASE WHEN p_partkey % 13 = 0 THEN 'abc' WHEN p_partkey % 17 = 0 THEN CAST(p_retailprice AS VARCHAR) || 'x'
            WHEN p_partkey % 23 = 0 THEN '1e12' ELSE CAST(p_retailprice AS VARCHAR) END AS price,
       CASE WHEN p_size = 49 THEN 'x1' WHEN p_size = 48 THEN '77' ELSE CAST(p_size AS VARCHAR) END AS category_id,
       CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN '3000000000'
            ELSE CAST(p_size * 3 AS VARCHAR) END AS stock_quantity,
       CASE WHEN p_size > 40 THEN CAST(p_size * 3 AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS offer_percentage
FROM part""",
    "c_rrows": f"""
SELECT event_id AS seq, user_id,
       CASE WHEN event_id % 50 = 0 THEN k + {I.UNKNOWN_PRODUCT_OFFSET} ELSE k END AS product_id,
       CAST(floor(value) % 7 AS INTEGER) AS rating, 'c' || CAST(event_id AS VARCHAR) AS comment
FROM (SELECT *, {_K} AS k FROM events WHERE event_type = 'click')""",
    "c_cats": """
SELECT seq, id, name, 'about ' || n_name AS description,
       CAST(CASE WHEN key % 4 = 0 THEN NULL ELSE n_regionkey + 100 END AS BIGINT) AS parent_id
FROM (SELECT CAST(n_nationkey AS BIGINT) AS key, n_name, n_regionkey,
             unnest([{'seq': key + 1, 'id': CASE WHEN key % 2 = 0 THEN NULL ELSE key END,
                      'name': CASE WHEN key % 3 = 0 THEN lower(n_name) WHEN key % 5 = 0 THEN NULL ELSE n_name || '_X' END},
                     {'seq': 100 + 2 * key, 'id': key + 500, 'name': 'Q' || n_name},
                     {'seq': 101 + 2 * key, 'id': NULL, 'name': 'q' || lower(n_name)},
                     {'seq': key + 200, 'id': key, 'name': 'R' || n_name},
                     {'seq': key + 300, 'id': NULL, 'name': n_name}], recursive := true) FROM nation)""",
    "c_cprod": """
SELECT p.* FROM shop_products p WHERE p.category_id IN (SELECT id FROM shop_categories WHERE parent_id <> 101)""",
    "c_cdel": """
SELECT id AS seq, id FROM shop_categories
UNION ALL
SELECT CAST(n_nationkey + 1000 AS BIGINT), CAST(n_nationkey + 500 AS BIGINT) FROM nation""",
    "c_sets": """
SELECT p_partkey AS seq, CAST(substr(p_brand, 7, 10) AS BIGINT) AS set_id,
       CAST(substr(p_brand, 7, 10) AS BIGINT) - 1 AS coupon_id, p_partkey AS product_id
FROM part""",
    "c_ccreate": """
SELECT CAST(r_regionkey AS BIGINT) AS seq,
       CASE WHEN r_regionkey % 2 = 1 THEN 'code' || CAST(r_regionkey AS VARCHAR) ELSE 'new' || lower(r_name) END AS code
FROM region""",
    "c_addr": """
SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'O' THEN 'add' ELSE 'set_default' END AS op,
       o_custkey AS user_id, o_orderkey AS id, 'New ' || CAST(o_orderkey AS VARCHAR) AS address_line1,
       o_orderpriority = '2-HIGH' AS is_default
FROM orders""",
}


def reg(name, oracle, **ctes):
    return register(name, oracle=oracle, ctes={**INPUTS, **ctes})


# ------------------------------------------------------------------ C1

_PER_KEY = {"per_key": "SELECT user_id, product_id, SUM(quantity) AS add_q, MIN(seq) AS first_seq "
                       "FROM c_adds GROUP BY user_id, product_id"}


@reg("c01_merge_cart", f"""
SELECT c.id, c.user_id, c.product_id, CAST(c.quantity + COALESCE(k.add_q, 0) AS INTEGER) AS quantity,
       c.selected, c.created_at
FROM shop_cart c LEFT JOIN per_key k ON k.user_id = c.user_id AND k.product_id = c.product_id
UNION ALL
SELECT (SELECT MAX(id) + 1 FROM shop_cart) + k.first_seq, k.user_id, k.product_id, CAST(k.add_q AS INTEGER),
       false, {AS}
FROM per_key k
WHERE NOT EXISTS (SELECT 1 FROM shop_cart c WHERE c.user_id = k.user_id AND c.product_id = k.product_id)
""", **_PER_KEY)
def c01_merge_cart(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.merge_cart(s.cart, I.cart_adds(s), I.AS_OF).tables["cart"]


@reg("c01_merge_cart_outcome", """
SELECT a.seq, a.user_id, a.product_id,
       CASE WHEN EXISTS (SELECT 1 FROM shop_cart c WHERE c.user_id = a.user_id AND c.product_id = a.product_id)
                 OR a.seq <> k.first_seq THEN 'updated' ELSE 'inserted' END AS action
FROM c_adds a JOIN per_key k ON k.user_id = a.user_id AND k.product_id = a.product_id
""", **_PER_KEY)
def c01_merge_cart_outcome(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.merge_cart(s.cart, I.cart_adds(s), I.AS_OF).outcome


# ------------------------------------------------------------------ C2

_EDIT_STATUS = {"edit_status": """
SELECT e.*, c.id IS NOT NULL AND NOT EXISTS (
           SELECT 1 FROM c_edits r
           WHERE ((r.op = 'remove' AND r.id = e.id AND r.user_id = e.user_id)
                  OR (r.op = 'clear' AND r.user_id = e.user_id)) AND r.seq < e.seq) AS ok
FROM c_edits e LEFT JOIN shop_cart c ON c.id = e.id AND c.user_id = e.user_id
WHERE e.op <> 'clear'"""}


@reg("c02_edit_cart", """
SELECT c.id, c.user_id, c.product_id,
       COALESCE((SELECT quantity FROM edit_status s WHERE s.ok AND s.op = 'set_quantity' AND s.id = c.id
                 ORDER BY s.seq DESC LIMIT 1), c.quantity) AS quantity,
       COALESCE((SELECT selected FROM edit_status s WHERE s.ok AND s.op = 'set_selected' AND s.id = c.id
                 ORDER BY s.seq DESC LIMIT 1), c.selected) AS selected,
       c.created_at
FROM shop_cart c
WHERE NOT EXISTS (SELECT 1 FROM c_edits r
                  WHERE (r.op = 'remove' AND r.id = c.id AND r.user_id = c.user_id)
                     OR (r.op = 'clear' AND r.user_id = c.user_id))
""", **_EDIT_STATUS)
def c02_edit_cart(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.edit_cart(s.cart, I.cart_edits(s)).tables["cart"]


@reg("c02_edit_cart_outcome", """
SELECT seq, op, id, user_id, CASE WHEN ok THEN NULL ELSE 'Cart item not found' END AS error FROM edit_status
UNION ALL
SELECT seq, op, id, user_id, CAST(NULL AS VARCHAR) FROM c_edits WHERE op = 'clear'
""", **_EDIT_STATUS)
def c02_edit_cart_outcome(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.edit_cart(s.cart, I.cart_edits(s)).outcome


# ------------------------------------------------------------------ C3

_W_OUT = {"w_out": """
SELECT seq, op, user_id, product_id,
       CASE WHEN op = 'add' AND present_before THEN 'Item already in wishlist'
            WHEN op = 'remove' AND NOT present_before THEN 'Item not found in wishlist' END AS error
FROM (SELECT o.*,
             CASE WHEN lag(o.op) OVER w IS NULL THEN h.user_id IS NOT NULL
                  ELSE lag(o.op) OVER w = 'add' END AS present_before
      FROM c_wops o
      LEFT JOIN (SELECT DISTINCT user_id, product_id FROM shop_wishlist) h
             ON h.user_id = o.user_id AND h.product_id = o.product_id
      WINDOW w AS (PARTITION BY o.user_id, o.product_id ORDER BY o.seq))"""}


@reg("c03_merge_wishlist", f"""
SELECT w.* FROM shop_wishlist w
WHERE NOT EXISTS (SELECT 1 FROM w_out s WHERE s.user_id = w.user_id AND s.product_id = w.product_id
                  AND s.op = 'remove' AND s.error IS NULL)
UNION ALL
SELECT (SELECT MAX(id) + 1 FROM shop_wishlist) + a.add_seq, a.user_id, a.product_id, {AS}
FROM (SELECT user_id, product_id, MAX(seq) FILTER (WHERE op = 'add' AND error IS NULL) AS add_seq,
             arg_max(op, seq) AS last_op
      FROM w_out GROUP BY user_id, product_id) a
WHERE a.last_op = 'add' AND a.add_seq IS NOT NULL
""", **_W_OUT)
def c03_merge_wishlist(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.merge_wishlist(s.wishlist, I.wishlist_ops(s), I.AS_OF).tables["wishlist"]


@reg("c03_merge_wishlist_outcome", "SELECT * FROM w_out", **_W_OUT)
def c03_merge_wishlist_outcome(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.merge_wishlist(s.wishlist, I.wishlist_ops(s), I.AS_OF).outcome


# ------------------------------------------------------------------ C4

_REQ_OUT = {"req_out": """
SELECT r.*,
       CASE WHEN r.payment_method IS NULL OR r.payment_method NOT IN ('cod', 'online') THEN 'Invalid payment method'
            WHEN EXISTS (SELECT 1 FROM c_lines l WHERE l.seq = r.seq
                         AND NOT EXISTS (SELECT 1 FROM shop_products p WHERE p.id = l.product_id))
            THEN 'Product not found' END AS error
FROM c_req r"""}


def _ingest(s):
    req, lines = I.order_requests(s)
    return C.ingest_orders(s.orders, s.order_items, s.products, s.cart, req, lines, I.AS_OF)


@reg("c04_ingest_orders_outcome", """
SELECT seq, user_id, payment_method, error,
       CASE WHEN error IS NULL THEN (SELECT MAX(id) + 1 FROM shop_orders) + seq END AS order_id,
       CASE WHEN error IS NULL THEN CASE WHEN payment_method = 'cod' THEN 'pending' ELSE 'pending_payment' END
       END AS status
FROM req_out
""", **_REQ_OUT)
def c04_ingest_orders_outcome(spark, sf_dir):
    return _ingest(Shop.of(spark, sf_dir)).outcome


@reg("c04_ingest_orders_stock", """
SELECT p.* REPLACE (CASE WHEN u.units IS NULL THEN p.stock_quantity
                         ELSE CAST(p.stock_quantity - u.units AS INTEGER) END AS stock_quantity)
FROM shop_products p
LEFT JOIN (SELECT l.product_id, SUM(l.quantity) AS units
           FROM c_lines l JOIN req_out r ON r.seq = l.seq
           WHERE r.error IS NULL AND r.payment_method = 'cod' GROUP BY l.product_id) u ON u.product_id = p.id
""", **_REQ_OUT)
def c04_ingest_orders_stock(spark, sf_dir):
    return _ingest(Shop.of(spark, sf_dir)).tables["products"]


@reg("c04_ingest_orders_cart", """
SELECT * FROM shop_cart
WHERE user_id NOT IN (SELECT user_id FROM req_out WHERE error IS NULL AND payment_method = 'cod')
""", **_REQ_OUT)
def c04_ingest_orders_cart(spark, sf_dir):
    return _ingest(Shop.of(spark, sf_dir)).tables["cart"]


@reg("c04_ingest_orders_orders", f"""
SELECT * FROM shop_orders
UNION ALL
SELECT (SELECT MAX(id) + 1 FROM shop_orders) + seq, user_id, COALESCE(total_amount, CAST(0 AS DECIMAL(10,2))),
       CASE WHEN payment_method = 'cod' THEN 'pending' ELSE 'pending_payment' END, {AS},
       payment_method, payment_method, payment_method <> 'cod'
FROM req_out WHERE error IS NULL
""", **_REQ_OUT)
def c04_ingest_orders_orders(spark, sf_dir):
    return _ingest(Shop.of(spark, sf_dir)).tables["orders"]


@reg("c04_ingest_orders_items", """
SELECT * FROM shop_order_items
UNION ALL
SELECT (SELECT MAX(id) + 1 FROM shop_orders) + l.seq, l.product_id, l.quantity, p.price
FROM c_lines l JOIN req_out r ON r.seq = l.seq JOIN shop_products p ON p.id = l.product_id
WHERE r.error IS NULL
""", **_REQ_OUT)
def c04_ingest_orders_items(spark, sf_dir):
    return _ingest(Shop.of(spark, sf_dir)).tables["order_items"]


@reg("c04_ingest_orders_shipping", """
SELECT id, user_id, NULL AS shipping_full_name, NULL AS shipping_city FROM shop_orders
UNION ALL
SELECT (SELECT MAX(id) + 1 FROM shop_orders) + r.seq, r.user_id, c.c_name, c.c_mktsegment
FROM c_req r LEFT JOIN customer c ON c.c_custkey = r.user_id
WHERE r.payment_method IN ('cod', 'online')
""")
def c04_ingest_orders_shipping(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    req, lines = I.shipped_order_requests(s)
    columns = ("shipping_full_name", "shipping_city")
    orders = s.orders.withColumns({c: F.lit(None).cast("string") for c in columns})
    got = C.ingest_orders(orders, s.order_items, s.products, s.cart, req, lines, I.AS_OF)
    return got.tables["orders"].select("id", "user_id", *columns)


# ------------------------------------------------------------------ C5 / C6

def _first_ok(src: str) -> str:
    return f"""
SELECT p.*, CASE WHEN o.id IS NOT NULL AND p.seq = MIN(CASE WHEN o.id IS NOT NULL THEN p.seq END)
                                                      OVER (PARTITION BY p.order_id)
                 THEN NULL ELSE 'Order not found or not a temporary order' END AS error
FROM {src} p
LEFT JOIN shop_orders o ON o.id = p.order_id AND o.user_id = p.user_id AND o.is_temporary = true"""


_PAY = {"pay_out": _first_ok("c_pay")}


def _confirm(s):
    return C.confirm_payments(s.orders, s.order_items, s.products, s.cart, I.payments(s))


@reg("c05_confirm_payments_outcome", "SELECT seq, order_id, user_id, payment_id, error FROM pay_out", **_PAY)
def c05_confirm_payments_outcome(spark, sf_dir):
    return _confirm(Shop.of(spark, sf_dir)).outcome


@reg("c05_confirm_payments_orders", """
SELECT o.* REPLACE (
         CASE WHEN w.order_id IS NOT NULL THEN 'confirmed' ELSE o.status END AS status,
         CASE WHEN w.order_id IS NOT NULL THEN 'online' ELSE o.payment_method END AS payment_method,
         CASE WHEN w.order_id IS NOT NULL THEN 'online' ELSE o.payment_method_type END AS payment_method_type,
         CASE WHEN w.order_id IS NOT NULL THEN false ELSE o.is_temporary END AS is_temporary),
       CASE WHEN w.order_id IS NOT NULL THEN 'paid' END AS payment_status,
       w.payment_id AS payment_id
FROM shop_orders o LEFT JOIN (SELECT * FROM pay_out WHERE error IS NULL) w ON w.order_id = o.id
""", **_PAY)
def c05_confirm_payments_orders(spark, sf_dir):
    return _confirm(Shop.of(spark, sf_dir)).tables["orders"]


@reg("c05_confirm_payments_stock", """
SELECT p.* REPLACE (CASE WHEN u.units IS NULL THEN p.stock_quantity
                         ELSE CAST(p.stock_quantity - u.units AS INTEGER) END AS stock_quantity)
FROM shop_products p
LEFT JOIN (SELECT oi.product_id, SUM(oi.quantity) AS units FROM shop_order_items oi
           WHERE oi.order_id IN (SELECT order_id FROM pay_out WHERE error IS NULL)
           GROUP BY oi.product_id) u ON u.product_id = p.id
""", **_PAY)
def c05_confirm_payments_stock(spark, sf_dir):
    return _confirm(Shop.of(spark, sf_dir)).tables["products"]


@reg("c05_confirm_payments_cart", """
SELECT * FROM shop_cart WHERE user_id NOT IN (SELECT user_id FROM pay_out WHERE error IS NULL)
""", **_PAY)
def c05_confirm_payments_cart(spark, sf_dir):
    return _confirm(Shop.of(spark, sf_dir)).tables["cart"]


_CAN = {"cancel_out": _first_ok("c_cancel")}


@reg("c06_cancel_temporary_outcome", "SELECT seq, order_id, user_id, error FROM cancel_out", **_CAN)
def c06_cancel_temporary_outcome(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.cancel_temporary(s.orders, s.order_items, I.cancels(s)).outcome


@reg("c06_cancel_temporary_orders", """
SELECT * FROM shop_orders WHERE id NOT IN (SELECT order_id FROM cancel_out WHERE error IS NULL)
""", **_CAN)
def c06_cancel_temporary_orders(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.cancel_temporary(s.orders, s.order_items, I.cancels(s)).tables["orders"]


@reg("c06_cancel_temporary_items", """
SELECT * FROM shop_order_items WHERE order_id NOT IN (SELECT order_id FROM cancel_out WHERE error IS NULL)
""", **_CAN)
def c06_cancel_temporary_items(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.cancel_temporary(s.orders, s.order_items, I.cancels(s)).tables["order_items"]


@reg("c06_purge_stale_orders", f"""
SELECT * FROM shop_orders
WHERE id NOT IN (SELECT id FROM shop_orders WHERE is_temporary = true AND created_at < TIMESTAMP '{I.STALE_BEFORE}')
""")
def c06_purge_stale_orders(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.purge_stale(s.orders, s.order_items, I.STALE_BEFORE).tables["orders"]


# ------------------------------------------------------------------ C7

_ST = {"status_out": """
SELECT s.seq, s.order_id, s.status,
       CASE WHEN s.status NOT IN ('pending', 'processing', 'shipped', 'delivered', 'cancelled') THEN 'Invalid status'
            WHEN NOT EXISTS (SELECT 1 FROM shop_orders o WHERE o.id = s.order_id) THEN 'Order not found' END AS error
FROM c_status s"""}


@reg("c07_change_order_status_outcome", "SELECT * FROM status_out", **_ST)
def c07_change_order_status_outcome(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.change_order_status(s.orders, I.status_changes(s), I.AS_OF).outcome


@reg("c07_change_order_status_orders", f"""
SELECT o.* REPLACE (COALESCE(w.status, o.status) AS status),
       CASE WHEN w.order_id IS NOT NULL THEN {AS} END AS updated_at
FROM shop_orders o
LEFT JOIN (SELECT order_id, arg_max(status, seq) AS status FROM status_out WHERE error IS NULL
           GROUP BY order_id) w ON w.order_id = o.id
""", **_ST)
def c07_change_order_status_orders(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.change_order_status(s.orders, I.status_changes(s), I.AS_OF).tables["orders"]


# ------------------------------------------------------------------ C8

_ALLOC = {**QP._lines(QP._INTENDED), "alloc": QP._q17("total_amount")}


def _apply(s):
    alloc = promotions.coupon_allocation(quote_carts(s), s.coupons, s.coupon_products, s.products, QUOTE_AS_OF)
    return C.apply_coupons(s.cart, s.coupons, alloc)


@reg("c08_apply_coupons_cart", """
SELECT c.*, CASE WHEN a.cart_id IS NOT NULL THEN CAST(a.line_discount AS DECIMAL(12,4)) END AS discount_amount
FROM shop_cart c
LEFT JOIN (SELECT * FROM alloc WHERE valid) a ON a.cart_id = c.user_id AND a.product_id = c.product_id
""", **_ALLOC)
def c08_apply_coupons_cart(spark, sf_dir):
    return _apply(Shop.of(spark, sf_dir)).tables["cart"]


@reg("c08_apply_coupons_coupons", """
SELECT c.* REPLACE (CAST(COALESCE(c.times_used, 0) + COALESCE(u.n, 0) AS INTEGER) AS times_used)
FROM shop_coupons c
LEFT JOIN (SELECT coupon_id, COUNT(*) AS n
           FROM (SELECT DISTINCT coupon_id, cart_id, code FROM alloc WHERE valid) GROUP BY coupon_id) u
       ON u.coupon_id = c.id
""", **_ALLOC)
def c08_apply_coupons_coupons(spark, sf_dir):
    return _apply(Shop.of(spark, sf_dir)).tables["coupons"]


# ------------------------------------------------------------------ C9

@reg("c09_patch_products", f"""
SELECT p.* REPLACE (COALESCE(x.name, p.name) AS name, COALESCE(x.description, p.description) AS description,
                    COALESCE(x.price, p.price) AS price,
                    CASE WHEN x.id IS NOT NULL THEN x.offer_percentage ELSE p.offer_percentage END
                      AS offer_percentage),
       CASE WHEN x.id IS NOT NULL THEN {AS} END AS updated_at
FROM shop_products p LEFT JOIN c_patch x ON x.id = p.id
""")
def c09_patch_products(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.patch_rows(s.products, I.product_patches(s), ["name", "description", "price"],
                        ["offer_percentage"], I.AS_OF).tables["table"]


_COUPON_PATCH = {"c_cpatch": """
SELECT id AS seq, id + 3 AS id, CASE WHEN id % 2 = 0 THEN 'about ' || CAST(id AS VARCHAR) END AS description,
       CASE WHEN id % 3 = 0 THEN false END AS is_active
FROM shop_coupons"""}


def _patch_coupons(s):
    return C.patch_rows(s.coupons, I.coupon_patches(s), ["description", "is_active"], [], I.AS_OF, stamp=None,
                        missing="Coupon not found")


@reg("c09_patch_coupons", """
SELECT c.* REPLACE (COALESCE(x.description, c.description) AS description,
                    COALESCE(x.is_active, c.is_active) AS is_active)
FROM shop_coupons c LEFT JOIN c_cpatch x ON x.id = c.id
""", **_COUPON_PATCH)
def c09_patch_coupons(spark, sf_dir):
    return _patch_coupons(Shop.of(spark, sf_dir)).tables["table"]


@reg("c09_patch_coupons_outcome", """
SELECT seq, id, CASE WHEN id NOT IN (SELECT id FROM shop_coupons) THEN 'Coupon not found' END AS error FROM c_cpatch
""", **_COUPON_PATCH)
def c09_patch_coupons_outcome(spark, sf_dir):
    return _patch_coupons(Shop.of(spark, sf_dir)).outcome


_PROFILE = {"c_profile": """
SELECT c_custkey AS seq, c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'New ' || c_name END AS name,
       CASE WHEN c_custkey % 3 = 1 THEN 'x' || CAST(c_custkey AS VARCHAR) || '@example.org' END AS email,
       CASE WHEN c_custkey % 3 = 2 THEN '5550000000' END AS phone
FROM customer WHERE c_custkey % 4 = 0"""}


@reg("c09_patch_profile", f"""
SELECT u.* REPLACE (COALESCE(x.name, u.name) AS name, COALESCE(x.email, u.email) AS email, COALESCE(x.phone, u.phone) AS phone),
       CASE WHEN x.id IS NOT NULL THEN {AS} END AS updated_at
FROM shop_users u LEFT JOIN c_profile x ON x.id = u.id
""", **_PROFILE)
def c09_patch_profile(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.patch_rows(s.users, I.profile_patches(s), ["name", "email", "phone"], [], I.AS_OF).tables["table"]


_ADDRESS = {"c_apatch": f"""
SELECT o_orderkey AS seq, o_orderkey AS id, o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS user_id,
       CASE WHEN o_orderkey % 3 <> 1 THEN 'New City ' || CAST(o_orderkey % 4 AS VARCHAR) END AS city,
       CASE WHEN o_orderkey % 2 = 0 THEN '5550000000' END AS phone_number,
       CASE WHEN o_orderkey % 4 <> 0 THEN 'Unit ' || CAST(o_orderkey % 7 AS VARCHAR) END AS address_line2,
       CASE WHEN o_orderkey % 6 = 0 THEN true END AS is_default
FROM orders
UNION ALL
SELECT o_orderkey + {I.SECOND_BATCH}, o_orderkey, o_custkey, CASE WHEN o_orderkey % 12 = 0 THEN 'Old Town' END, NULL,
       CASE WHEN o_orderkey % 2 = 1 THEN 'Back door' END, CASE WHEN o_orderkey % 9 = 0 THEN false END
FROM orders WHERE o_orderkey % 3 = 0""", "c_afold": """
SELECT x.id, arg_max(x.city, x.seq) FILTER (x.city IS NOT NULL) AS city,
       arg_max(x.phone_number, x.seq) FILTER (x.phone_number IS NOT NULL) AS phone_number,
       arg_max(x.is_default, x.seq) FILTER (x.is_default IS NOT NULL) AS is_default,
       list(x.address_line2 ORDER BY x.seq)[-1] AS address_line2
FROM c_apatch x SEMI JOIN shop_addresses a ON a.id = x.id AND a.user_id = x.user_id
GROUP BY x.id"""}


def _patch_addresses(s):
    return C.patch_rows(s.addresses, I.address_patches(s), ["city", "phone_number", "is_default"], ["address_line2"],
                        I.AS_OF, stamp=None, missing="Address not found or unauthorized", owner="user_id")


@reg("c09_patch_addresses", """
SELECT a.* REPLACE (COALESCE(f.city, a.city) AS city, COALESCE(f.phone_number, a.phone_number) AS phone_number,
                    COALESCE(f.is_default, a.is_default) AS is_default,
                    CASE WHEN f.id IS NULL THEN a.address_line2 ELSE f.address_line2 END AS address_line2)
FROM shop_addresses a LEFT JOIN c_afold f ON f.id = a.id
""", **_ADDRESS)
def c09_patch_addresses(spark, sf_dir):
    return _patch_addresses(Shop.of(spark, sf_dir)).tables["table"]


@reg("c09_patch_addresses_outcome", """
SELECT x.seq, x.id, CASE WHEN a.id IS NULL THEN 'Address not found or unauthorized' END AS error
FROM c_apatch x LEFT JOIN shop_addresses a ON a.id = x.id AND a.user_id = x.user_id
""", **_ADDRESS)
def c09_patch_addresses_outcome(spark, sf_dir):
    return _patch_addresses(Shop.of(spark, sf_dir)).outcome


# ------------------------------------------------------------------ C10

_PROWS = {"prow_out": f"""
SELECT *, CASE WHEN name IS NULL OR name = '' OR price IS NULL OR price = ''
                    OR category_id IS NULL OR category_id = '' THEN 'Name, price, and category are required'
               WHEN cat IS NULL THEN 'Invalid category ID format'
               WHEN cat NOT IN (SELECT id FROM shop_categories) THEN 'Invalid category ID'
               WHEN pr IS NULL THEN 'Invalid price format'
               WHEN st IS NULL THEN 'Invalid stock quantity format'
               WHEN off IS NULL OR off < 0 OR off > 100 THEN 'Invalid offer percentage. Must be between 0 and 100'
               WHEN TRY_CAST(pr AS DECIMAL(10,2)) IS NULL THEN 'Price out of range'
               WHEN TRY_CAST(st AS INTEGER) IS NULL THEN 'Stock quantity out of range'
          END AS error
FROM (SELECT x.*,
             TRY_CAST(NULLIF(regexp_extract(category_id, '{_INT}', 1), '') AS BIGINT) AS cat,
             TRY_CAST(NULLIF(regexp_extract(price, '{_NUM}', 1), '') AS DOUBLE) AS pr,
             TRY_CAST(NULLIF(regexp_extract(CASE WHEN stock_quantity IS NULL OR stock_quantity = '' THEN '0'
                                                 ELSE stock_quantity END, '{_INT}', 1), '') AS BIGINT) AS st,
             TRY_CAST(NULLIF(regexp_extract(CASE WHEN offer_percentage IS NULL OR offer_percentage = '' THEN '0'
                                                 ELSE offer_percentage END, '{_INT}', 1), '') AS BIGINT) AS off
      FROM c_prows x)"""}


@reg("c10_add_products_outcome", """
SELECT seq, name, error, CASE WHEN error IS NULL THEN (SELECT MAX(id) + 1 FROM shop_products) + seq END AS product_id
FROM prow_out
""", **_PROWS)
def c10_add_products_outcome(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.add_products(s.products, s.categories, I.product_rows(s), I.AS_OF).outcome


@reg("c10_add_products_products", f"""
SELECT * FROM shop_products
UNION ALL
SELECT (SELECT MAX(id) + 1 FROM shop_products) + r.seq, r.name, COALESCE(r.description, ''),
       CAST(r.pr AS DECIMAL(10,2)), c.name, NULL, r.cat, CAST(r.st AS INTEGER), {AS}, CAST(r.off AS INTEGER),
       NULL, NULL, NULL
FROM prow_out r JOIN shop_categories c ON c.id = r.cat
WHERE r.error IS NULL
""", **_PROWS)
def c10_add_products_products(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.add_products(s.products, s.categories, I.product_rows(s), I.AS_OF).tables["products"]


@reg("c10_add_products_details", """
SELECT id, NULL AS size, NULL AS benefits, NULL AS image_url FROM shop_products
UNION ALL
SELECT (SELECT MAX(id) + 1 FROM shop_products) + r.seq,
       CASE WHEN p.p_partkey % 3 <> 0 THEN CAST(p.p_size AS VARCHAR) END, p.p_type, '/uploads/' || p.p_name
FROM prow_out r JOIN part p ON p.p_partkey = r.seq
WHERE r.error IS NULL
""", **_PROWS)
def c10_add_products_details(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    products = s.products.withColumns({c: F.lit(None).cast("string") for c in C.PRODUCT_EXTRAS})
    got = C.add_products(products, s.categories, I.detailed_product_rows(s), I.AS_OF)
    return got.tables["products"].select("id", "size", "benefits", "image_url")


# ------------------------------------------------------------------ C11

_RV = {"rv_out": """
SELECT r.*,
       CASE WHEN NOT EXISTS (SELECT 1 FROM shop_products p WHERE p.id = r.product_id) THEN 'Product not found'
            WHEN EXISTS (SELECT 1 FROM shop_reviews x WHERE x.user_id = r.user_id AND x.product_id = r.product_id)
              OR EXISTS (SELECT 1 FROM c_rrows y WHERE y.user_id = r.user_id AND y.product_id = r.product_id
                         AND y.rating BETWEEN 1 AND 5 AND y.seq < r.seq)
            THEN 'You have already reviewed this product'
            WHEN r.rating IS NULL OR r.rating < 1 OR r.rating > 5 THEN 'Rating must be between 1 and 5' END AS error
FROM c_rrows r"""}


@reg("c11_add_reviews_outcome", "SELECT seq, user_id, product_id, error FROM rv_out", **_RV)
def c11_add_reviews_outcome(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.add_reviews(s.reviews, s.products, I.review_rows(s), I.AS_OF).outcome


@reg("c11_add_reviews_reviews", f"""
SELECT * FROM shop_reviews
UNION ALL
SELECT (SELECT MAX(id) + 1 FROM shop_reviews) + seq, product_id, user_id, rating, comment, {AS}
FROM rv_out WHERE error IS NULL
""", **_RV)
def c11_add_reviews_reviews(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.add_reviews(s.reviews, s.products, I.review_rows(s), I.AS_OF).tables["reviews"]


# Sequential add/update/delete per user; the oracle is the plain per-user fold as a
# recursive CTE (the Spark job composes transitions of a slot instead).
_BROWS = {"c_brows": """
SELECT e.event_id AS seq,
       CASE e.event_id % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'update' ELSE 'delete' END AS op,
       e.user_id,
       CASE WHEN e.event_id % 3 <> 2 THEN e.event_id WHEN e.event_id % 2 = 0 THEN COALESCE(b.id, e.event_id)
            ELSE COALESCE((SELECT MAX(id) + 1 FROM shop_brand_reviews) + e.added, e.event_id) END AS id,
       CAST(1 + floor(e.value) % 5 AS INTEGER) AS rating,
       'e' || CAST(e.event_id AS VARCHAR) AS comment
FROM (SELECT *, max(CASE WHEN event_id % 3 = 0 THEN event_id END) OVER (
                 PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS added
      FROM events WHERE event_type = 'error') e
LEFT JOIN shop_brand_reviews b ON b.user_id = e.user_id"""}


_BRAND_FOLD = f"""
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM c_brows),
st AS (
  SELECT u.user_id, CAST(0 AS BIGINT) AS k, b.id IS NOT NULL AS present, b.id AS rid, b.rating, b.comment,
         b.created_at
  FROM (SELECT DISTINCT user_id FROM c_brows) u LEFT JOIN shop_brand_reviews b ON b.user_id = u.user_id
  UNION ALL
  SELECT s.user_id, o.k,
         CASE WHEN o.op = 'add' THEN TRUE
              WHEN o.op = 'delete' AND s.present AND s.rid = o.id THEN FALSE ELSE s.present END,
         CASE WHEN o.op = 'add' AND NOT s.present THEN (SELECT MAX(id) + 1 FROM shop_brand_reviews) + o.seq
              WHEN o.op = 'delete' AND s.present AND s.rid = o.id THEN NULL ELSE s.rid END,
         CASE WHEN (o.op = 'add' AND NOT s.present) OR (o.op = 'update' AND s.present) THEN o.rating
              WHEN o.op = 'delete' AND s.present AND s.rid = o.id THEN NULL ELSE s.rating END,
         CASE WHEN (o.op = 'add' AND NOT s.present) OR (o.op = 'update' AND s.present) THEN o.comment
              WHEN o.op = 'delete' AND s.present AND s.rid = o.id THEN NULL ELSE s.comment END,
         CASE WHEN o.op = 'add' AND NOT s.present THEN {AS}
              WHEN o.op = 'delete' AND s.present AND s.rid = o.id THEN NULL ELSE s.created_at END
  FROM st s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)"""


@reg("c11_brand_review_changes", f"""
WITH RECURSIVE {_BRAND_FOLD}
SELECT * FROM shop_brand_reviews b WHERE NOT EXISTS (SELECT 1 FROM c_brows r WHERE r.user_id = b.user_id)
UNION ALL
SELECT rid AS id, user_id, rating, comment, created_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS r FROM st)
WHERE r = 1 AND present
""", **_BROWS)
def c11_brand_review_changes(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.brand_review_changes(s.brand_reviews, I.brand_review_rows(s), I.AS_OF).tables["brand_reviews"]


@reg("c11_brand_review_outcome", f"""
WITH RECURSIVE {_BRAND_FOLD}
SELECT p.user_id, p.seq,
       CASE WHEN p.op = 'add' AND s.present THEN 'You have already submitted a brand review'
            WHEN p.op = 'update' AND NOT s.present THEN 'Review not found'
            WHEN p.op = 'delete' AND NOT (s.present AND s.rid = p.id)
              THEN 'Review not found or you do not have permission to delete it' END AS error
FROM o p JOIN st s ON s.user_id = p.user_id AND s.k = p.k - 1
""", **_BROWS)
def c11_brand_review_outcome(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.brand_review_changes(s.brand_reviews, I.brand_review_rows(s), I.AS_OF).outcome


# ------------------------------------------------------------------ C12 / C13

#: The rows one by one: a list of who holds which name goes from step to step.
_CAT = {"cat_steps": "SELECT *, row_number() OVER (ORDER BY seq) AS k FROM c_cats",
        "cat_fold": f"""
SELECT CAST(0 AS BIGINT) AS k, list({{'holder': id, 'held': lower(name)}}) AS names, CAST(NULL AS VARCHAR) AS error
FROM shop_categories
UNION ALL
SELECT o.k, CASE WHEN e.error IS NULL AND o.name IS NOT NULL
                 THEN list_append(list_filter(f.names, lambda x: x.holder <> e.who), {{'holder': e.who, 'held': lower(o.name)}})
                 ELSE f.names END, e.error
FROM cat_fold f JOIN cat_steps o ON o.k = f.k + 1,
LATERAL (SELECT coalesce(o.id, -1 - o.seq) AS who,
                CASE WHEN len(list_filter(f.names, lambda x: x.held = lower(o.name) AND x.holder <> coalesce(o.id, -1 - o.seq))) > 0
                       THEN '{C.NAME_TAKEN}'
                     WHEN o.id IS NOT NULL AND o.id NOT IN (SELECT id FROM shop_categories) THEN '{C.NO_CATEGORY}' END AS error) e""",
        "cat_out": "SELECT o.*, f.error FROM cat_steps o JOIN cat_fold f USING (k)",
        "cat_last": """
SELECT id, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(description, seq) AS description,
       max({'seq': seq, 'parent': parent_id}).parent AS parent_id
FROM cat_out WHERE error IS NULL AND id IS NOT NULL GROUP BY id"""}


@reg("c12_upsert_categories_outcome", "SELECT seq, id, name, error FROM cat_out", **_CAT)
def c12_upsert_categories_outcome(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.upsert_categories(s.categories, I.category_rows(s), I.AS_OF).outcome


@reg("c12_upsert_categories", f"""
SELECT c.id, COALESCE(u.name, c.name) AS name, COALESCE(u.description, c.description) AS description,
       CASE WHEN u.id IS NOT NULL THEN u.parent_id ELSE c.parent_id END AS parent_id, c.created_at
FROM shop_categories c LEFT JOIN cat_last u ON u.id = c.id
UNION ALL
SELECT (SELECT MAX(id) + 1 FROM shop_categories) + seq, name, description, parent_id, {AS}
FROM cat_out WHERE error IS NULL AND id IS NULL
""", **_CAT)
def c12_upsert_categories(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.upsert_categories(s.categories, I.category_rows(s), I.AS_OF).tables["categories"]


#: Each id is deleted once here and the categories have two levels, so leaves are settled first, then their parents.
_CDEL = {"free": """
SELECT d.seq, d.id FROM c_cdel d JOIN shop_categories c ON c.id = d.id
WHERE d.id NOT IN (SELECT category_id FROM c_cprod WHERE category_id IS NOT NULL)""",
         "leaves": "SELECT * FROM free WHERE id NOT IN (SELECT parent_id FROM shop_categories WHERE parent_id IS NOT NULL)",
         "went": """
SELECT * FROM leaves
UNION ALL
SELECT p.seq, p.id FROM free p WHERE p.id IN (SELECT parent_id FROM shop_categories)
  AND NOT EXISTS (SELECT 1 FROM shop_categories c LEFT JOIN leaves l ON l.id = c.id
                  WHERE c.parent_id = p.id AND (l.seq IS NULL OR l.seq > p.seq))""",
         "cdel_out": f"""
SELECT d.seq, d.id,
       CASE WHEN EXISTS (SELECT 1 FROM shop_categories c LEFT JOIN went w ON w.id = c.id
                         WHERE c.parent_id = d.id AND (w.seq IS NULL OR w.seq > d.seq)) THEN '{C.HAS_CHILDREN}'
            WHEN EXISTS (SELECT 1 FROM c_cprod p WHERE p.category_id = d.id) THEN '{C.HAS_PRODUCTS}'
            WHEN d.id NOT IN (SELECT id FROM went) THEN '{C.NO_CATEGORY}' END AS error
FROM c_cdel d"""}


@reg("c13_delete_categories_outcome", "SELECT * FROM cdel_out", **_CDEL)
def c13_delete_categories_outcome(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.delete_categories(s.categories, I.category_products(s), I.category_deletes(s)).outcome


@reg("c13_delete_categories", """
SELECT * FROM shop_categories WHERE id NOT IN (SELECT id FROM cdel_out WHERE error IS NULL)
""", **_CDEL)
def c13_delete_categories(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.delete_categories(s.categories, I.category_products(s), I.category_deletes(s)).tables["categories"]


# ------------------------------------------------------------------ C14

@reg("c14_replace_coupon_products", """
SELECT * FROM shop_coupon_products WHERE coupon_id NOT IN (SELECT coupon_id FROM c_sets)
UNION ALL
SELECT (SELECT MAX(id) + 1 FROM shop_coupon_products) + MIN(seq), coupon_id, product_id
FROM c_sets s
WHERE set_id = (SELECT MAX(set_id) FROM c_sets t WHERE t.coupon_id = s.coupon_id) AND product_id IS NOT NULL
GROUP BY coupon_id, product_id
""")
def c14_replace_coupon_products(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.replace_coupon_products(s.coupon_products, I.coupon_sets(s)).tables["coupon_products"]


@reg("c14_create_coupons_outcome", """
SELECT r.seq, r.code,
       CASE WHEN EXISTS (SELECT 1 FROM shop_coupons c WHERE upper(c.code) = upper(r.code))
              OR EXISTS (SELECT 1 FROM c_ccreate y WHERE upper(y.code) = upper(r.code) AND y.seq < r.seq)
            THEN 'Coupon code already exists' END AS error
FROM c_ccreate r
""")
def c14_create_coupons_outcome(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.create_coupons(s.coupons, I.coupon_creates(s), I.AS_OF).outcome


def _create_coupons(s):
    return C.create_coupons(s.coupons, I.coupon_creates(s), I.AS_OF, s.coupon_products, I.coupon_links(s))


_NEW_COUPONS = {"c_new": """
SELECT (SELECT MAX(id) + 1 FROM shop_coupons) + r.seq AS id, upper(r.code) AS code, r.seq
FROM c_ccreate r
WHERE NOT EXISTS (SELECT 1 FROM shop_coupons c WHERE upper(c.code) = upper(r.code))
  AND NOT EXISTS (SELECT 1 FROM c_ccreate y WHERE upper(y.code) = upper(r.code) AND y.seq < r.seq)"""}


@reg("c14_create_coupons", """
SELECT id, code FROM shop_coupons UNION ALL SELECT id, code FROM c_new
""", **_NEW_COUPONS)
def c14_create_coupons(spark, sf_dir):
    return _create_coupons(Shop.of(spark, sf_dir)).tables["coupons"].select("id", "code")


@reg("c14_create_coupons_links", """
SELECT id, coupon_id, product_id FROM shop_coupon_products
UNION ALL
SELECT (SELECT MAX(id) + 1 FROM shop_coupon_products) + p.p_partkey, n.id, p.p_partkey
FROM part p JOIN c_new n ON n.seq = p.p_partkey % 5
""", **_NEW_COUPONS)
def c14_create_coupons_links(spark, sf_dir):
    return _create_coupons(Shop.of(spark, sf_dir)).tables["coupon_products"].select("id", "coupon_id", "product_id")


# ------------------------------------------------------------------ C15

def _cascade_users(s):
    tables = {n: s.table(n) for n in ("users", "orders", "order_items", "cart", "wishlist", "addresses",
                                      "reviews", "brand_reviews")}
    admins = s.users.filter(F.col("role") == "admin").select("id")
    return C.cascade_delete(tables, "users", admins)


_ADMINS = "(SELECT id FROM shop_users WHERE role = 'admin')"


@register("c15_cascade_users_orders", oracle=f"SELECT * FROM shop_orders WHERE user_id NOT IN {_ADMINS}")
def c15_cascade_users_orders(spark, sf_dir):
    return _cascade_users(Shop.of(spark, sf_dir)).tables["orders"]


@register("c15_cascade_users_order_items", oracle=f"""
SELECT * FROM shop_order_items
WHERE order_id NOT IN (SELECT id FROM shop_orders WHERE user_id IN {_ADMINS})
""")
def c15_cascade_users_order_items(spark, sf_dir):
    return _cascade_users(Shop.of(spark, sf_dir)).tables["order_items"]


@register("c15_cascade_users_cart", oracle=f"SELECT * FROM shop_cart WHERE user_id NOT IN {_ADMINS}")
def c15_cascade_users_cart(spark, sf_dir):
    return _cascade_users(Shop.of(spark, sf_dir)).tables["cart"]


@register("c15_cascade_regions_categories", oracle="""
SELECT c.* REPLACE (CASE WHEN c.parent_id BETWEEN 100 AND 104 THEN NULL ELSE c.parent_id END AS parent_id)
FROM shop_categories c WHERE c.id NOT BETWEEN 100 AND 104
""")
def c15_cascade_regions_categories(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    regions = s.raw.region.select((F.col("r_regionkey") + 100).cast("long").alias("id"))
    return C.cascade_delete({"categories": s.categories, "products": s.products}, "categories",
                            regions).tables["categories"]


# ------------------------------------------------------------------ C16

_ADDR = {
    "a_out": "SELECT c.*, (SELECT MAX(id) + 1 FROM shop_addresses) + c.seq AS new_id FROM c_addr c WHERE op = 'add'",
    "s_out": """
SELECT c.*, EXISTS (SELECT 1 FROM shop_addresses a WHERE a.id = c.id AND a.user_id = c.user_id) AS found
FROM c_addr c WHERE op = 'set_default'""",
    "winner": """
SELECT user_id, arg_max(did, seq) AS did
FROM (SELECT user_id, seq, new_id AS did FROM a_out x
      WHERE COALESCE(is_default, false)
         OR (NOT EXISTS (SELECT 1 FROM shop_addresses a WHERE a.user_id = x.user_id)
             AND seq = (SELECT MIN(seq) FROM a_out y WHERE y.user_id = x.user_id))
      UNION ALL
      SELECT user_id, seq, id FROM s_out WHERE found)
GROUP BY user_id""",
}


@reg("c16_default_address", f"""
SELECT r.* REPLACE (CASE WHEN w.user_id IS NOT NULL THEN r.id = w.did ELSE r.is_default END AS is_default)
FROM (SELECT * FROM shop_addresses
      UNION ALL
      SELECT new_id, user_id, address_line1, NULL, NULL, NULL, NULL, false, {AS} FROM a_out) r
LEFT JOIN winner w ON w.user_id = r.user_id
""", **_ADDR)
def c16_default_address(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.enforce_default_address(s.addresses, I.address_changes(s), I.AS_OF).tables["addresses"]


@reg("c16_default_address_outcome", """
SELECT seq, op, user_id, new_id AS id, CAST(NULL AS VARCHAR) AS error FROM a_out
UNION ALL
SELECT seq, op, user_id, id, CASE WHEN found THEN NULL ELSE 'Address not found' END FROM s_out
""", **_ADDR)
def c16_default_address_outcome(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return C.enforce_default_address(s.addresses, I.address_changes(s), I.AS_OF).outcome
