"""Registered queries: nested results as JSON text, documents as lines, declared types, the database copy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, migrate, orders, people, promotions
from ..sources import documents, schemas
from ..sources.fixtures import Shop
from .registry import register


def _text(c: str) -> str:
    return f"coalesce(CAST(to_json({c}) AS VARCHAR), 'null')"


def _plain(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'null')"


def _time(c: str) -> str:
    return f"coalesce('\"' || strftime({c}, '%Y-%m-%dT%H:%M:%S.%g') || '\"', 'null')"


def _object(fields: dict[str, str]) -> str:
    """SQL of a JSON object: field name -> SQL of its value's JSON."""
    return "'{' || " + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in fields.items()) + " || '}'"


def _array(value: str, order: str) -> str:
    return f"'[' || string_agg({value}, ',' ORDER BY {order}) || ']'"


def _json(column: str):
    return F.to_json(column, {"ignoreNullFields": "false"}).alias(column)


@register("q02_product_detail_json", oracle=f"""
SELECT p.id, coalesce((SELECT {_array(_object({
    "id": _plain("r.id"), "rating": _plain("r.rating"), "comment": _text("r.comment"),
    "created_at": _time("r.created_at"), "user_id": _plain("r.user_id")}), "r.id")}
  FROM shop_reviews r WHERE r.product_id = p.id), '[]') AS reviews
FROM shop_products p
""")
def q02_product_detail_json(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return catalog.product_detail(s.products, s.categories, s.reviews, nested=True, as_json=True).select("id", "reviews")


_NAMED = """
SELECT oi.order_id, oi.product_id, oi.quantity, oi.price_at_time,
       (SELECT p.name FROM shop_products p WHERE p.id = oi.product_id) AS product_name
FROM shop_order_items oi
"""
_Q7_ITEM = {"product_id": _plain("l.product_id"), "quantity": _plain("l.quantity"),
            "price_at_time": _plain("l.price_at_time"), "product_name": _text("l.product_name")}
_ITEM = {"product_id": _plain("l.product_id"), "product_name": _text("l.product_name"),
         "quantity": _plain("l.quantity"), "price_at_time": _plain("l.price_at_time")}


def _by(fields) -> str:
    return ", ".join(f"l.{f} NULLS FIRST" for f in fields)


@register("q07_order_history_nested", ctes={"named": _NAMED}, oracle=f"""
SELECT o.id, o.user_id, {_array(_object(_Q7_ITEM), _by(_Q7_ITEM))} AS items
FROM shop_orders o LEFT JOIN named l ON l.order_id = o.id
WHERE o.is_temporary IS NOT TRUE GROUP BY o.id, o.user_id
""")
def q07_order_history_nested(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return orders.order_history(s.orders, s.order_items, s.products, nested=True).select("id", "user_id", _json("items"))


_TOP = """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS FIRST, id) AS position
FROM shop_orders o WHERE o.id IN (SELECT order_id FROM named WHERE product_name IS NOT NULL)
"""
_TOP_ITEMS = f"""
SELECT t.*, (SELECT {_array(_object(_ITEM), _by(_ITEM))} FROM named l
             WHERE l.order_id = t.id AND l.product_name IS NOT NULL) AS items
FROM top_orders t WHERE t.position <= 5
"""
_RECENT = {"named": _NAMED, "top_orders": _TOP, "recent": _TOP_ITEMS}


@register("q12_recent_orders_nested", ctes=_RECENT, oracle="""
SELECT user_id, CAST(position AS INTEGER) AS position, id, items FROM recent
""")
def q12_recent_orders_nested(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return orders.recent_orders(s.orders, s.order_items, s.products, n=5, nested=True).select(
        "user_id", "position", "id", _json("items"))


_BOUGHT = """
SELECT d.user_id, d.position, p.*
FROM (SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY day DESC NULLS FIRST, product_id) AS position
      FROM (SELECT DISTINCT o.user_id, oi.product_id, o.created_at AS day
            FROM shop_order_items oi JOIN shop_orders o ON o.id = oi.order_id
            WHERE oi.product_id IN (SELECT id FROM shop_products))) d
JOIN shop_products p ON p.id = d.product_id WHERE d.position <= 5
"""
_ORDER_FIELDS = {"position": _plain("r.position"), "id": _plain("r.id"), "total_amount": _plain("r.total_amount"),
                 "status": _text("r.status"), "created_at": _time("r.created_at"),
                 "payment_method": _text("r.payment_method"), "payment_method_type": _text("r.payment_method_type"),
                 "is_temporary": _plain("r.is_temporary"), "items": "r.items"}
_PRODUCT_FIELDS = {
    "position": _plain("r.position"), "id": _plain("r.id"), "name": _text("r.name"), "description": _text("r.description"),
    "price": _plain("r.price"), "category": _text("r.category"), "image_url": _text("r.image_url"),
    "category_id": _plain("r.category_id"), "stock_quantity": _plain("r.stock_quantity"),
    "created_at": _time("r.created_at"), "offer_percentage": _plain("r.offer_percentage"),
    "product_type": _text("r.product_type"), "skin_type": _text("r.skin_type"), "concerns": _text("r.concerns")}


@register("q14_customer_dashboard_nested", ctes={**_RECENT, "bought": _BOUGHT}, oracle=f"""
SELECT u.id, (SELECT COUNT(*) FROM shop_orders o WHERE o.user_id = u.id) AS total_orders,
  (SELECT {_array(_object(_ORDER_FIELDS), "r.position")} FROM recent r WHERE r.user_id = u.id) AS recent_orders,
  (SELECT {_array(_object(_PRODUCT_FIELDS), "r.position")} FROM bought r WHERE r.user_id = u.id) AS recently_viewed
FROM shop_users u
""")
def q14_customer_dashboard_nested(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return people.customer_dashboard(s.users, s.orders, s.order_items, s.products, s.cart, s.wishlist, nested=True).select(
        "id", "total_orders", _json("recent_orders"), _json("recently_viewed"))


@register("q15_coupon_catalog_nested", oracle=f"""
SELECT c.id, c.code,
  coalesce((SELECT {_array("CAST(x.v AS VARCHAR)", "x.v")} FROM (SELECT DISTINCT p.id AS v FROM shop_coupon_products cp
     JOIN shop_products p ON p.id = cp.product_id WHERE cp.coupon_id = c.id) x), '[]') AS product_ids,
  coalesce((SELECT {_array(_text("x.v"), "x.v")} FROM (SELECT DISTINCT p.name AS v FROM shop_coupon_products cp
     JOIN shop_products p ON p.id = cp.product_id WHERE cp.coupon_id = c.id) x), '[]') AS product_names
FROM shop_coupons c
""")
def q15_coupon_catalog_nested(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return promotions.coupon_catalog(s.coupons, s.coupon_products, s.products, active_only=False, nested=True).select(
        "id", "code", _json("product_ids"), _json("product_names"))


_DOC = {"id": _plain("o.id"), "user_id": _plain("o.user_id"), "status": _text("o.status"),
        "total_amount": _plain("o.total_amount")}
_DOC_ITEM = {"product_id": _plain("l.product_id"), "quantity": _plain("l.quantity"),
             "price_at_time": _plain("l.price_at_time")}


@register("p03_order_documents", ctes={"children": f"""
SELECT l.order_id, row_number() OVER (PARTITION BY l.order_id ORDER BY l.product_id NULLS FIRST, {_object(_DOC_ITEM)}) AS position,
       {_object(_DOC_ITEM)} AS line
FROM shop_order_items l WHERE l.order_id IN (SELECT id FROM shop_orders)
"""}, oracle=f"""
SELECT o.id, CAST(0 AS INTEGER) AS kind, CAST(0 AS BIGINT) AS position, rtrim({_object(_DOC)}, '}}') || ',"items":[' AS line
FROM shop_orders o
UNION ALL
SELECT order_id, 1, position, CASE WHEN position > 1 THEN ',' ELSE '' END || line FROM children
UNION ALL
SELECT o.id, 2, (SELECT COUNT(*) FROM children c WHERE c.order_id = o.id), ']}}' FROM shop_orders o
""")
def p03_order_documents(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return documents.nested_lines(
        s.orders.select("id", "user_id", "status", "total_amount"),
        s.order_items.select("order_id", "product_id", "quantity", "price_at_time"),
        key="id", child_key="order_id", child_order=["product_id"], name="items")


@register("p01_user_rows", oracle="""
SELECT id, rtrim(CASE WHEN email IS NULL THEN 'not_null:email,' ELSE '' END
    || CASE WHEN length(email) > 255 THEN 'max_length:255:email,' ELSE '' END
    || CASE WHEN name IS NULL THEN 'not_null:name,' ELSE '' END
    || CASE WHEN length(name) > 255 THEN 'max_length:255:name,' ELSE '' END
    || CASE WHEN length(role) > 50 THEN 'max_length:50:role,' ELSE '' END
    || CASE WHEN length(phone) > 20 THEN 'max_length:20:phone,' ELSE '' END, ',') AS broken_rules
FROM (SELECT c_custkey AS id,
        CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE lower(c_name) || repeat('x', CAST(c_custkey % 300 AS INTEGER)) END AS email,
        CASE WHEN c_custkey % 11 <> 0 THEN repeat(c_name, CAST(c_custkey % 16 AS INTEGER)) END AS name,
        repeat('é', CAST(c_custkey % 53 AS INTEGER)) AS role,
        CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE repeat('9', CAST(c_custkey % 23 AS INTEGER)) END AS phone
      FROM customer)
""")
def p01_user_rows(spark, sf_dir):
    key = F.col("c_custkey")
    times = lambda c, n: F.expr(f"repeat({c}, CAST(c_custkey % {n} AS INT))")
    rows = Shop.of(spark, sf_dir).raw.customer.select(
        key.alias("id"), F.when(key % 7 != 0, F.concat(F.lower("c_name"), times("'x'", 300))).alias("email"),
        F.when(key % 11 != 0, times("c_name", 16)).alias("name"), times("'é'", 53).alias("role"),
        F.when(key % 3 != 0, times("'9'", 23)).alias("phone"))
    kept, broken = schemas.enforce(rows, "users")
    return broken.select("id", "broken_rules").unionByName(kept.select("id", F.lit("").alias("broken_rules")))


@register("d02_copy_database", ctes={
    "u": "SELECT * FROM shop_users WHERE id % 10 <> 3",
    "p": "SELECT * FROM shop_products WHERE id % 12 <> 5",
    "o": "SELECT * FROM shop_orders WHERE user_id IN (SELECT id FROM u) OR id % 4 = 0",
}, oracle="""
SELECT 'users' AS table_name, (SELECT COUNT(*) FROM u) AS n_rows, CAST(0 AS BIGINT) AS refused
UNION ALL SELECT 'products', (SELECT COUNT(*) FROM p), 0
UNION ALL SELECT 'orders', (SELECT COUNT(*) FROM o),
  (SELECT COUNT(*) FROM shop_orders WHERE user_id NOT IN (SELECT id FROM u))
UNION ALL SELECT 'wishlist',
  (SELECT COUNT(*) FROM shop_wishlist WHERE id % 6 = 0 OR (user_id IN (SELECT id FROM u) AND product_id IN (SELECT id FROM p))),
  (SELECT COUNT(*) FROM shop_wishlist WHERE user_id NOT IN (SELECT id FROM u) OR product_id NOT IN (SELECT id FROM p))
""")
def d02_copy_database(spark, sf_dir):
    """Into a database that holds some of the orders and wishlist rows; users and products that are left out refuse theirs."""
    s = Shop.of(spark, sf_dir)
    source = {"users": s.users.filter("id % 10 <> 3"), "products": s.products.filter("id % 12 <> 5"),
              "orders": s.orders, "wishlist": s.wishlist}
    target = {"users": s.users.filter("id < 0"), "products": s.products.filter("id < 0"),
              "orders": s.orders.filter("id % 4 = 0"), "wishlist": s.wishlist.filter("id % 6 = 0")}
    done, refused = migrate.copy_database(source, target)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    parts = [rows[t].select(F.lit(t).alias("table_name"), n.alias("n_rows"), r.alias("refused"))
             for t in source for rows, n, r in ((done, one, none), (refused, none, one))]
    return reduce(DataFrame.unionByName, parts).groupBy("table_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("refused").alias("refused"))
