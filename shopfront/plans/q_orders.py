"""Registered queries Q7, Q8, Q12, Q13 (orders) and Q14, Q18-Q23 (people, access)."""

from __future__ import annotations

from ..operators import access, orders, people
from ..sources.fixtures import Shop
from .registry import register


@register("q07_order_history", oracle="""
SELECT o.*, line.* EXCLUDE (order_id),
       CASE WHEN 'cod' IN (LOWER(o.payment_method), LOWER(o.payment_method_type))
            THEN 'Cash on Delivery' ELSE 'Online Payment' END AS payment_method_display
FROM shop_orders o
LEFT JOIN (SELECT order_id, product_id AS item_product_id, quantity AS item_quantity,
                  price_at_time AS item_price_at_time,
                  (SELECT p.name FROM shop_products p WHERE p.id = product_id) AS item_product_name
           FROM shop_order_items) line ON line.order_id = o.id
WHERE o.is_temporary IS NOT TRUE
""")
def q07_order_history(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return orders.order_history(s.orders, s.order_items, s.products)


_VALID_ITEMS = """
SELECT oi.order_id, oi.product_id, p.name AS product_name, oi.quantity, oi.price_at_time
FROM shop_order_items oi JOIN shop_products p ON oi.product_id = p.id
"""


@register("q08_order_book", ctes={"valid_items": _VALID_ITEMS}, oracle="""
SELECT placed.*, v.product_id AS item_product_id, v.product_name AS item_product_name,
       v.quantity AS item_quantity, v.price_at_time AS item_price_at_time
FROM valid_items v
JOIN (SELECT o.*, u.name AS user_name, u.email AS user_email
      FROM shop_users u JOIN shop_orders o ON o.user_id = u.id) placed ON placed.id = v.order_id
""")
def q08_order_book(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return orders.order_book(s.orders, s.users, s.order_items, s.products)


@register("q12_recent_orders", ctes={"valid_items": _VALID_ITEMS}, oracle="""
SELECT t.*, v.product_id AS item_product_id, v.product_name AS item_product_name,
       v.quantity AS item_quantity, v.price_at_time AS item_price_at_time
FROM shop_users u,
     LATERAL (SELECT o.*, CAST(row_number() OVER (ORDER BY o.created_at DESC, o.id) AS INTEGER) AS position
              FROM shop_orders o
              WHERE o.user_id = u.id AND o.id IN (SELECT order_id FROM valid_items)
              ORDER BY o.created_at DESC, o.id LIMIT 5) t
JOIN valid_items v ON v.order_id = t.id
""")
def q12_recent_orders(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return orders.recent_orders(s.orders, s.order_items, s.products, n=5)


@register("q13_recently_bought", oracle="""
SELECT d.user_id, CAST(d.position AS INTEGER) AS position, p.*
FROM (SELECT user_id, product_id,
             row_number() OVER (PARTITION BY user_id ORDER BY order_date DESC, product_id) AS position
      FROM (SELECT DISTINCT o.user_id, oi.product_id, o.created_at AS order_date
            FROM shop_products p0
            JOIN shop_order_items oi ON p0.id = oi.product_id
            JOIN shop_orders o ON oi.order_id = o.id)) d
JOIN shop_products p ON p.id = d.product_id
WHERE d.position <= 5
""")
def q13_recently_bought(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return orders.recently_bought(s.products, s.order_items, s.orders, n=5)


@register("q14_customer_dashboard", oracle="""
SELECT u.id, u.name, u.email, u.phone, u.created_at,
       (SELECT COUNT(*) FROM shop_orders o WHERE o.user_id = u.id) AS total_orders,
       CAST((SELECT COALESCE(SUM(total_amount), 0) FROM shop_orders o WHERE o.user_id = u.id)
            AS DECIMAL(18,2)) AS total_spent,
       (SELECT COUNT(*) FROM shop_wishlist w WHERE w.user_id = u.id) AS wishlist_count,
       (SELECT COUNT(*) FROM shop_cart c WHERE c.user_id = u.id) AS cart_count
FROM shop_users u
""")
def q14_customer_dashboard(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return people.customer_dashboard(s.users, s.orders, s.order_items, s.products, s.cart, s.wishlist)


@register("q18_brand_review_summary", oracle="""
SELECT b.id, b.user_id, b.rating, b.comment, b.created_at,
       IFNULL((SELECT u.name FROM shop_users u WHERE u.id = b.user_id), 'Anonymous') AS user_name,
       CAST(ROUND(SUM(b.rating) OVER () * 10.0 / COUNT(*) OVER ()) / 10 AS DECIMAL(10,1)) AS average_rating,
       COUNT(*) OVER () AS review_count
FROM shop_brand_reviews b
""")
def q18_brand_review_summary(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return people.brand_review_summary(s.brand_reviews, s.users)


@register("q19_cart_contents", oracle="""
SELECT basket.*, shown.name, shown.price, shown.image_url
FROM (SELECT id AS product_id, name, price, image_url FROM shop_products) shown JOIN shop_cart basket USING (product_id)
""")
def q19_cart_contents(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return people.cart_contents(s.cart, s.products)


@register("q20_wishlist_contents", oracle="""
SELECT wish.*, shown.name, shown.price, shown.description, shown.image_url, shown.category
FROM (SELECT * EXCLUDE (id, created_at), id AS product_id FROM shop_products) shown
JOIN shop_wishlist wish USING (product_id)
""")
def q20_wishlist_contents(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return people.wishlist_contents(s.wishlist, s.products)


@register("q21_address_book", oracle="""
SELECT a.*, CAST(row_number() OVER (PARTITION BY user_id
                 ORDER BY is_default DESC NULLS FIRST, created_at DESC NULLS FIRST, id) AS INTEGER) AS position
FROM shop_addresses a
""")
def q21_address_book(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return people.address_book(s.addresses)


@register("q22_user_snapshot", oracle="""
SELECT u.*, x.kind, x.item_id, x.item_product_id, x.item_quantity, x.item_selected, x.item_created_at
FROM shop_users u
LEFT JOIN (SELECT user_id, 'cart' AS kind, id AS item_id, product_id AS item_product_id,
                  quantity AS item_quantity, selected AS item_selected, created_at AS item_created_at
           FROM shop_cart
           UNION ALL
           SELECT user_id, 'wishlist', id, product_id, NULL, NULL, created_at FROM shop_wishlist) x
       ON x.user_id = u.id
""")
def q22_user_snapshot(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return people.user_snapshot(s.users, s.cart, s.wishlist)


@register("q23_order_items_owner", oracle="""
SELECT oi.*, o.user_id AS owner_id FROM shop_order_items oi JOIN shop_orders o ON o.id = oi.order_id
""")
def q23_order_items_owner(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return access.row_owners(s.order_items, "order_items", "select", {"orders": s.orders})


@register("q23_visible_order_items", oracle="""
SELECT oi.* FROM shop_order_items oi
WHERE EXISTS (SELECT 1 FROM shop_orders o WHERE o.id = oi.order_id AND o.user_id = 7)
""")
def q23_visible_order_items(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return access.visible_rows(s.order_items, "order_items", "select", 7, "user", {"orders": s.orders})


@register("q23_visible_cart_rows", oracle="SELECT * FROM shop_cart WHERE user_id = 42")
def q23_visible_cart_rows(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return access.visible_rows(s.cart, "cart", "update", 42, "user")


@register("q23_coupons_admin_update", oracle="SELECT * FROM shop_coupons")
def q23_coupons_admin_update(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return access.visible_rows(s.coupons, "coupons", "update", 0, "admin")
