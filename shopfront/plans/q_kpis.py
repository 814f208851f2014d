"""Registered queries Q9-Q11 (shop figures)."""

from __future__ import annotations

from ..operators import kpis
from ..sources.fixtures import Shop
from .registry import register

_Q11_BODY = """
SELECT p.id, p.name, p.price,
       COALESCE(i.total_orders, 0) AS total_orders,
       CAST(i.units {fan} AS BIGINT) AS total_units_sold,
       CAST(i.revenue {fan} AS DECIMAL(18,2)) AS total_revenue,
       COALESCE(r.avg_rating, 0) AS average_rating,
       COALESCE(r.n, 0) AS review_count,
       COALESCE(w.n, 0) AS wishlist_count
FROM shop_products p
LEFT JOIN (SELECT product_id, COUNT(DISTINCT order_id) AS total_orders, SUM(quantity) AS units,
                  SUM(quantity * price_at_time) AS revenue
           FROM shop_order_items GROUP BY product_id) i ON i.product_id = p.id
LEFT JOIN (SELECT product_id, AVG(rating) AS avg_rating, COUNT(*) AS n
           FROM shop_reviews GROUP BY product_id) r ON r.product_id = p.id
LEFT JOIN (SELECT product_id, COUNT(*) AS n FROM shop_wishlist GROUP BY product_id) w
       ON w.product_id = p.id
"""


@register("q11_product_performance", oracle=_Q11_BODY.format(fan=""))
def q11_product_performance(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return kpis.product_performance(s.products, s.order_items, s.reviews, s.wishlist)


# The literal fan-out join of the reference: items x reviews x wishlist rows.
_Q11_AS_WRITTEN = """
SELECT p.id, p.name, p.price, fan.* EXCLUDE (product_id)
FROM shop_products p
JOIN (SELECT p0.id AS product_id,
             COUNT(DISTINCT sold.order_id) AS total_orders,
             CAST(SUM(sold.units) AS BIGINT) AS total_units_sold,
             CAST(SUM(sold.money) AS DECIMAL(18,2)) AS total_revenue,
             IFNULL(AVG(seen.rating), 0) AS average_rating,
             COUNT(DISTINCT seen.review_id) AS review_count,
             COUNT(DISTINCT seen.wish_id) AS wishlist_count
      FROM shop_products p0
      LEFT JOIN (SELECT product_id, quantity AS units, quantity * price_at_time AS money,
                        (SELECT o.id FROM shop_orders o WHERE o.id = order_id) AS order_id
                 FROM shop_order_items) sold ON sold.product_id = p0.id
      LEFT JOIN (SELECT COALESCE(r.product_id, w.product_id) AS product_id, r.rating, r.id AS review_id, w.id AS wish_id
                 FROM shop_reviews r FULL JOIN shop_wishlist w ON w.product_id = r.product_id) seen
             ON seen.product_id = p0.id
      GROUP BY p0.id) fan ON fan.product_id = p.id
"""


@register("q11_product_performance_as_written", oracle=_Q11_AS_WRITTEN)
def q11_product_performance_as_written(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return kpis.product_performance(s.products, s.order_items, s.reviews, s.wishlist,
                                    as_written=True)


@register("q09_shop_kpis", oracle="""
SELECT people.n AS total_users, goods.n AS total_products, sales.n AS total_orders, sales.money AS total_revenue
FROM (SELECT COUNT(*) FILTER (WHERE role <> 'admin') AS n FROM shop_users) people,
     (SELECT COUNT(*) AS n FROM shop_products) goods,
     (SELECT COUNT(*) AS n, CAST(IFNULL(SUM(total_amount), 0) AS DECIMAL(18,2)) AS money FROM shop_orders) sales
""")
def q09_shop_kpis(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return kpis.shop_kpis(s.users, s.products, s.orders)


@register("q10_customer_value", oracle="""
SELECT u.id, u.name, u.email, u.role, u.created_at, COUNT(o.id) AS total_orders,
       CAST(IFNULL(SUM(o.total_amount), 0) AS DECIMAL(18,2)) AS total_spent
FROM shop_users u LEFT JOIN shop_orders o ON o.user_id = u.id
WHERE u.role <> 'admin'
GROUP BY ALL
""")
def q10_customer_value(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return kpis.customer_value(s.users, s.orders)
