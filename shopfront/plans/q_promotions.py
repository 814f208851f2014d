"""Registered queries Q15-Q17 (coupons)."""

from __future__ import annotations

from ..operators import promotions
from ..sources.fixtures import QUOTE_AS_OF, Shop, quote_carts
from .registry import register

_AS_OF = f"TIMESTAMP '{QUOTE_AS_OF}'"

_Q15 = """
SELECT c.id, c.code, c.description, c.discount_type, c.discount_value, c.min_purchase_amount,
       c.max_discount_amount, c.start_date, c.end_date, c.is_active, c.created_at,
       l.product_id, l.product_name
FROM shop_coupons c
LEFT JOIN (SELECT cp.coupon_id, p.id AS product_id, p.name AS product_name
           FROM shop_coupon_products cp JOIN shop_products p ON cp.product_id = p.id) l
       ON l.coupon_id = c.id
WHERE {where}
"""


@register("q15_coupon_catalog", oracle=_Q15.format(where=f"""
c.is_active = true AND c.start_date <= {_AS_OF} AND c.end_date >= {_AS_OF}
AND (c.usage_limit IS NULL OR c.times_used < c.usage_limit)"""))
def q15_coupon_catalog(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return promotions.coupon_catalog(s.coupons, s.coupon_products, s.products, as_of=QUOTE_AS_OF)


@register("q15_coupon_catalog_all", oracle=_Q15.format(where="true"))
def q15_coupon_catalog_all(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return promotions.coupon_catalog(s.coupons, s.coupon_products, s.products, active_only=False)


_CARTS = {
    "q_carts": """
SELECT user_id AS cart_id, 'code' || CAST(user_id % 27 AS VARCHAR) AS code, product_id AS line_no,
       product_id, quantity
FROM shop_cart""",
    "q_keys": """
SELECT k.cart_id, k.code, c.*,
       (SELECT COUNT(*) FROM shop_coupon_products cp WHERE cp.coupon_id = c.id) AS n_products
FROM (SELECT DISTINCT cart_id, code FROM q_carts) k
LEFT JOIN shop_coupons c ON UPPER(c.code) = UPPER(k.code)""",
}


def _lines(applies: str) -> dict:
    return {**_CARTS, "q_lines": f"""
SELECT ca.cart_id, ca.code, ca.line_no, ca.product_id, ca.quantity,
       CAST(p.price * ca.quantity AS DECIMAL(18,2)) AS line_amount, k.id AS coupon_id,
       k.discount_type, k.discount_value, k.max_discount_amount, k.min_purchase_amount,
       k.is_active, k.start_date, k.end_date, k.usage_limit, k.times_used,
       ({applies}) AS applies
FROM q_carts ca
JOIN shop_products p ON p.id = ca.product_id
JOIN q_keys k ON k.cart_id = ca.cart_id AND k.code = ca.code"""}


_LISTED = ("EXISTS (SELECT 1 FROM shop_coupon_products cp WHERE cp.coupon_id = k.id "
           "AND cp.product_id = ca.product_id)")
_INTENDED = f"k.n_products = 0 OR {_LISTED}"


def _reason(total: str) -> str:
    return f"""CASE WHEN coupon_id IS NULL THEN 'Invalid coupon code'
            WHEN NOT COALESCE(is_active, false) THEN 'This coupon is no longer active'
            WHEN (start_date IS NOT NULL AND {_AS_OF} < start_date) OR end_date IS NULL
                 OR {_AS_OF} > end_date THEN 'This coupon has expired'
            WHEN usage_limit IS NOT NULL AND COALESCE(times_used, 0) >= usage_limit
                 THEN 'This coupon has reached its usage limit'
            WHEN {total} < COALESCE(min_purchase_amount, 0)
                 THEN 'Minimum purchase amount of ₹' || CAST(min_purchase_amount AS VARCHAR) || ' required'
       END"""


_Q16 = f"""
SELECT cart_id, code, coupon_id, reason, reason IS NULL AS valid, total_amount, applicable_amount,
       CASE WHEN reason IS NULL THEN CAST(
            CASE WHEN discount_type = 'percentage'
                 THEN CASE WHEN max_discount_amount IS NOT NULL
                           THEN LEAST(applicable_amount * discount_value * 0.01, max_discount_amount)
                           ELSE applicable_amount * discount_value * 0.01 END
                 ELSE LEAST(discount_value, applicable_amount) END AS DECIMAL(20,6)) END AS discount_amount
FROM (SELECT q.*, {_reason('total_amount')} AS reason
      FROM (SELECT k.cart_id, k.code, k.id AS coupon_id, k.discount_type, k.discount_value,
                   k.max_discount_amount, k.min_purchase_amount, k.is_active, k.start_date, k.end_date,
                   k.usage_limit, k.times_used,
                   CAST(COALESCE(s.total, 0) AS DECIMAL(18,2)) AS total_amount,
                   CAST(COALESCE(s.applicable, 0) AS DECIMAL(18,2)) AS applicable_amount
            FROM q_keys k
            LEFT JOIN (SELECT cart_id, code, SUM(line_amount) AS total,
                              SUM(CASE WHEN applies THEN line_amount END) AS applicable
                       FROM q_lines GROUP BY cart_id, code) s
                   ON s.cart_id = k.cart_id AND s.code = k.code) q)
"""


@register("q16_coupon_quote", oracle=_Q16, ctes=_lines(_INTENDED))
def q16_coupon_quote(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return promotions.coupon_quote(quote_carts(s), s.coupons, s.coupon_products, s.products, QUOTE_AS_OF)


@register("q16_coupon_quote_as_written", oracle=_Q16, ctes=_lines(_LISTED))
def q16_coupon_quote_as_written(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return promotions.coupon_quote(quote_carts(s), s.coupons, s.coupon_products, s.products, QUOTE_AS_OF,
                                   as_written=True)


def _q17(base: str) -> str:
    return f"""
SELECT cart_id, code, line_no, product_id, quantity, line_amount, coupon_id, reason,
       reason IS NULL AS valid,
       CASE WHEN reason IS NULL THEN round(
            CASE WHEN max_discount_amount IS NOT NULL AND raw_sum > CAST(max_discount_amount AS DOUBLE)
                 THEN raw * (CAST(max_discount_amount AS DOUBLE) / raw_sum) ELSE raw END, 6) END AS line_discount
FROM (SELECT r.*, SUM(raw) OVER (PARTITION BY cart_id, code) AS raw_sum, {_reason('total_amount')} AS reason
      FROM (SELECT t.*,
                   CASE WHEN applies THEN
                        CASE WHEN discount_type = 'percentage'
                             THEN CAST(line_amount AS DOUBLE) * CAST(discount_value AS DOUBLE) / 100.0
                             ELSE CAST(discount_value AS DOUBLE) * (CAST(line_amount AS DOUBLE) / CAST({base} AS DOUBLE))
                        END
                   ELSE 0.0 END AS raw
            FROM (SELECT l.*,
                         CAST(SUM(line_amount) OVER (PARTITION BY cart_id, code) AS DECIMAL(18,2)) AS total_amount,
                         SUM(line_amount) OVER (PARTITION BY cart_id, code ORDER BY line_no, product_id
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
                  FROM q_lines l) t) r)
"""


@register("q17_coupon_allocation", oracle=_q17("total_amount"), ctes=_lines(_INTENDED))
def q17_coupon_allocation(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return promotions.coupon_allocation(quote_carts(s), s.coupons, s.coupon_products, s.products, QUOTE_AS_OF)


@register("q17_coupon_allocation_as_written", oracle=_q17("running"), ctes=_lines(_LISTED))
def q17_coupon_allocation_as_written(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return promotions.coupon_allocation(quote_carts(s), s.coupons, s.coupon_products, s.products,
                                        QUOTE_AS_OF, as_written=True)
