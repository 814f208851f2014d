"""DuckDB twin of ``shopfront.sources.fixtures``: the 12 shop tables as SQL.

Oracle queries name the shop tables ``shop_<table>``; ``with_fixtures``
prepends only the CTEs a query uses.  The raw driver tables are the views
the checker registers (region, nation, customer, part, orders, lineitem,
events).
"""

from __future__ import annotations

import re

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"


def _days(base: str, n: str) -> str:
    return f"CAST(DATE '{base}' + CAST({n} AS INTEGER) AS TIMESTAMP)"


FIXTURE_SQL = {
    "shop_users": f"""
SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.com' AS email,
       CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role,
       CASE WHEN c_custkey % 6 = 0 THEN NULL
            WHEN c_custkey % 6 = 1 THEN substr(d, 1, 5) || '-' || substr(d, 6, 5)
            WHEN c_custkey % 6 = 2 THEN substr(d, 1, 9)
            ELSE d END AS phone,
       {_days('1995-01-01', 'c_custkey % 900')} AS created_at
FROM (SELECT *, CAST(9000000000 + c_custkey * 7 AS VARCHAR) AS d FROM customer)""",
    "shop_categories": f"""
SELECT id, name, 'All about ' || name AS description, parent_id,
       {_days('1994-01-01', 'id')} AS created_at
FROM (SELECT CAST(r_regionkey + 100 AS BIGINT) AS id, r_name AS name, CAST(NULL AS BIGINT) AS parent_id
      FROM region
      UNION ALL
      SELECT CAST(n_nationkey AS BIGINT), n_name, CAST(n_regionkey + 100 AS BIGINT) FROM nation)""",
    "shop_products": f"""
SELECT p_partkey AS id, p_name AS name, concat_ws(' ', p_brand, p_type) AS description,
       CAST(p_retailprice AS DECIMAL(10,2)) AS price, p_type AS category,
       '/img/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS image_url,
       CAST(CASE WHEN p_size = 50 THEN NULL ELSE CAST(substr(p_brand, 7, 10) AS INTEGER) - 1 END AS BIGINT)
         AS category_id,
       p_size * 40 AS stock_quantity,
       {_days('1996-01-01', 'p_partkey % 700')} AS created_at,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS offer_percentage,
       p_type AS product_type, p_brand AS skin_type, string_split(p_name, ' ') AS concerns
FROM part""",
    "shop_orders": """
SELECT o_orderkey AS id, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
       CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing'
                          WHEN 'F' THEN 'delivered' END AS status,
       CAST(o_orderdate AS TIMESTAMP) AS created_at,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'COD' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
            ELSE 'online' END AS payment_method,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'cod' END AS payment_method_type,
       CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN TRUE
            WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE FALSE END AS is_temporary
FROM orders""",
    "shop_order_items": """
SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
       CAST(l_extendedprice AS DECIMAL(10,2)) AS price_at_time
FROM lineitem""",
    "shop_reviews": f"""
SELECT event_id AS id, CAST(k AS BIGINT) AS product_id, user_id,
       CAST(1 + floor(value) % 5 AS INTEGER) AS rating,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'review of ' || CAST(k AS VARCHAR) END AS comment,
       CAST(ts AS TIMESTAMP) AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) AS rn
      FROM (SELECT *, {_K} AS k FROM events WHERE event_type = 'purchase'))
WHERE rn = 1""",
    "shop_brand_reviews": """
SELECT event_id AS id, user_id, CAST(1 + floor(value) % 5 AS INTEGER) AS rating,
       'brand note ' || CAST(event_id AS VARCHAR) AS comment, CAST(ts AS TIMESTAMP) AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
      FROM events WHERE event_type = 'signup')
WHERE rn = 1""",
    "shop_wishlist": f"""
SELECT min(event_id) AS id, user_id, CAST(k AS BIGINT) AS product_id, CAST(min(ts) AS TIMESTAMP) AS created_at
FROM (SELECT *, {_K} AS k FROM events WHERE event_type = 'click')
GROUP BY user_id, k""",
    "shop_cart": f"""
SELECT id, user_id, product_id, quantity, id % 2 = 0 AS selected, created_at
FROM (SELECT min(event_id) AS id, user_id, CAST(k AS BIGINT) AS product_id,
             CAST(sum(1 + event_id % 3) AS INTEGER) AS quantity, CAST(min(ts) AS TIMESTAMP) AS created_at
      FROM (SELECT *, {_K} AS k FROM events WHERE event_type = 'view')
      GROUP BY user_id, k)""",
    "shop_coupons": f"""
SELECT CAST(n_nationkey AS BIGINT) AS id, 'CODE' || CAST(n_nationkey AS VARCHAR) AS code,
       'Coupon ' || CAST(n_nationkey AS VARCHAR) AS description,
       CASE WHEN n_nationkey % 2 = 0 THEN 'percentage' ELSE 'fixed' END AS discount_type,
       CAST(n_nationkey + 5 AS DECIMAL(10,2)) AS discount_value,
       CAST(n_nationkey * 100 AS DECIMAL(10,2)) AS min_purchase_amount,
       CAST(CASE WHEN n_nationkey % 3 = 0 THEN 50 END AS DECIMAL(10,2)) AS max_discount_amount,
       CAST(DATE '2024-01-01' AS TIMESTAMP) AS start_date,
       {_days('2024-01-10', 'n_nationkey')} AS end_date,
       CAST(CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey END AS INTEGER) AS usage_limit,
       CAST(n_nationkey % 6 AS INTEGER) AS times_used,
       n_nationkey % 7 <> 6 AS is_active,
       {_days('2023-12-01', 'n_nationkey')} AS created_at
FROM nation""",
    "shop_coupon_products": """
SELECT p_partkey AS id, CAST(n_nationkey AS BIGINT) AS coupon_id, p_partkey AS product_id
FROM part JOIN nation ON CAST(substr(p_brand, 7, 10) AS INTEGER) - 1 = n_nationkey
WHERE n_nationkey % 5 <> 0""",
    "shop_addresses": """
SELECT id, user_id, 'Line ' || CAST(id AS VARCHAR) AS address_line1,
       CASE WHEN id % 2 = 0 THEN NULL ELSE 'Floor ' || CAST(id % 9 AS VARCHAR) END AS address_line2,
       'City ' || CAST(id % 10 AS VARCHAR) AS city, CAST(9000000000 + id AS VARCHAR) AS phone_number,
       address_type, is_default, created_at
FROM (SELECT min(o_orderkey) AS id, o_custkey AS user_id, o_orderpriority AS address_type,
             CASE WHEN o_orderpriority = '1-URGENT' THEN TRUE
                  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE FALSE END AS is_default,
             CAST(min(o_orderdate) AS TIMESTAMP) AS created_at
      FROM orders GROUP BY o_custkey, o_orderpriority)""",
}

_NAME = re.compile(r"\bshop_[a-z_]+\b")


def with_fixtures(body: str, extra_ctes: dict | None = None) -> str:
    """Prefix ``body`` with the fixture CTEs (and ``extra_ctes``) it names.

    Extra CTEs may themselves name fixtures, or themselves; order follows first use.
    """
    ctes = dict(FIXTURE_SQL)
    ctes.update(extra_ctes or {})
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in _NAME.findall(text) + [n for n in (extra_ctes or {}) if re.search(rf"\b{n}\b", text)]:
            if name in ctes and name not in seen:
                seen.add(name)
                visit(ctes[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    parts = ",\n".join(f"{n} AS ({ctes[n].strip()})" for n in needed)
    body = body.strip()
    # a CTE that names itself makes the whole list recursive
    plain = "WITH RECURSIVE" if any(re.search(rf"\b{n}\b", ctes[n]) for n in needed if n in (extra_ctes or {})) else "WITH"
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {parts},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"{plain} {parts},\n{body[4:].lstrip()}"
    return f"{plain} {parts}\n{body}"
