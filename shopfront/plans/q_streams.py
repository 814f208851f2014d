"""Registered batch twins of the streams T1-T4 (the streams themselves run in tests)."""

from __future__ import annotations

from ..sources.fixtures import Shop
from ..streaming import codes
from ..streaming import streams as T
from .registry import register

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"


def _after(a: str, b: str) -> str:
    """Event ``a`` comes after event ``b`` in (ts, event_id) order."""
    return f"({a}.ts > {b}.ts OR ({a}.ts = {b}.ts AND {a}.event_id > {b}.event_id))"


@register("t01_stock_ledger", oracle=f"""
SELECT s.product_id, s.units_sold, s.n_lines, p.stock_quantity,
       CAST(p.stock_quantity - s.units_sold AS BIGINT) AS stock_left
FROM (SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS units_sold, COUNT(*) AS n_lines
      FROM (SELECT DISTINCT event_id AS line_id, {_K} AS product_id, CAST(1 + event_id % 3 AS INTEGER) AS quantity
            FROM events WHERE event_type = 'purchase')
      GROUP BY product_id) s
LEFT JOIN shop_products p ON p.id = s.product_id
""")
def t01_stock_ledger(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return T.stock_ledger_batch(T.order_lines(s.raw.events), s.products)


_CART_EV = {"cev": f"""
SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts,
       CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'set' WHEN 'error' THEN 'remove'
                       WHEN 'signup' THEN 'clear' WHEN 'purchase' THEN 'order' END AS kind,
       CASE WHEN event_type IN ('view', 'click', 'error') THEN {_K} END AS product_id,
       CAST(CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 1 + floor(value) % 5 END
            AS INTEGER) AS quantity
FROM events""",
            "live": f"""
SELECT e.* FROM cev e
WHERE e.kind IN ('add', 'set', 'remove')
  AND NOT EXISTS (SELECT 1 FROM cev c WHERE c.user_id = e.user_id AND c.kind IN ('clear', 'order')
                  AND {_after('c', 'e')})
  AND NOT EXISTS (SELECT 1 FROM cev r WHERE r.user_id = e.user_id AND r.product_id = e.product_id
                  AND r.kind = 'remove' AND (r.event_id = e.event_id OR {_after('r', 'e')}))""",
            "first_add": """
SELECT user_id, product_id, arg_min(event_id, ts) AS a1_id, MIN(ts) AS a1_ts
FROM live WHERE kind = 'add' GROUP BY user_id, product_id""",
            "last_set": f"""
SELECT l.user_id, l.product_id, arg_max(l.quantity, l.ts) AS sq, MAX(l.ts) AS s_ts,
       arg_max(l.event_id, l.ts) AS s_id
FROM live l JOIN first_add f ON f.user_id = l.user_id AND f.product_id = l.product_id
WHERE l.kind = 'set' AND (l.ts > f.a1_ts OR (l.ts = f.a1_ts AND l.event_id > f.a1_id))
GROUP BY l.user_id, l.product_id"""}


@register("t02_live_cart", ctes=_CART_EV, oracle="""
SELECT f.user_id, f.product_id,
       CAST(COALESCE(s.sq, 0) + COALESCE((SELECT SUM(l.quantity) FROM live l
            WHERE l.user_id = f.user_id AND l.product_id = f.product_id AND l.kind = 'add'
              AND (s.s_ts IS NULL OR l.ts > s.s_ts OR (l.ts = s.s_ts AND l.event_id > s.s_id))), 0)
            AS INTEGER) AS quantity
FROM first_add f LEFT JOIN last_set s ON s.user_id = f.user_id AND s.product_id = f.product_id
""")
def t02_live_cart(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return T.live_cart_batch(T.cart_events(s.raw.events))


_CODE_EV = {"kev": """
SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts,
       CASE WHEN event_type = 'click' THEN 'request' ELSE 'attempt' END AS kind,
       floor(value) % 4 = 0 AS correct
FROM events WHERE event_type IN ('click', 'view')""",
            "att": """
SELECT a.*, r.ts AS issued, r.event_id AS req_id,
       (floor(epoch_us(a.ts) / 1000) - floor(epoch_us(r.ts) / 1000)) > 600000 AS late
FROM kev a
LEFT JOIN LATERAL (SELECT * FROM kev r WHERE r.user_id = a.user_id AND r.kind = 'request'
                   AND (r.ts < a.ts OR (r.ts = a.ts AND r.event_id < a.event_id))
                   ORDER BY r.ts DESC, r.event_id DESC LIMIT 1) r ON true
WHERE a.kind = 'attempt'""",
            "att2": """
SELECT a.*, COUNT(*) FILTER (WHERE NOT a.correct) OVER (
           PARTITION BY a.user_id, a.req_id ORDER BY a.ts, a.event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wrong_before
FROM att a""",
            "term": """
SELECT user_id, req_id, arg_min(event_id, ts) AS t_id
FROM att2 WHERE late OR correct OR wrong_before >= 2
GROUP BY user_id, req_id"""}


@register("t03_verification_funnel", ctes=_CODE_EV, oracle="""
SELECT a.event_id, a.user_id,
       CASE WHEN a.issued IS NULL THEN 'no code'
            WHEN t.t_id IS NOT NULL AND a.event_id > t.t_id THEN 'no code'
            WHEN t.t_id = a.event_id THEN CASE WHEN a.late THEN 'expired' WHEN a.correct THEN 'verified'
                                               ELSE 'locked' END
            ELSE 'invalid' END AS outcome
FROM att2 a LEFT JOIN term t ON t.user_id = a.user_id AND t.req_id = a.req_id
""")
def t03_verification_funnel(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return T.verification_batch(T.code_events(s.raw.events))


@register("t04_unpaid_orders", oracle="""
SELECT o.id AS order_id, o.user_id, o.created_at AS start_ts
FROM shop_orders o
WHERE o.is_temporary = true
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.id AND l.l_shipdate >= o.created_at
                  AND l.l_shipdate <= o.created_at + INTERVAL 30 DAY)
""")
def t04_unpaid_orders(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return T.unpaid_batch(T.order_starts(s.orders), T.payment_results(s.raw.lineitem), "30 days")


_STATUS = {**_CODE_EV, "newest": """
SELECT user_id, event_id AS request_id, ts AS issued FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back
    FROM kev WHERE kind = 'request') WHERE back = 1""",
           "tries": """
SELECT n.user_id, n.request_id, e.ts, e.correct,
       count(*) FILTER (WHERE NOT e.correct) OVER (PARTITION BY n.user_id ORDER BY e.ts, e.event_id) AS wrong,
       row_number() OVER (PARTITION BY n.user_id ORDER BY e.ts, e.event_id) AS place
FROM newest n JOIN kev e ON e.user_id = n.user_id AND e.kind = 'attempt'
 AND (e.ts > n.issued OR (e.ts = n.issued AND e.event_id > n.request_id))
 AND floor(epoch_us(e.ts) / 1000) - floor(epoch_us(n.issued) / 1000) <= 600000""",
           "decided": """
SELECT user_id, arg_min(correct, place) AS correct, min(ts) AS ts FROM tries
WHERE correct OR wrong = 3 GROUP BY user_id""",
           "status": """
SELECT n.user_id, n.request_id,
       CASE WHEN d.correct THEN 'verified' WHEN NOT d.correct THEN 'locked'
            WHEN (SELECT max(floor(epoch_us(ts) / 1000)) FROM kev) - floor(epoch_us(n.issued) / 1000) > 600000
            THEN 'expired' ELSE 'open' END AS status,
       CAST(floor(epoch_us(coalesce(d.ts, n.issued)) / 1000) AS BIGINT) AS decided_ms
FROM newest n LEFT JOIN decided d ON d.user_id = n.user_id"""}


@register("t03_code_status", ctes=_STATUS, oracle="""
SELECT user_id, request_id, status, decided_ms + CASE WHEN status = 'expired' THEN 600000 ELSE 0 END AS at_ms FROM status
""")
def t03_code_status(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return codes.code_status_batch(T.code_events(s.raw.events))


@register("t03_code_funnel", ctes=_STATUS, oracle="SELECT status, count(*) AS n_users FROM status GROUP BY status")
def t03_code_funnel(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return codes.funnel(codes.code_status_batch(T.code_events(s.raw.events)))
