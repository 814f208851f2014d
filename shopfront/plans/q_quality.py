"""Registered data-quality and migration jobs D1-D8."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.crypto import hmac_sha256_hex
from ..operators import migrate, quality
from ..sources.change_inputs import AS_OF
from ..sources.fixtures import SHOP_TABLES, Shop
from ..sources.model import LINKS
from .registry import register

_EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def _rule_sql(rule: str, col: str) -> str:
    """SQL 'breaks the rule' predicate (the oracle side of quality._ok)."""
    if rule == "required":
        return f"({col} IS NULL OR CAST({col} AS VARCHAR) = '')"
    if rule == "email":
        return f"NOT COALESCE(regexp_matches({col}, '{_EMAIL}'), false)"
    if rule == "phone":
        return (f"NOT ({col} IS NULL OR {col} = '' OR "
                f"regexp_matches(regexp_replace({col}, '[-\\s]', '', 'g'), '^\\d{{10}}$'))")
    if rule == "payment_method":
        return f"NOT COALESCE({col} IN ('cod', 'online'), false)"
    if rule == "order_status":
        return f"NOT COALESCE({col} IN ('pending', 'processing', 'shipped', 'delivered', 'cancelled'), false)"
    number = f"TRY_CAST({col} AS BIGINT)"
    if rule == "offer_range":
        return f"NOT ({col} IS NULL OR COALESCE({number} BETWEEN 0 AND 100, false))"
    if rule == "rating_range":
        return f"NOT COALESCE({number} BETWEEN 1 AND 5, false)"
    if rule == "discount_type":
        return f"NOT COALESCE({col} IN ('percentage', 'fixed'), false)"
    if rule == "numeric":
        return f"NOT ({col} IS NULL OR TRY_CAST({col} AS DOUBLE) IS NOT NULL)"
    raise ValueError(rule)


def _check_sql(table: str, rules: list[tuple[str, str]]) -> str:
    cases = [f"CASE WHEN {_rule_sql(r, c)} THEN '{r}:{c}' END" for r, c in rules]
    n = " + ".join(f"CAST({_rule_sql(r, c)} AS INTEGER)" for r, c in rules)
    return (f"SELECT id, concat_ws(',', {', '.join(cases)}) AS broken_rules, CAST({n} AS INTEGER) AS n_broken "
            f"FROM {table}")


_USER_RULES = [("required", "name"), ("email", "email"), ("phone", "phone")]
_ORDER_RULES = [("payment_method", "payment_method"), ("order_status", "status")]
_ADDRESS_RULES = [("required", "address_line2"), ("phone", "phone_number"), ("required", "city")]


def _check(table: str, rules):
    def build(spark, sf_dir):
        s = Shop.of(spark, sf_dir)
        return quality.check_rules(s.table(table), rules, keep=["id"]).drop("broken")
    return build


register("d01_check_users", oracle=_check_sql("shop_users", _USER_RULES))(_check("users", _USER_RULES))
register("d01_check_orders", oracle=_check_sql("shop_orders", _ORDER_RULES))(_check("orders", _ORDER_RULES))
register("d01_check_addresses", oracle=_check_sql("shop_addresses", _ADDRESS_RULES))(
    _check("addresses", _ADDRESS_RULES))


_FORM_RULES = [("offer_range", "offer"), ("rating_range", "rating"), ("discount_type", "discount"), ("numeric", "price")]


@register("d01_check_forms", oracle=_check_sql("""
(SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 'x' ELSE CAST(p_size * 3 - 4 AS VARCHAR) END AS offer,
        CASE WHEN p_size % 11 = 0 THEN NULL ELSE CAST(p_size % 8 AS VARCHAR) END AS rating,
        CASE p_size % 4 WHEN 0 THEN 'percentage' WHEN 1 THEN 'fixed' WHEN 2 THEN 'other' END AS discount,
        CASE WHEN p_size % 5 = 0 THEN 'abc' WHEN p_size % 6 = 0 THEN NULL ELSE CAST(p_retailprice AS VARCHAR) END AS price FROM part)
""", _FORM_RULES))
def d01_check_forms(spark, sf_dir):
    size, text = F.col("p_size"), "string"
    forms = Shop.of(spark, sf_dir).raw.part.select(
        F.col("p_partkey").alias("id"),
        F.when(size % 9 == 0, None).when(size % 7 == 0, "x").otherwise((size * 3 - 4).cast(text)).alias("offer"),
        F.when(size % 11 == 0, None).otherwise((size % 8).cast(text)).alias("rating"),
        F.when(size % 4 == 0, "percentage").when(size % 4 == 1, "fixed").when(size % 4 == 2, "other").alias("discount"),
        F.when(size % 5 == 0, "abc").when(size % 6 == 0, None).otherwise(F.col("p_retailprice").cast(text)).alias("price"))
    return quality.check_rules(forms, _FORM_RULES, keep=["id"]).drop("broken")


@register("d02_copy_users", oracle="""
SELECT u.id, u.name, u.email, u.role, u.created_at, true AS is_verified
FROM shop_users u WHERE u.id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
UNION ALL
SELECT id, name, email, role, created_at, NULL FROM shop_users
WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
""")
def d02_copy_users(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    rich = s.raw.customer.filter(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("id"))
    target = (s.users.join(rich, "id", "left_semi")
              .select("id", "name", "email", "role", "created_at", F.lit(True).alias("is_verified")))
    return migrate.copy_matching(s.users, target, unique=("email",))


# Fixed column counts of the fixture tables (the profile's n_columns).
_N_COLUMNS = {"users": 6, "categories": 5, "products": 13, "orders": 8, "order_items": 4, "reviews": 6,
              "brand_reviews": 5, "wishlist": 4, "cart": 6, "coupons": 13, "coupon_products": 3, "addresses": 9}


@register("d03_profile_tables", oracle="\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count, {_N_COLUMNS[t]} AS n_columns FROM shop_{t}"
    for t in SHOP_TABLES))
def d03_profile_tables(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    summary, _ = quality.profile_tables(spark, {t: s.table(t) for t in SHOP_TABLES})
    return summary.drop("sample_row")


# A sample is the row with the smallest first column, of equals the one with the smallest second.
_SAMPLED = {"users": ("id", "name"), "orders": ("id", "user_id"), "order_items": ("order_id", "product_id"),
            "reviews": ("id", "product_id"), "wishlist": ("id", "user_id"), "cart": ("id", "user_id"),
            "coupon_products": ("id", "coupon_id"), "addresses": ("id", "user_id")}


def _sample_sql(table: str) -> str:
    first, second = _SAMPLED[table]
    return (f"SELECT '{table}' AS table_name, CAST(lowest.{first} AS VARCHAR) AS first_value,"
            f" CAST(lowest.{second} AS VARCHAR) AS second_value, {_N_COLUMNS[table]} AS n_fields"
            f" FROM (SELECT {first}, {second} FROM shop_{table} ORDER BY {first}, {second} LIMIT 1) lowest")


@register("d03_sample_rows", oracle="\nUNION ALL\n".join(map(_sample_sql, _SAMPLED)))
def d03_sample_rows(spark, sf_dir):
    """What the JSON sample of each table holds: its first two values and how many fields it has."""
    s = Shop.of(spark, sf_dir)
    tables = {t: s.table(t) for t in _SAMPLED}
    summary, _ = quality.profile_tables(spark, tables)
    value = lambda i: reduce(lambda c, t: c.when(F.col("table_name") == t, F.get_json_object(
        "sample_row", f"$.{tables[t].columns[i]}")), tables, F)
    return summary.select("table_name", value(0).alias("first_value"), value(1).alias("second_value"),
                          F.size(F.json_object_keys("sample_row")).alias("n_fields"))


def _fk_sql() -> str:
    parts = []
    for link in LINKS:
        if (link.child, link.column) == ("order_items", "coupon_id"):
            continue    # the fixture's order_items has no coupon column
        parts.append(
            f"SELECT '{link.child}' AS child_table, '{link.column}' AS column_name, "
            f"'{link.parent}' AS parent_table, '{link.on_delete}' AS on_delete, COUNT(*) AS child_rows, "
            f"CAST(COUNT(*) - COUNT({link.column}) AS BIGINT) AS null_links, "
            f"(SELECT COUNT(*) FROM shop_{link.child} c WHERE c.{link.column} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM shop_{link.parent} p WHERE p.id = c.{link.column})) AS orphan_rows "
            f"FROM shop_{link.child}")
    return "\nUNION ALL\n".join(parts)


@register("d04_fk_audit", oracle=_fk_sql())
def d04_fk_audit(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return quality.fk_audit({t: s.table(t) for t in SHOP_TABLES})


_PRODUCT_TEXT = "'nation_' || CAST(p.id % 30 AS VARCHAR)"


def _backfill(as_written: bool):
    def build(spark, sf_dir):
        s = Shop.of(spark, sf_dir)
        p = s.products.withColumn("category", F.concat(F.lit("nation_"), (F.col("id") % 30).cast("string")))
        out = migrate.backfill_category(p, s.categories, as_written=as_written)
        return out.select("id", "category", "category_id", "backfill")
    return build


_BY_NAME = f"(SELECT MIN(c.id) FROM shop_categories c WHERE lower(c.name) = lower({_PRODUCT_TEXT}))"
_PICK_AS_WRITTEN = (f"CASE WHEN EXISTS (SELECT 1 FROM shop_categories c WHERE c.parent_id IS NOT NULL "
                    f"AND {_PRODUCT_TEXT} ILIKE c.name) THEN (SELECT MIN(id) FROM shop_categories) "
                    f"ELSE {_BY_NAME} END")


def _backfill_sql(pick: str) -> str:
    return f"""
SELECT p.id, {_PRODUCT_TEXT} AS category,
       CASE WHEN p.category_id IS NULL THEN {pick} ELSE p.category_id END AS category_id,
       CASE WHEN p.category_id IS NULL THEN CASE WHEN {pick} IS NOT NULL THEN 'matched' ELSE 'unmatched' END
       END AS backfill
FROM shop_products p"""


register("d05_backfill_category", oracle=_backfill_sql(_BY_NAME))(_backfill(False))
register("d05_backfill_category_as_written", oracle=_backfill_sql(_PICK_AS_WRITTEN))(_backfill(True))


@register("d06_seed_categories", oracle=f"""
WITH tree AS (SELECT p_partkey AS seq, p_type AS parent, 'Type ' || p_type AS parent_description,
                     p_type || ' ' || p_brand AS child FROM part),
     b AS (SELECT MAX(id) + 1 AS base FROM shop_categories),
     np AS (SELECT parent AS name, MIN(seq) AS s, arg_min(parent_description, seq) AS description
            FROM tree WHERE parent NOT IN (SELECT name FROM shop_categories) GROUP BY parent),
     pid AS (SELECT name, id FROM shop_categories UNION ALL SELECT name, (SELECT base FROM b) + 2 * s FROM np),
     nc AS (SELECT child AS name, MIN(seq) AS s, arg_min(parent, seq) AS parent FROM tree
            WHERE child NOT IN (SELECT name FROM shop_categories) AND child NOT IN (SELECT name FROM np)
            GROUP BY child)
SELECT *, CAST(NULL AS VARCHAR) AS image_url FROM shop_categories
UNION ALL
SELECT (SELECT base FROM b) + 2 * s, name, description, CAST(NULL AS BIGINT), TIMESTAMP '{AS_OF}', name || '.jpg' FROM np
UNION ALL
SELECT (SELECT base FROM b) + 2 * nc.s + 1, nc.name, nc.name || ' in ' || nc.parent || ' category', pid.id,
       TIMESTAMP '{AS_OF}', NULL
FROM nc JOIN pid ON pid.name = nc.parent
""")
def d06_seed_categories(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    p = s.raw.part
    tree = p.select(F.col("p_partkey").alias("seq"), F.col("p_type").alias("parent"),
                    F.concat(F.lit("Type "), F.col("p_type")).alias("parent_description"),
                    F.concat("p_type", F.lit(".jpg")).alias("parent_image"),
                    F.concat_ws(" ", "p_type", "p_brand").alias("child"))
    categories = s.categories.withColumn("image_url", F.lit(None).cast("string"))
    return migrate.seed_categories(categories, tree, AS_OF)


_SPECS = [migrate.ColumnSpec("image_url2", "string", None, "add"),
          migrate.ColumnSpec("usage_instructions", "string", None, "add"),
          migrate.ColumnSpec("offer_percentage", "int", 0, "replace"),
          migrate.ColumnSpec("stock_quantity", "int", 0, "backfill"),
          migrate.ColumnSpec("updated_at", "timestamp_ntz", AS_OF, "add")]


@register("d07_evolve_products", oracle=f"""
SELECT id, name, description, price, category, image_url, category_id,
       COALESCE(stock_quantity, 0) AS stock_quantity, created_at, product_type, skin_type, concerns,
       CAST(NULL AS VARCHAR) AS image_url2, CAST(NULL AS VARCHAR) AS usage_instructions,
       0 AS offer_percentage, TIMESTAMP '{AS_OF}' AS updated_at
FROM shop_products
""")
def d07_evolve_products(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return migrate.evolve(s.products, _SPECS)


# A made-up test secret (not a credential of any system).
PAYMENT_SECRET = "shopfront-test-secret"
OTHER_SECRET = "not-the-secret"


def _hmac_sql(secret: str, msg: str) -> str:
    from ..functions.crypto import padded_keys
    ipad, opad = padded_keys(secret.encode())
    return f"sha256(unhex('{opad.hex()}') || unhex(sha256(unhex('{ipad.hex()}') || encode({msg}))))"


_MSG = "'order_' || CAST(o_orderkey AS VARCHAR) || '|' || 'pay_' || CAST(o_orderkey AS VARCHAR)"


@register("d08_payment_audit", oracle=f"""
SELECT gateway_order_id, payment_id, signature, amount, expected_signature,
       signature = expected_signature AS signature_ok,
       CAST(floor(CAST(amount AS DOUBLE) * 100.0 + 0.5) AS BIGINT) AS amount_minor, amount > 0 AS amount_ok
FROM (SELECT 'order_' || CAST(o_orderkey AS VARCHAR) AS gateway_order_id,
             'pay_' || CAST(o_orderkey AS VARCHAR) AS payment_id,
             CASE WHEN o_orderstatus <> 'F' THEN {_hmac_sql(PAYMENT_SECRET, _MSG)}
                  ELSE {_hmac_sql(OTHER_SECRET, _MSG)} END AS signature,
             CAST(o_totalprice - 200000 AS DECIMAL(12,2)) AS amount,
             {_hmac_sql(PAYMENT_SECRET, _MSG)} AS expected_signature
      FROM orders)
""")
def d08_payment_audit(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    o = s.raw.orders
    gid = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))
    pid = F.concat(F.lit("pay_"), F.col("o_orderkey").cast("string"))
    msg = F.concat(gid, F.lit("|"), pid)
    pays = o.select(gid.alias("gateway_order_id"), pid.alias("payment_id"),
                    F.when(F.col("o_orderstatus") != "F", hmac_sha256_hex(PAYMENT_SECRET, msg))
                     .otherwise(hmac_sha256_hex(OTHER_SECRET, msg)).alias("signature"),
                    (F.col("o_totalprice") - 200000).cast("decimal(12,2)").alias("amount"))
    out = quality.payment_audit(pays, PAYMENT_SECRET)
    return out.withColumn("expected_signature", hmac_sha256_hex(
        PAYMENT_SECRET, F.concat(F.col("gateway_order_id"), F.lit("|"), F.col("payment_id"))))
