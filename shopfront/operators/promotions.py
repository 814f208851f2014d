"""Promotions: Q15 coupon_catalog, Q16 coupon_quote, Q17 coupon_allocation.

Carts arrive as rows ``(cart_id, code, line_no, product_id, quantity)``;
one cart may quote one code.  All carts are priced in one pass: lines join
products for the price and the coupon's product set for applicability,
then partial aggregates per cart give the sums the reject chain needs.
Money stays decimal (exact) up to the first true division; shares and
caps are doubles, as in the reference's JavaScript arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import with_children
from ..functions.columns import money
from ..functions.scan import key_scan

# The reasons a coupon is refused, in the order they are checked.
REASON_UNKNOWN = "Invalid coupon code"
REASON_INACTIVE = "This coupon is no longer active"
REASON_EXPIRED = "This coupon has expired"
REASON_LIMIT = "This coupon has reached its usage limit"
REASON_MINIMUM = "Minimum purchase amount of ₹%s required"

DISCOUNT = "decimal(20,6)"


def is_active_at(as_of: Column) -> Column:
    """Active flag true, start <= as_of <= end (both ends in), usage left."""
    return ((F.col("is_active") == F.lit(True))
            & (F.col("start_date") <= as_of) & (F.col("end_date") >= as_of)
            & (F.col("usage_limit").isNull() | (F.col("times_used") < F.col("usage_limit"))))


def coupon_catalog(coupons: DataFrame, coupon_products: DataFrame, products: DataFrame,
                   as_of=None, active_only: bool = True, nested: bool = False,
                   sort: bool = True) -> DataFrame:
    """Q15: coupons (active at ``as_of`` unless ``active_only=False``) with their products.

    Flat: one row per (coupon, product) with ``product_id``/``product_name``;
    a coupon without products keeps one row of nulls.  ``nested=True``
    gives sorted distinct ``product_ids`` and ``product_names`` arrays
    ([] for none, where PostgreSQL would give {NULL}).
    """
    c = coupons
    if active_only:
        c = c.filter(is_active_at(F.lit(as_of).cast("timestamp_ntz")))
    cols = ["id", "code", "description", "discount_type", "discount_value", "min_purchase_amount",
            "max_discount_amount", "start_date", "end_date", "is_active", "created_at"]
    c = c.select(*cols)
    p = products.select(F.col("id").alias("_pid"), F.col("name").alias("product_name"))
    links = (coupon_products.select("coupon_id", F.col("product_id").alias("_lp"))
             .join(p, F.col("_lp") == F.col("_pid"), "inner")
             .select("coupon_id", F.col("_pid").alias("product_id"), "product_name"))
    if nested:
        agg = links.groupBy("coupon_id").agg(
            F.sort_array(F.collect_set("product_id")).alias("product_ids"),
            F.sort_array(F.collect_set("product_name")).alias("product_names"))
        out = (c.join(agg, F.col("id") == F.col("coupon_id"), "left").drop("coupon_id")
               .withColumn("product_ids", F.coalesce("product_ids", F.array().cast("array<bigint>")))
               .withColumn("product_names", F.coalesce("product_names", F.array().cast("array<string>"))))
    else:
        out = with_children(c, links, "id", "coupon_id")
    if sort:
        out = out.orderBy(F.col("created_at").desc_nulls_first(), F.col("id"))
    return out


_COUPON_COLS = ["coupon_id", "discount_type", "discount_value", "min_purchase_amount",
                "max_discount_amount", "is_active", "start_date", "end_date", "usage_limit", "times_used"]


def _coupon_dim(coupons: DataFrame, coupon_products: DataFrame) -> DataFrame:
    """Coupons keyed by upper-cased code, with their number of listed products."""
    cp = coupons.select(F.upper("code").alias("_ucode"), F.col("id").alias("coupon_id"),
                        *[c for c in _COUPON_COLS[1:]])
    n_products = coupon_products.groupBy(F.col("coupon_id").alias("_hc")).agg(
        F.count(F.lit(1)).alias("_n_products"))
    return cp.join(n_products, F.col("coupon_id") == F.col("_hc"), "left").drop("_hc")


def _cart_coupons(carts: DataFrame, cp: DataFrame) -> DataFrame:
    """One row per (cart_id, code) with the coupon the code names (case-blind), if any."""
    keys = carts.select("cart_id", "code").distinct()
    return keys.join(cp, F.upper("code") == F.col("_ucode"), "left").drop("_ucode")


def _priced_lines(carts: DataFrame, products: DataFrame, cp: DataFrame,
                  coupon_products: DataFrame, as_written: bool) -> DataFrame:
    """Cart lines with price, amount, coupon and an ``applies`` flag.

    Lines of unknown products are dropped (the reference skips them).  Lines
    meet the coupon dimension directly on the code (no join with a per-cart
    table), so the planner may broadcast it when small.
    """
    price = products.select(F.col("id").alias("_pid"), F.col("price"))
    lines = (carts.join(price, F.col("product_id") == F.col("_pid"), "inner").drop("_pid")
             .withColumn("line_amount", money(F.col("price") * F.col("quantity")))
             .join(cp, F.upper("code") == F.col("_ucode"), "left").drop("_ucode"))
    links = coupon_products.select(F.col("coupon_id").alias("_lc"), F.col("product_id").alias("_lp"),
                                   F.lit(True).alias("_listed"))
    lines = lines.join(links, (F.col("coupon_id") == F.col("_lc")) & (F.col("product_id") == F.col("_lp")),
                       "left").drop("_lc", "_lp")
    listed = F.coalesce(F.col("_listed"), F.lit(False))
    if as_written:
        applies = listed   # a coupon without products has [null]: nothing applies
    else:
        applies = listed | (F.coalesce(F.col("_n_products"), F.lit(0)) == 0)
    return lines.withColumn("applies", applies).drop("_listed")


def _reason(as_of: Column, total: Column) -> Column:
    expired = ((F.col("start_date").isNotNull() & (as_of < F.col("start_date")))
               | F.col("end_date").isNull() | (as_of > F.col("end_date")))
    limit = F.col("usage_limit").isNotNull() & (F.coalesce("times_used", F.lit(0)) >= F.col("usage_limit"))
    minimum = total < F.coalesce(F.col("min_purchase_amount"), F.lit(0))
    return (F.when(F.col("coupon_id").isNull(), REASON_UNKNOWN)
            .when(~F.coalesce(F.col("is_active"), F.lit(False)), REASON_INACTIVE)
            .when(expired, REASON_EXPIRED)
            .when(limit, REASON_LIMIT)
            .when(minimum, F.format_string(REASON_MINIMUM, F.col("min_purchase_amount").cast("string"))))


def coupon_quote(carts: DataFrame, coupons: DataFrame, coupon_products: DataFrame,
                 products: DataFrame, as_of, as_written: bool = False) -> DataFrame:
    """Q16: validate one code per cart and quote its discount.

    Per (cart_id, code): ``reason`` (null when valid) from the fixed check
    order, the cart total, the applicable amount and the discount:
    percentage of the applicable amount capped by ``max_discount_amount``,
    or the fixed value capped by the applicable amount.  ``as_written``
    keeps the reference's [null] product list (coupons without products
    discount nothing).
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    cp = _coupon_dim(coupons, coupon_products)
    cc = _cart_coupons(carts, cp)
    lines = _priced_lines(carts, products, cp, coupon_products, as_written)
    sums = lines.groupBy("cart_id", "code").agg(
        F.sum("line_amount").alias("_total"),
        F.sum(F.when(F.col("applies"), F.col("line_amount"))).alias("_applicable"))
    per_cart = (cc.join(sums, ["cart_id", "code"], "left")
                .withColumn("total_amount", money(F.coalesce("_total", F.lit(0))))
                .withColumn("applicable_amount", money(F.coalesce("_applicable", F.lit(0)))))
    pct = F.col("applicable_amount") * F.col("discount_value") * F.lit("0.01").cast("decimal(3,2)")
    pct = F.when(F.col("max_discount_amount").isNotNull(), F.least(pct, F.col("max_discount_amount"))).otherwise(pct)
    fixed = F.least(F.col("discount_value"), F.col("applicable_amount"))
    reason = _reason(at, F.col("total_amount"))
    discount = F.when(F.col("discount_type") == "percentage", pct).otherwise(fixed).cast(DISCOUNT)
    return per_cart.select(
        "cart_id", "code", "coupon_id", reason.alias("reason"), reason.isNull().alias("valid"),
        "total_amount", "applicable_amount",
        F.when(reason.isNull(), discount).alias("discount_amount"))


def coupon_allocation(carts: DataFrame, coupons: DataFrame, coupon_products: DataFrame,
                      products: DataFrame, as_of, as_written: bool = False) -> DataFrame:
    """Q17: spread a valid coupon over the applicable lines of each cart.

    Percentage: each applicable line gets price*qty*value/100.  Fixed: the
    value is shared by line amount over the cart total (intended) or over
    the running total up to that line in ``line_no`` order (``as_written``,
    where early lines take too much).  If the sum of line discounts exceeds
    ``max_discount_amount``, every line is scaled by max/sum (both kinds).
    Refused carts keep their lines with a null discount and the reason.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    cp = _coupon_dim(coupons, coupon_products)
    lines = _priced_lines(carts, products, cp, coupon_products, as_written)
    totals = lines.groupBy("cart_id", "code").agg(money(F.sum("line_amount")).alias("total_amount"))
    lines = lines.join(totals, ["cart_id", "code"], "inner")
    if as_written:
        # running total in cents through key_scan (exact; a long cart is split over tasks)
        lines = key_scan(lines, ["cart_id", "code"], ["line_no", "product_id"],
                         sum_of=(F.col("line_amount") * 100).cast("long"), count_name="_run_cents")
        share_base = F.col("_run_cents").cast("double") / F.lit(100.0)
    else:
        share_base = F.col("total_amount")
    amount = F.col("line_amount").cast("double")
    pct = amount * F.col("discount_value").cast("double") / F.lit(100.0)
    # a cart (or running) total of zero has nothing to share: the line's part is 0
    fixed = F.coalesce(F.col("discount_value").cast("double") * (amount / F.nullif(share_base.cast("double"), F.lit(0.0))),
                       F.lit(0.0))
    raw = F.when(F.col("applies"), F.when(F.col("discount_type") == "percentage", pct).otherwise(fixed)) \
        .otherwise(F.lit(0.0))
    lines = lines.withColumn("_raw", raw)
    sums = lines.groupBy(F.col("cart_id").alias("_c"), F.col("code").alias("_k")).agg(
        F.sum("_raw").alias("_sum"))
    lines = lines.join(sums, (F.col("cart_id") == F.col("_c")) & (F.col("code") == F.col("_k")), "inner")
    cap = F.col("max_discount_amount").cast("double")
    scaled = F.when(cap.isNotNull() & (F.col("_sum") > cap), F.col("_raw") * (cap / F.col("_sum"))) \
        .otherwise(F.col("_raw"))
    reason = _reason(at, F.col("total_amount"))
    return lines.select(
        "cart_id", "code", "line_no", "product_id", "quantity", "line_amount", "coupon_id",
        reason.alias("reason"), reason.isNull().alias("valid"),
        F.when(reason.isNull(), F.round(scaled, 6)).alias("line_discount"))
