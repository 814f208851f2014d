"""Change batches derived from the driver tables (FIXTURES.md, "change inputs").

Each batch covers a whole driver table (every order, every event of a kind),
so a change job's work grows with the data.  Values that make some rows
invalid (bad methods, unknown products, taken names) come from the rows'
own columns.  The DuckDB twins are in ``shopfront.plans.q_changes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixtures import Shop

AS_OF = "2024-02-01 00:00:00"
SECOND_BATCH = 10_000_000_000  # what later patches of a batch have in their seq
UNKNOWN_PRODUCT_OFFSET = 100_000_000


def _k():
    return F.regexp_extract("props", r"([0-9]+)", 1).cast("long")


def cart_adds(s: Shop) -> DataFrame:
    """Every purchase event adds 1-3 units of product K to the user's cart."""
    return s.raw.events.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("seq"), "user_id", _k().alias("product_id"),
        (F.lit(1) + F.col("event_id") % 3).cast("int").alias("quantity"))


def cart_edits(s: Shop) -> DataFrame:
    """Every click event edits the user's cart row of product K (or a missing row)."""
    ev = s.raw.events.filter(F.col("event_type") == "click").select(
        "event_id", "user_id", _k().alias("k"), "value")
    cart = s.cart.select(F.col("id").alias("_cid"), F.col("user_id").alias("_u"), F.col("product_id").alias("_p"))
    j = ev.join(cart, (F.col("user_id") == F.col("_u")) & (F.col("k") == F.col("_p")), "left")
    op = (F.when(F.col("event_id") % 40 == 3, "clear").when(F.col("event_id") % 4 == 0, "set_quantity")
          .when(F.col("event_id") % 4 == 1, "set_selected").otherwise("remove"))
    return j.select(
        F.col("event_id").alias("seq"), op.alias("op"),
        F.coalesce(F.col("_cid"), F.col("event_id") + UNKNOWN_PRODUCT_OFFSET).alias("id"), "user_id",
        (F.lit(1) + F.floor("value") % 5).cast("int").alias("quantity"),
        (F.col("event_id") % 2 == 0).alias("selected"))


def wishlist_ops(s: Shop) -> DataFrame:
    """Every view event adds product K to the wishlist, every third removes it."""
    return s.raw.events.filter(F.col("event_type") == "view").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 3 == 0, "remove").otherwise("add").alias("op"),
        "user_id", _k().alias("product_id"))


def order_requests(s: Shop) -> tuple[DataFrame, DataFrame]:
    """C4: every order is re-submitted as a request; line 7 names an unknown product."""
    o = s.raw.orders
    prio = F.col("o_orderpriority")
    req = o.select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("user_id"),
        F.when(prio == "5-LOW", "cod").when(prio == "4-NOT SPECIFIED", "card").otherwise("online")
         .alias("payment_method"),
        F.when(F.col("o_orderstatus") == "F", F.lit(None)).otherwise(F.col("o_totalprice"))
         .cast("decimal(10,2)").alias("total_amount"))
    lines = s.raw.lineitem.select(
        F.col("l_orderkey").alias("seq"),
        F.when(F.col("l_linenumber") == 7, F.col("l_partkey") + UNKNOWN_PRODUCT_OFFSET)
         .otherwise(F.col("l_partkey")).alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"))
    return req, lines


def payments(s: Shop) -> DataFrame:
    """A payment arrives for every order; only temporary ones can be confirmed."""
    return s.raw.orders.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("pay_"), F.col("o_orderkey").cast("string")).alias("payment_id"))


def cancels(s: Shop) -> DataFrame:
    """A cancel arrives for every order; only temporary ones are deleted."""
    return s.raw.orders.select(F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("order_id"),
                               F.col("o_custkey").alias("user_id"))


STALE_BEFORE = "1997-01-01 00:00:00"


def status_changes(s: Shop) -> DataFrame:
    """One change per order aimed 7 ids ahead; the 4-NOT SPECIFIED status is not allowed."""
    prio = F.col("o_orderpriority")
    status = (F.when(prio == "1-URGENT", "shipped").when(prio == "2-HIGH", "cancelled")
              .when(prio == "3-MEDIUM", "processing").when(prio == "4-NOT SPECIFIED", "on hold")
              .otherwise("delivered"))
    return s.raw.orders.select(F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") + 7).alias("order_id"),
                               status.alias("status"))


def product_patches(s: Shop) -> DataFrame:
    """One patch per product, every third field left null."""
    p = s.products
    r = F.col("id") % 3
    return p.select(
        F.col("id").alias("seq"), "id",
        F.when(r == 0, F.lit(None)).otherwise(F.concat("name", F.lit(" v2"))).alias("name"),
        F.when(r == 1, F.lit(None)).otherwise(F.concat(F.lit("new "), "description")).alias("description"),
        F.when(r == 2, F.lit(None)).otherwise(F.col("price") + 1).cast("decimal(10,2)").alias("price"),
        F.when(r == 0, F.lit(None)).otherwise(F.lit(5)).cast("int").alias("offer_percentage"))


def profile_patches(s: Shop) -> DataFrame:
    """Every fourth user changes name and mail address or phone; what is not given stays."""
    key = F.col("c_custkey")
    return s.raw.customer.filter(key % 4 == 0).select(
        key.alias("seq"), key.alias("id"), F.when(key % 3 != 0, F.concat(F.lit("New "), "c_name")).alias("name"),
        F.when(key % 3 == 1, F.concat(F.lit("x"), key.cast("string"), F.lit("@example.org"))).alias("email"),
        F.when(key % 3 == 2, "5550000000").alias("phone"))


def address_patches(s: Shop) -> DataFrame:
    """Every order patches the address of its number, one in five as somebody else; every third does so again."""
    o, key = s.raw.orders, F.col("o_orderkey")
    first = o.select(
        key.alias("seq"), key.alias("id"), F.when(key % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("user_id"),
        F.when(key % 3 != 1, F.concat(F.lit("New City "), (key % 4).cast("string"))).alias("city"),
        F.when(key % 2 == 0, "5550000000").alias("phone_number"),
        F.when(key % 4 != 0, F.concat(F.lit("Unit "), (key % 7).cast("string"))).alias("address_line2"),
        F.when(key % 6 == 0, True).alias("is_default"))
    again = o.filter(key % 3 == 0).select(
        (key + SECOND_BATCH).alias("seq"), key.alias("id"), F.col("o_custkey").alias("user_id"),
        F.when(key % 12 == 0, "Old Town").alias("city"), F.lit(None).cast("string").alias("phone_number"),
        F.when(key % 2 == 1, "Back door").alias("address_line2"), F.when(key % 9 == 0, False).alias("is_default"))
    return first.unionByName(again)


def product_rows(s: Shop) -> DataFrame:
    """Every part is submitted again as a new product, as form text."""
    p = s.raw.part
    key = F.col("p_partkey")
    return p.select(
        key.alias("seq"),
        F.when(key % 11 == 0, F.lit("")).otherwise(F.concat("p_name", F.lit(" II"))).alias("name"),
        F.col("p_type").alias("description"),
        F.when(key % 13 == 0, F.lit("abc")).when(key % 17 == 0, F.concat(F.col("p_retailprice").cast("string"), F.lit("x")))
         .when(key % 23 == 0, F.lit("1e12")).otherwise(F.col("p_retailprice").cast("string")).alias("price"),
        F.when(F.col("p_size") == 49, F.lit("x1")).when(F.col("p_size") == 48, F.lit("77"))
         .otherwise(F.col("p_size").cast("string")).alias("category_id"),
        F.when(key % 7 == 0, F.lit("")).when(key % 19 == 0, F.lit("3000000000"))
         .otherwise((F.col("p_size") * 3).cast("string")).alias("stock_quantity"),
        F.when(F.col("p_size") > 40, (F.col("p_size") * 3).cast("string"))
         .otherwise(F.col("p_size").cast("string")).alias("offer_percentage"))


def review_rows(s: Shop) -> DataFrame:
    """C11: every click event submits a review of product K; ratings 0-6."""
    ev = s.raw.events.filter(F.col("event_type") == "click")
    return ev.select(
        F.col("event_id").alias("seq"), "user_id",
        F.when(F.col("event_id") % 50 == 0, _k() + UNKNOWN_PRODUCT_OFFSET).otherwise(_k()).alias("product_id"),
        (F.floor("value") % 7).cast("int").alias("rating"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("comment"))


def brand_review_rows(s: Shop) -> DataFrame:
    """C11 (brand): every error event adds, updates or deletes the user's brand review.

    A delete names the stored review of its user, or every second one the review that the user's last add
    before would have made (ids of new reviews are max(id) + 1 + seq).
    """
    key = F.col("event_id")
    ev = s.raw.events.filter(F.col("event_type") == "error")
    op = F.when(key % 3 == 0, "add").when(key % 3 == 1, "update").otherwise("delete")
    br = s.brand_reviews.select(F.col("user_id").alias("_u"), F.col("id").alias("_bid"))
    fresh = s.brand_reviews.select((F.max("id") + 1).cast("long")).scalar()
    latest = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    made = fresh + F.max(F.when(key % 3 == 0, key)).over(latest)
    j = ev.withColumn("_made", made).join(br, F.col("user_id") == F.col("_u"), "left")
    return j.select(
        key.alias("seq"), op.alias("op"), "user_id",
        F.when(op == "delete", F.when(key % 2 == 0, F.coalesce("_bid", key)).otherwise(F.coalesce("_made", key)))
         .otherwise(key).alias("id"),
        (F.lit(1) + F.floor("value") % 5).cast("int").alias("rating"),
        F.concat(F.lit("e"), key.cast("string")).alias("comment"))


def category_rows(s: Shop) -> DataFrame:
    """Nations as inserts/updates; some names collide case-blind with existing ones.

    Then, per nation: an update of an unknown id and an insert of the same
    name (a refused row holds no name), a renaming of every category and an
    insert of the name that its nation has (a renaming frees a name).
    """
    n = s.raw.nation
    key, name = F.col("n_nationkey").cast("long"), F.col("n_name")
    none = F.lit(None).cast("long")

    def rows(seq, ident, text):
        return n.select(
            seq.alias("seq"), ident.alias("id"), text.alias("name"), F.concat(F.lit("about "), name).alias("description"),
            F.when(key % 4 == 0, none).otherwise(F.col("n_regionkey") + 100).cast("long").alias("parent_id"))

    return (rows(key + 1, F.when(key % 2 == 0, none).otherwise(key),
                 F.when(key % 3 == 0, F.lower(name)).when(key % 5 == 0, F.lit(None)).otherwise(F.concat(name, F.lit("_X"))))
            .unionByName(rows(key * 2 + 100, key + 500, F.concat(F.lit("Q"), name)))
            .unionByName(rows(key * 2 + 101, none, F.concat(F.lit("q"), F.lower(name))))
            .unionByName(rows(key + 200, key, F.concat(F.lit("R"), name)))
            .unionByName(rows(key + 300, none, name)))


def category_products(s: Shop) -> DataFrame:
    """The products without those under parent 101, so that its categories and then 101 itself can go."""
    others = s.categories.filter("parent_id <> 101").select(F.col("id").alias("category_id"))
    return s.products.join(others, "category_id", "left_semi")


def category_deletes(s: Shop) -> DataFrame:
    """Try to delete every category plus one missing id per nation."""
    c = s.categories.select(F.col("id").alias("seq"), "id")
    missing = s.raw.nation.select((F.col("n_nationkey") + 1000).cast("long").alias("seq"),
                                  (F.col("n_nationkey") + 500).cast("long").alias("id"))
    return c.unionByName(missing)


def coupon_sets(s: Shop) -> DataFrame:
    """C14: one product set per brand for coupon brand-1: all parts of the brand."""
    p = s.raw.part
    brand = F.substring("p_brand", 7, 10).cast("long")
    return p.select(
        F.col("p_partkey").alias("seq"), brand.alias("set_id"), (brand - 1).alias("coupon_id"),
        F.col("p_partkey").alias("product_id"))


def coupon_creates(s: Shop) -> DataFrame:
    """C14 (create): a coupon per region; codes of odd regions clash with existing ones."""
    r = s.raw.region
    key = F.col("r_regionkey")
    return r.select(
        key.cast("long").alias("seq"),
        F.when(key % 2 == 1, F.concat(F.lit("code"), key.cast("string")))
         .otherwise(F.concat(F.lit("new"), F.lower("r_name"))).alias("code"),
        F.col("r_name").alias("description"), F.lit("percentage").alias("discount_type"),
        F.lit(10).cast("decimal(10,2)").alias("discount_value"),
        F.lit(None).cast("decimal(10,2)").alias("min_purchase_amount"),
        F.lit(None).cast("decimal(10,2)").alias("max_discount_amount"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("start_date"),
        F.lit("2024-12-31").cast("timestamp_ntz").alias("end_date"),
        F.lit(None).cast("int").alias("usage_limit"))


def address_changes(s: Shop) -> DataFrame:
    """Open orders add an address (2-HIGH ones as default); others set their own id as default."""
    o = s.raw.orders
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "O", "add").otherwise("set_default").alias("op"),
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"),
        F.concat(F.lit("New "), F.col("o_orderkey").cast("string")).alias("address_line1"),
        (F.col("o_orderpriority") == "2-HIGH").alias("is_default"))


def shipped_order_requests(s: Shop) -> tuple[DataFrame, DataFrame]:
    """C4 with shipping fields from the customer, and a unique line_seq."""
    req, _ = order_requests(s)
    c = s.raw.customer.select(F.col("c_custkey").alias("_ck"), F.col("c_name").alias("shipping_full_name"),
                              F.col("c_mktsegment").alias("shipping_city"))
    li = s.raw.lineitem.select(
        F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("line_seq"))
    return req.join(c, F.col("user_id") == F.col("_ck"), "left").drop("_ck"), li


def detailed_product_rows(s: Shop) -> DataFrame:
    """C10 with texts and images; every third size is empty."""
    more = s.raw.part.select(
        F.col("p_partkey").alias("seq"),
        F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_size").cast("string")).alias("size"),
        F.col("p_type").alias("benefits"), F.concat(F.lit("/uploads/"), "p_name").alias("image_url"))
    return product_rows(s).join(more, "seq")


def coupon_links(s: Shop) -> DataFrame:
    """C14 (create): every part joins the coupon of region partkey modulo 5."""
    return s.raw.part.select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 5).cast("long").alias("coupon_seq"),
                             F.col("p_partkey").alias("product_id"))


def coupon_patches(s: Shop) -> DataFrame:
    """Every coupon patches the one three ids on: text of even ids, every third switched off."""
    return s.coupons.select(
        F.col("id").alias("seq"), (F.col("id") + 3).alias("id"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("about "), F.col("id").cast("string"))).alias("description"),
        F.when(F.col("id") % 3 == 0, F.lit(False)).alias("is_active"))
