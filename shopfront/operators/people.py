"""Per-user views: Q14 dashboard, Q18 brand reviews, Q19-Q22 baskets and profile.

All of them run for every user at once; a ``user_ids`` argument only adds a
filter that Catalyst pushes into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import with_children
from ..functions.columns import avg_1dp, money
from ..functions.scan import key_scan
from .orders import recent_orders, recently_bought

PROFILE = ("id", "name", "email", "phone", "photo_url", "created_at")


def _for_users(df: DataFrame, user_ids, col: str = "user_id") -> DataFrame:
    return df if user_ids is None else df.filter(F.col(col).isin(list(user_ids)))


def _count_by_user(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(F.col("user_id").alias("_u")).agg(F.count(F.lit(1)).alias(name))


def customer_dashboard(users: DataFrame, orders: DataFrame, order_items: DataFrame,
                       products: DataFrame, cart: DataFrame, wishlist: DataFrame,
                       n: int = 5, user_ids: list[int] | None = None,
                       nested: bool = False) -> DataFrame:
    """Q14: per user profile, order count, amount spent, wishlist and cart sizes.

    With ``nested=True`` it adds ``recent_orders`` (Q12, at most ``n``
    orders with their items) and ``recently_viewed`` (Q13, at most ``n``
    products); both arrays are bounded by ``n``.
    """
    u = _for_users(users, user_ids, "id")
    prof = u.select(*[c for c in PROFILE if c in users.columns])
    o = _for_users(orders, user_ids)
    stats = o.groupBy(F.col("user_id").alias("_u")).agg(
        F.count(F.lit(1)).alias("total_orders"), money(F.sum("total_amount")).alias("total_spent"))
    out = (prof.join(stats, F.col("id") == F.col("_u"), "left").drop("_u")
           .join(_count_by_user(_for_users(wishlist, user_ids), "wishlist_count"),
                 F.col("id") == F.col("_u"), "left").drop("_u")
           .join(_count_by_user(_for_users(cart, user_ids), "cart_count"),
                 F.col("id") == F.col("_u"), "left").drop("_u"))
    out = out.select(*prof.columns,
                     F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
                     money(F.coalesce("total_spent", F.lit(0))).alias("total_spent"),
                     F.coalesce("wishlist_count", F.lit(0)).alias("wishlist_count"),
                     F.coalesce("cart_count", F.lit(0)).alias("cart_count"))
    if not nested:
        return out
    ro = recent_orders(o, order_items, products, n, nested=True)
    ro = ro.groupBy(F.col("user_id").alias("_u")).agg(F.sort_array(F.collect_list(
        F.struct("position", *[c for c in ro.columns if c not in ("user_id", "position")]))).alias("recent_orders"))
    rv = recently_bought(products, order_items, o, n)
    rv = rv.groupBy(F.col("user_id").alias("_u")).agg(F.sort_array(F.collect_list(
        F.struct("position", *[c for c in rv.columns if c not in ("user_id", "position")]))).alias("recently_viewed"))
    return (out.join(ro, F.col("id") == F.col("_u"), "left").drop("_u")
            .join(rv, F.col("id") == F.col("_u"), "left").drop("_u"))


def brand_review_summary(brand_reviews: DataFrame | None, users: DataFrame, sort: bool = True) -> DataFrame:
    """Q18: each brand review with its author and the overall figures.

    ``user_name`` is 'Anonymous' when the author is unknown; every row carries
    the overall mean rating to one decimal (half away from zero, computed in
    integers) and the review count.  These are scalar subqueries evaluated
    once, not a window over the whole table.  No table (None) is an empty
    table: no rows.
    """
    if brand_reviews is None:
        brand_reviews = users.sparkSession.createDataFrame(
            [], "id long, user_id long, rating int, comment string, created_at timestamp_ntz")
    total = brand_reviews.select(F.sum("rating")).scalar()
    n = brand_reviews.select(F.count(F.lit(1))).scalar()
    avg = F.when(n > 0, avg_1dp(total, n)).otherwise(F.lit(0).cast("decimal(10,1)"))
    names = users.select(F.col("id").alias("_uid"), F.col("name").alias("_uname"))
    out = (brand_reviews.join(names, F.col("user_id") == F.col("_uid"), "left")
           .select("id", "user_id", "rating", "comment", "created_at",
                   F.coalesce(F.col("_uname"), F.lit("Anonymous")).alias("user_name"),
                   avg.alias("average_rating"), n.alias("review_count")))
    if sort:
        out = out.orderBy(F.col("created_at").desc_nulls_first(), F.col("id"))
    return out


def cart_contents(cart: DataFrame, products: DataFrame, user_ids: list[int] | None = None) -> DataFrame:
    """Q19: cart rows with product name, price and image (unknown products drop)."""
    p = products.select(F.col("id").alias("_pid"), "name", "price", "image_url")
    return _for_users(cart, user_ids).join(p, F.col("product_id") == F.col("_pid")).drop("_pid")


def wishlist_contents(wishlist: DataFrame, products: DataFrame, user_ids: list[int] | None = None) -> DataFrame:
    """Q20: wishlist rows with name, price, description, image and category."""
    p = products.select(F.col("id").alias("_pid"), "name", "price", "description", "image_url", "category")
    return _for_users(wishlist, user_ids).join(p, F.col("product_id") == F.col("_pid")).drop("_pid")


def address_book(addresses: DataFrame, user_ids: list[int] | None = None) -> DataFrame:
    """Q21: a user's addresses, default first (null before true, as PostgreSQL
    sorts ``DESC``), then newest, with the 1-based ``position``."""
    a = _for_users(addresses, user_ids)
    # the same order as ascending sort columns; key_scan splits a user with many rows
    a = a.withColumn("_o_def", F.when(F.col("is_default").isNull(), 0).when(F.col("is_default"), 1).otherwise(2)) \
         .withColumn("_o_ts", -F.unix_micros(F.col("created_at").cast("timestamp")))
    out = key_scan(a, ["user_id"], ["_o_def", "_o_ts", "id"], count_name="position")
    return out.select(*addresses.columns, F.col("position").cast("int").alias("position"))


def user_snapshot(users: DataFrame, cart: DataFrame, wishlist: DataFrame,
                  user_ids: list[int] | None = None, nested: bool = False) -> DataFrame:
    """Q22: the sync payload per user — profile, cart rows, wishlist rows.

    Flat: one row per cart or wishlist row (``kind`` = 'cart' | 'wishlist')
    with the profile columns; a user with neither keeps one row with nulls.
    ``nested=True``: one row per user with ``profile`` struct and the two
    arrays (empty when none).
    """
    u = _for_users(users, user_ids, "id")
    c = _for_users(cart, user_ids).select(
        F.col("user_id").alias("_u"), F.lit("cart").alias("kind"), F.col("id").alias("item_id"),
        F.col("product_id").alias("item_product_id"), F.col("quantity").alias("item_quantity"),
        F.col("selected").alias("item_selected"), F.col("created_at").alias("item_created_at"))
    w = _for_users(wishlist, user_ids).select(
        F.col("user_id").alias("_u"), F.lit("wishlist").alias("kind"), F.col("id").alias("item_id"),
        F.col("product_id").alias("item_product_id"), F.lit(None).cast("int").alias("item_quantity"),
        F.lit(None).cast("boolean").alias("item_selected"), F.col("created_at").alias("item_created_at"))
    rows = c.unionByName(w)
    if not nested:
        return with_children(u, rows, "id", "_u")
    cart_arr = c.groupBy("_u").agg(F.sort_array(F.collect_list(F.struct(
        "item_id", "item_product_id", "item_quantity", "item_selected", "item_created_at"))).alias("cart"))
    wish_arr = w.groupBy("_u").agg(F.sort_array(F.collect_list(F.struct(
        "item_id", "item_product_id", "item_created_at"))).alias("wishlist"))
    out = (u.select("id", F.struct(*u.columns).alias("profile"))
           .join(cart_arr, F.col("id") == F.col("_u"), "left").drop("_u")
           .join(wish_arr, F.col("id") == F.col("_u"), "left").drop("_u"))
    return (out.withColumn("cart", F.coalesce("cart", F.array().cast(cart_arr.schema["cart"].dataType)))
            .withColumn("wishlist", F.coalesce("wishlist", F.array().cast(wish_arr.schema["wishlist"].dataType))))
