"""Shop-wide figures: Q9 shop_kpis, Q10 customer_value, Q11 product_performance.

Each fact table is reduced to one row per key *before* any join (the fan-out
rewrite of the reference's five-table join), so every join here is
key-to-key and no intermediate grows with the product of fact rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import money


def item_stats_by_product(order_items: DataFrame) -> DataFrame:
    """Per product: distinct orders, units, revenue.

    The order_items.order_id -> orders.id foreign key makes the reference's
    join to ``orders`` a no-op for these figures, so the fact table is
    aggregated directly (one shuffle, map-side combined).  ``fk_audit``
    (D4) checks the key on data.
    """
    return order_items.groupBy(F.col("product_id").alias("id")).agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.sum("quantity").cast("long").alias("total_units_sold"),
        money(F.sum(F.col("quantity") * F.col("price_at_time"))).alias("total_revenue"),
        F.count(F.lit(1)).alias("_item_rows"),
    )


def review_stats_by_product(reviews: DataFrame) -> DataFrame:
    """Per product: mean rating and number of reviews (id is the key)."""
    return reviews.groupBy(F.col("product_id").alias("id")).agg(
        F.avg("rating").alias("_avg_rating"),
        F.count("id").alias("review_count"),
    )


def wishlist_stats_by_product(wishlist: DataFrame) -> DataFrame:
    return wishlist.groupBy(F.col("product_id").alias("id")).agg(
        F.count("id").alias("wishlist_count"))


def product_performance(products: DataFrame, order_items: DataFrame, reviews: DataFrame,
                        wishlist: DataFrame, as_written: bool = False,
                        sort: bool = True) -> DataFrame:
    """Q11: sales, rating and wishlist figures for every product.

    ``as_written`` reproduces the reference's fan-out join: every item row is
    repeated once per review and once per wishlist row of its product, so
    units and revenue are multiplied by max(1, #reviews) * max(1, #wishlist).
    It is computed from the same per-product aggregates, without building the
    blown-up join.  Rating and the distinct counts are unchanged by the
    fan-out.
    """
    items = item_stats_by_product(order_items)
    revs = review_stats_by_product(reviews)
    wish = wishlist_stats_by_product(wishlist)
    out = (products.select("id", "name", "price")
           .join(items, "id", "left")
           .join(revs, "id", "left")
           .join(wish, "id", "left"))
    units, revenue = F.col("total_units_sold"), F.col("total_revenue")
    if as_written:
        fan = (F.greatest(F.coalesce(F.col("review_count"), F.lit(0)), F.lit(1))
               * F.greatest(F.coalesce(F.col("wishlist_count"), F.lit(0)), F.lit(1)))
        units = units * fan
        revenue = money(revenue * fan)
    out = out.select(
        "id", "name", "price",
        F.coalesce(F.col("total_orders"), F.lit(0)).alias("total_orders"),
        units.cast("long").alias("total_units_sold"),
        revenue.alias("total_revenue"),
        F.coalesce(F.col("_avg_rating"), F.lit(0.0)).alias("average_rating"),
        F.coalesce(F.col("review_count"), F.lit(0)).alias("review_count"),
        F.coalesce(F.col("wishlist_count"), F.lit(0)).alias("wishlist_count"),
    )
    if sort:
        out = out.orderBy(F.col("total_revenue").desc_nulls_first(), F.col("id"))
    return out


def shop_kpis(users: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """Q9: one row of shop totals.

    Non-admin users (a null role fails ``!=`` and is not counted), products,
    orders (temporary ones too) and revenue (0 when there are no orders).
    Each figure is a global partial aggregate; the user and product counts
    are uncorrelated scalar subqueries on the orders row, so nothing is
    joined.
    """
    n_users = users.filter(F.col("role") != "admin").select(F.count(F.lit(1))).scalar()
    n_products = products.select(F.count(F.lit(1))).scalar()
    return orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        money(F.coalesce(F.sum("total_amount"), F.lit(0))).alias("total_revenue"),
    ).select(n_users.alias("total_users"), n_products.alias("total_products"),
             "total_orders", "total_revenue")


def customer_value(users: DataFrame, orders: DataFrame, sort: bool = True) -> DataFrame:
    """Q10: per non-admin user the number of orders and the amount spent (0 if none).

    The correlated scalar subqueries of the reference become one grouped
    aggregate of orders joined to users on the key.
    """
    per_user = orders.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        money(F.sum("total_amount")).alias("total_spent"))
    out = (users.filter(F.col("role") != "admin")
           .select("id", "name", "email", "role", "created_at")
           .join(per_user, F.col("id") == F.col("user_id"), "left")
           .select("id", "name", "email", "role", "created_at",
                   F.coalesce(F.col("total_orders"), F.lit(0)).alias("total_orders"),
                   money(F.coalesce(F.col("total_spent"), F.lit(0))).alias("total_spent")))
    if sort:
        out = out.orderBy(F.col("created_at").desc(), F.col("id"))
    return out
