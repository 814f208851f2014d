"""Order views Q7, Q8, Q12, Q13.

Items are joined to their orders on ``order_id`` and to products on
``product_id``; the planner broadcasts the product side only under its size
threshold, otherwise both sides shuffle on the key and AQE splits a hot
product's partition.  Top-n per user uses ``row_number() <= n``, which
Spark plans with a partial per-partition group limit before the shuffle,
so a user with a huge order history never sends all of it to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ITEM_FIELDS = ("product_id", "quantity", "price_at_time", "product_name")


def payment_label(method: Column, method_type: Column) -> Column:
    """'Cash on Delivery' when either column says cod (case-blind), else online."""
    is_cod = (F.lower(method) == "cod") | (F.lower(method_type) == "cod")
    return F.when(is_cod, "Cash on Delivery").otherwise("Online Payment")


def _items_with_names(order_items: DataFrame, products: DataFrame, how: str) -> DataFrame:
    names = products.select(F.col("id").alias("_pid"), F.col("name").alias("product_name"))
    return order_items.join(names, F.col("product_id") == F.col("_pid"), how).drop("_pid")


def _nest_items(flat: DataFrame, order_cols: list[str], fields: list[str], name: str = "items") -> DataFrame:
    """Collect the ``item_*`` columns of a flat frame into one array per order."""
    item = F.struct(*[F.col(f"item_{f}").alias(f) for f in fields])
    return flat.groupBy(*order_cols).agg(F.sort_array(F.collect_list(item)).alias(name))


def order_history(orders: DataFrame, order_items: DataFrame, products: DataFrame,
                  user_ids: list[int] | None = None, order_ids: list[int] | None = None,
                  nested: bool = False, sort: bool | None = None) -> DataFrame:
    """Q7: a user's non-temporary orders with a payment label and their items.

    Orders whose flag is false or null count; temporary ones do not.  An
    order without items keeps one row whose item columns are null (nested:
    one all-null item, as the reference's LEFT JOIN + json_agg yields).
    Newest first is a per-user order: by default the result is sorted only
    when ``user_ids`` narrows it (a global sort of every user's history
    would be a full range shuffle that no reader needs).
    """
    o = orders.filter((F.col("is_temporary") == F.lit(False)) | F.col("is_temporary").isNull())
    if user_ids is not None:
        o = o.filter(F.col("user_id").isin(list(user_ids)))
    if order_ids is not None:
        o = o.filter(F.col("id").isin(list(order_ids)))
    o = o.withColumn("payment_method_display", payment_label(F.col("payment_method"),
                                                             F.col("payment_method_type")))
    items = _items_with_names(order_items, products, "left").select(
        F.col("order_id").alias("_oid"), *[F.col(f).alias(f"item_{f}") for f in ITEM_FIELDS])
    flat = o.join(items, F.col("id") == F.col("_oid"), "left").drop("_oid")
    out = _nest_items(flat, o.columns, list(ITEM_FIELDS)) if nested else flat
    if sort or (sort is None and user_ids is not None):
        out = out.orderBy(F.col("created_at").desc_nulls_first(), F.col("id"))
    return out


def order_book(orders: DataFrame, users: DataFrame, order_items: DataFrame, products: DataFrame,
               nested: bool = False, sort: bool = False) -> DataFrame:
    """Q8: every order (temporary too) with buyer name/email and items.

    Inner joins, as in the reference: orders without items, items of
    unknown products and orders of unknown users drop out.  ``sort`` puts
    the newest first, by a global sort of the whole output.
    """
    u = users.select(F.col("id").alias("_uid"), F.col("name").alias("user_name"),
                     F.col("email").alias("user_email"))
    fields = ["product_id", "product_name", "quantity", "price_at_time"]
    items = _items_with_names(order_items, products, "inner").select(
        F.col("order_id").alias("_oid"), *[F.col(f).alias(f"item_{f}") for f in fields])
    base = orders.join(u, F.col("user_id") == F.col("_uid"), "inner").drop("_uid")
    flat = base.join(items, F.col("id") == F.col("_oid"), "inner").drop("_oid")
    out = _nest_items(flat, base.columns, fields) if nested else flat
    if sort:
        out = out.orderBy(F.col("created_at").desc_nulls_first(), F.col("id"))
    return out


def _top_n_per_user(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def recent_orders(orders: DataFrame, order_items: DataFrame, products: DataFrame, n: int = 5,
                  nested: bool = False) -> DataFrame:
    """Q12: per user the ``n`` newest orders that have items (ties: lower id first).

    Temporary orders are included.  Items of unknown products do not count,
    as with the reference's inner joins.  Flat output: one row per item with
    the order's ``position`` (1 = newest).
    """
    fields = ["product_id", "product_name", "quantity", "price_at_time"]
    items = _items_with_names(order_items, products, "inner").select(
        F.col("order_id").alias("_oid"), *[F.col(f).alias(f"item_{f}") for f in fields])
    with_items = orders.join(items.select("_oid"), F.col("id") == F.col("_oid"), "left_semi")
    top = _top_n_per_user(with_items, [F.col("created_at").desc_nulls_first(), F.col("id")], n)
    flat = top.join(items, F.col("id") == F.col("_oid"), "inner").drop("_oid")
    if nested:
        return _nest_items(flat, top.columns, fields)
    return flat


def recently_bought(products: DataFrame, order_items: DataFrame, orders: DataFrame,
                    n: int = 5) -> DataFrame:
    """Q13: per user the ``n`` latest distinct (product, order date) pairs.

    A product bought on two dates appears twice; ties on the date go to the
    lower product id.  The order date is dropped from the result, as in the
    reference; ``position`` keeps the order.
    """
    known = order_items.join(products.select(F.col("id").alias("_pid")),
                             F.col("product_id") == F.col("_pid"), "left_semi")
    o = orders.select(F.col("id").alias("_oid"), "user_id", F.col("created_at").alias("order_date"))
    pairs = (known.select("order_id", "product_id")
             .join(o, F.col("order_id") == F.col("_oid"), "inner")
             .select("user_id", "product_id", "order_date").distinct())
    top = _top_n_per_user(pairs, [F.col("order_date").desc_nulls_first(), F.col("product_id")], n)
    return (top.join(products, F.col("product_id") == F.col("id"), "inner")
            .select("user_id", "position", *products.columns))
