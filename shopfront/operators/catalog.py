"""Catalog operators Q1-Q6: search, product detail, reviews, category views.

Filters are assembled as a list of Columns and folded with AND, so Catalyst
pushes the product-only predicates into the Parquet scan.  Review and order
figures are aggregated per product before they meet ``products``; a nested
child list is an opt-in (``nested=True``) because one parent may own an
unbounded number of children — the default output is one flat row per
child with the parent columns repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, any_of, lower_in, lower_overlap
from ..functions.joins import with_children

SEARCH_TEXT = ("name", "description", "ingredients", "benefits", "product_details")


def _categories_with_parent(categories: DataFrame) -> DataFrame:
    """id, name, parent_id and the parent's name (self left join)."""
    c = categories.alias("c")
    p = categories.select(F.col("id").alias("_pid"), F.col("name").alias("parent_name"))
    return c.join(p, F.col("c.parent_id") == F.col("_pid"), "left").drop("_pid")


def _review_stats(reviews: DataFrame | None) -> DataFrame | None:
    if reviews is None:
        return None
    return reviews.groupBy(F.col("product_id").alias("_rpid")).agg(
        F.avg("rating").alias("_avg"), F.count("id").alias("_n"))


def _with_review_stats(df: DataFrame, reviews: DataFrame | None, key: str = "id") -> DataFrame:
    """Add average_rating (0 when none) and review_count; no table => 0 / 0."""
    stats = _review_stats(reviews)
    if stats is None:
        return df.withColumn("average_rating", F.lit(0.0)).withColumn("review_count", F.lit(0).cast("long"))
    return (df.join(stats, F.col(key) == F.col("_rpid"), "left")
            .withColumn("average_rating", F.coalesce(F.col("_avg"), F.lit(0.0)))
            .withColumn("review_count", F.coalesce(F.col("_n"), F.lit(0)).cast("long"))
            .drop("_rpid", "_avg", "_n"))


def _page(df: DataFrame, order: list[Column], page: int, limit: int | None) -> DataFrame:
    df = df.orderBy(*order)
    if limit is None:
        return df
    return df.offset((int(page) - 1) * int(limit)).limit(int(limit))


def catalog_search(products: DataFrame, categories: DataFrame, reviews: DataFrame | None,
                   category: str | None = None, search: str | None = None,
                   min_price=None, max_price=None, product_types: list[str] | None = None,
                   skin_types: list[str] | None = None, concerns: list[str] | None = None,
                   page: int = 1, limit: int | None = 10) -> DataFrame:
    """Q1: filtered, rated, newest-first product listing, one page.

    Predicates apply only when given.  ``category`` matches the product's own
    or parent category name, case-blind; ``search`` is a case-blind
    substring over the text columns (``%``/``_`` in it act as wildcards);
    type lists are case-blind IN; ``concerns`` is a case-blind overlap.
    ``limit=None`` returns every match.  Null stock / offer read as 0.
    The column ``total_matches`` carries the number of matching products
    (the reference's ``total`` is only the page length).
    """
    cats = _categories_with_parent(categories).select(
        F.col("id").alias("_cid"), F.col("name").alias("category_name"),
        F.col("parent_name").alias("parent_category_name"))
    preds: list[Column] = []
    if min_price is not None:
        preds.append(F.col("price") >= F.lit(str(min_price)).cast("decimal(38,10)"))
    if max_price is not None:
        preds.append(F.col("price") <= F.lit(str(max_price)).cast("decimal(38,10)"))
    if product_types:
        preds.append(lower_in("product_type", product_types))
    if skin_types:
        preds.append(lower_in("skin_type", skin_types))
    if concerns:
        preds.append(lower_overlap("concerns", concerns))
    if search:
        pattern = f"%{search.lower()}%"
        preds.append(any_of([F.lower(F.coalesce(F.col(c), F.lit(""))).like(pattern)
                             for c in SEARCH_TEXT if c in products.columns]))
    found = products.filter(all_of(preds))
    if category:
        low = category.lower()
        wanted = cats.filter((F.lower("category_name") == low) | (F.lower("parent_category_name") == low)).select("_cid")
        found = found.join(wanted, F.col("category_id") == F.col("_cid"), "left_semi")
    total = found.select(F.count(F.lit(1))).scalar()
    newest = [F.col("created_at").desc_nulls_first(), F.col("id")]
    if limit is not None:  # the page first: categories and ratings are looked up for its rows alone
        found = _page(found, newest, page, limit)
        if reviews is not None:
            ids = found.select(F.col("id").alias("_page_id"))
            reviews = reviews.join(ids, F.col("product_id") == F.col("_page_id"), "left_semi")
    df = found.join(cats, F.col("category_id") == F.col("_cid"), "left").drop("_cid")
    df = _with_review_stats(df, reviews)
    keep = [c for c in ("id", "name", "description", "price", "category", "image_url", "image_url2",
                        "image_url3", "usage_instructions", "size", "benefits", "ingredients",
                        "product_details") if c in df.columns]
    return df.select(
        *keep,
        F.coalesce(F.col("stock_quantity"), F.lit(0)).alias("stock_quantity"),
        "created_at", "category_name", "parent_category_name", "average_rating", "review_count",
        F.coalesce(F.col("offer_percentage"), F.lit(0)).alias("offer_percentage"),
        total.alias("total_matches"),
    ).orderBy(*newest)


def product_detail(products: DataFrame, categories: DataFrame, reviews: DataFrame | None,
                   ids: list[int] | None = None, nested: bool = False, as_json: bool = False) -> DataFrame:
    """Q2: product, category name, rating, review count and its reviews.

    ``nested=True`` gives the reference's shape: a ``reviews`` array of
    {id, rating, comment, created_at, user_id} ([] when there is none) —
    meant for id lookups or bounded review sets.  ``as_json=True`` (with
    ``nested``) renders that array as JSON text, null fields kept.  The
    default is one row per review (``review_*`` columns; null for a product
    without reviews).
    """
    if as_json:
        out = product_detail(products, categories, reviews, ids, nested=True)
        return out.withColumn("reviews", F.to_json("reviews", {"ignoreNullFields": "false"}))
    p = products if ids is None else products.filter(F.col("id").isin(list(ids)))
    cats = categories.select(F.col("id").alias("_cid"), F.col("name").alias("category_name"))
    base = p.join(cats, F.col("category_id") == F.col("_cid"), "left").drop("_cid")
    base = _with_review_stats(base, reviews)
    if reviews is None:
        if nested:
            return base.withColumn("reviews", F.array().cast(
                "array<struct<id:bigint,rating:int,comment:string,created_at:timestamp_ntz,user_id:bigint>>"))
        return base
    r = reviews.select(F.col("product_id").alias("_rp"), F.col("id").alias("review_id"),
                       F.col("rating").alias("review_rating"), F.col("comment").alias("review_comment"),
                       F.col("created_at").alias("review_created_at"), F.col("user_id").alias("review_user_id"))
    if ids is not None:
        r = r.filter(F.col("_rp").isin(list(ids)))
    if not nested:
        return with_children(base, r, "id", "_rp")
    per_product = r.groupBy("_rp").agg(F.sort_array(F.collect_list(F.struct(
        F.col("review_id").alias("id"), F.col("review_rating").alias("rating"),
        F.col("review_comment").alias("comment"), F.col("review_created_at").alias("created_at"),
        F.col("review_user_id").alias("user_id")))).alias("reviews"))
    return (base.join(per_product, F.col("id") == F.col("_rp"), "left").drop("_rp")
            .withColumn("reviews", F.coalesce(F.col("reviews"), F.array().cast(per_product.schema["reviews"].dataType))))


def product_reviews(reviews: DataFrame, users: DataFrame, product_ids: list[int] | None = None,
                    sort: bool | None = None) -> DataFrame:
    """Q3: reviews with the author's name, newest first (orphans dropped).

    Newest first is per product: sorted by default only when
    ``product_ids`` narrows the result.
    """
    r = reviews if product_ids is None else reviews.filter(F.col("product_id").isin(list(product_ids)))
    u = users.select(F.col("id").alias("_uid"), F.col("name").alias("user_name"))
    out = r.join(u, F.col("user_id") == F.col("_uid"), "inner").drop("_uid")
    if sort or (sort is None and product_ids is not None):
        out = out.orderBy(F.col("created_at").desc_nulls_first(), F.col("id"))
    return out


def category_summary(categories: DataFrame, products: DataFrame, sort: bool = True) -> DataFrame:
    """Q4: every category with its parent's name and number of products in it."""
    counts = products.filter(F.col("category_id").isNotNull()).groupBy(
        F.col("category_id").alias("_cid")).agg(F.count("id").alias("product_count"))
    out = (_categories_with_parent(categories)
           .join(counts, F.col("id") == F.col("_cid"), "left").drop("_cid")
           .withColumn("product_count", F.coalesce(F.col("product_count"), F.lit(0)).cast("long")))
    if sort:
        out = out.orderBy(F.col("name"), F.col("id"))
    return out


def category_with_products(categories: DataFrame, products: DataFrame, ids: list[int] | None = None,
                           nested: bool = False) -> DataFrame:
    """Q5: a category, its parent's name and the products directly in it.

    Flat by default (``product_*`` columns, one row per product; a category
    without products keeps one row of nulls); ``nested=True`` collects the
    full product rows into ``products``.
    """
    cats = _categories_with_parent(categories)
    if ids is not None:
        cats = cats.filter(F.col("id").isin(list(ids)))
    prods = products.select(*[F.col(c).alias(f"product_{c}") for c in products.columns])
    if ids is not None:
        prods = prods.filter(F.col("product_category_id").isin(list(ids)))
    if not nested:
        prods = prods.withColumn("_category", F.col("product_category_id"))
        return with_children(cats, prods, "id", "_category")
    per_cat = prods.groupBy(F.col("product_category_id").alias("_cid")).agg(F.sort_array(F.collect_list(
        F.struct(*[F.col(f"product_{c}").alias(c) for c in products.columns]))).alias("products"))
    return (cats.join(per_cat, F.col("id") == F.col("_cid"), "left").drop("_cid")
            .withColumn("products", F.coalesce(F.col("products"), F.array().cast(per_cat.schema["products"].dataType))))


def inventory_report(products: DataFrame, categories: DataFrame, reviews: DataFrame,
                     order_items: DataFrame, category_id: int | None = None, search: str | None = None,
                     price_min=None, price_max=None, product_types: list[str] | None = None,
                     skin_types: list[str] | None = None, concerns: list[str] | None = None,
                     sort: bool = True) -> DataFrame:
    """Q6: the admin inventory list with rating, review and order counts.

    Unlike Q1 the type and concern filters are case-sensitive, search is an
    ILIKE over name and description only, and category is matched by id.
    Orders per product are distinct order ids of its items (the items'
    foreign key guarantees the order exists).
    """
    preds: list[Column] = []
    if category_id is not None:
        preds.append(F.col("category_id") == F.lit(int(category_id)))
    if search:
        pattern = f"%{search}%"
        preds.append(F.col("name").ilike(pattern) | F.col("description").ilike(pattern))
    if price_min is not None:
        preds.append(F.col("price") >= F.lit(str(price_min)).cast("decimal(38,10)"))
    if price_max is not None:
        preds.append(F.col("price") <= F.lit(str(price_max)).cast("decimal(38,10)"))
    if product_types:
        preds.append(F.col("product_type").isin(list(product_types)))
    if skin_types:
        preds.append(F.col("skin_type").isin(list(skin_types)))
    if concerns:
        preds.append(F.arrays_overlap("concerns", F.array(*[F.lit(c) for c in concerns])))
    p = products.filter(all_of(preds))
    cats = categories.select(F.col("id").alias("_cid"), F.col("name").alias("category_name"))
    orders_per_product = order_items.groupBy(F.col("product_id").alias("_opid")).agg(
        F.count_distinct("order_id").alias("order_count"))
    out = (p.join(cats, F.col("category_id") == F.col("_cid"), "left").drop("_cid"))
    out = _with_review_stats(out, reviews)
    out = (out.join(orders_per_product, F.col("id") == F.col("_opid"), "left").drop("_opid")
           .withColumn("order_count", F.coalesce(F.col("order_count"), F.lit(0)).cast("long")))
    if sort:
        out = out.orderBy(F.col("created_at").desc_nulls_first(), F.col("id"))
    return out
