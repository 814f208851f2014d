"""Registered queries Q1-Q6 (catalog)."""

from __future__ import annotations

from ..operators import catalog
from ..sources.fixtures import Shop
from .registry import register

_RATED = "(SELECT product_id, AVG(rating) AS stars, COUNT(*) AS n FROM shop_reviews GROUP BY product_id)"
_TREE = ("(SELECT own.id, own.name, up.name AS parent FROM shop_categories own"
         " LEFT JOIN shop_categories up ON up.id = own.parent_id)")

# Matches are picked and counted first; ratings join the picked rows.
_Q1_SELECT = f"""
SELECT hit.id, hit.name, hit.description, hit.price, hit.category, hit.image_url, hit.created_at,
       IFNULL(hit.stock_quantity, 0) AS stock_quantity, IFNULL(hit.offer_percentage, 0) AS offer_percentage,
       hit.category_name, hit.parent_category_name, hit.total_matches,
       IFNULL(rated.stars, 0) AS average_rating, IFNULL(rated.n, 0) AS review_count
FROM (SELECT p.*, tree.name AS category_name, tree.parent AS parent_category_name, COUNT(*) OVER () AS total_matches
      FROM shop_products p LEFT JOIN {_TREE} tree ON tree.id = p.category_id
      {{where}}) hit
LEFT JOIN {_RATED} rated ON rated.product_id = hit.id
ORDER BY hit.created_at DESC, hit.id
{{page}}
"""


@register("q01_catalog_search", oracle=_Q1_SELECT.format(where="", page="LIMIT 10 OFFSET 0"))
def q01_catalog_search(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return catalog.catalog_search(s.products, s.categories, s.reviews)


@register("q01_catalog_search_filtered", oracle=_Q1_SELECT.format(where="""
WHERE 'america' IN (LOWER(tree.name), LOWER(tree.parent))
  AND (p.name ILIKE '%ol%' OR p.description ILIKE '%ol%')
  AND p.price BETWEEN 920 AND 990
  AND LOWER(p.product_type) IN ('economy', 'small', 'standard', 'promo')""", page=""))
def q01_catalog_search_filtered(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return catalog.catalog_search(s.products, s.categories, s.reviews, category="america",
                                  search="OL", min_price=920, max_price=990,
                                  product_types=["economy", "SMALL", "Standard", "promo"], limit=None)


@register("q01_catalog_search_types_page3", oracle=_Q1_SELECT.format(where="""
WHERE LOWER(p.skin_type) IN ('brand#2', 'brand#7', 'brand#12')
  AND list_has_any(list_transform(p.concerns, lambda x: lower(x)), ['red', 'blue'])""",
                                                                      page="LIMIT 10 OFFSET 20"))
def q01_catalog_search_types_page3(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return catalog.catalog_search(s.products, s.categories, s.reviews,
                                  skin_types=["brand#2", "BRAND#7", "Brand#12"],
                                  concerns=["RED", "blue"], page=3, limit=10)


# Without a review table nothing is rated.
@register("q01_catalog_search_no_reviews_table", oracle=_Q1_SELECT.replace(
    _RATED, "(SELECT id AS product_id, CAST(0 AS DOUBLE) AS stars, CAST(0 AS BIGINT) AS n FROM shop_products)").format(
    where="WHERE p.name ILIKE '%ring%' OR p.description ILIKE '%ring%'", page=""))
def q01_catalog_search_no_reviews_table(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return catalog.catalog_search(s.products, s.categories, None, search="ring", limit=None)


_PRODUCT_COLS = ("p.id, p.name, p.description, p.price, p.category, p.image_url, p.category_id, "
                 "p.stock_quantity, p.created_at, p.offer_percentage, p.product_type, p.skin_type, "
                 "p.concerns")


@register("q02_product_detail", oracle=f"""
SELECT {_PRODUCT_COLS}, c.name AS category_name,
       COALESCE(s.avg_rating, 0) AS average_rating, COALESCE(s.n, 0) AS review_count,
       r.id AS review_id, r.rating AS review_rating, r.comment AS review_comment,
       r.created_at AS review_created_at, r.user_id AS review_user_id
FROM shop_products p
LEFT JOIN shop_categories c ON p.category_id = c.id
LEFT JOIN (SELECT product_id, AVG(rating) AS avg_rating, COUNT(id) AS n FROM shop_reviews
           GROUP BY product_id) s ON s.product_id = p.id
LEFT JOIN shop_reviews r ON r.product_id = p.id
""")
def q02_product_detail(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return catalog.product_detail(s.products, s.categories, s.reviews)


@register("q03_product_reviews", oracle="""
SELECT r.*, u.name AS user_name
FROM shop_reviews r JOIN shop_users u ON r.user_id = u.id
""")
def q03_product_reviews(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return catalog.product_reviews(s.reviews, s.users)


@register("q04_category_summary", oracle=f"""
SELECT own.*, tree.parent AS parent_name,
       (SELECT COUNT(*) FROM shop_products p WHERE p.category_id = own.id) AS product_count
FROM shop_categories own JOIN {_TREE} tree USING (id)
""")
def q04_category_summary(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return catalog.category_summary(s.categories, s.products)


@register("q05_category_with_products", oracle="""
SELECT c.*, pa.name AS parent_name,
       p.id AS product_id, p.name AS product_name, p.description AS product_description,
       p.price AS product_price, p.category AS product_category, p.image_url AS product_image_url,
       p.category_id AS product_category_id, p.stock_quantity AS product_stock_quantity,
       p.created_at AS product_created_at, p.offer_percentage AS product_offer_percentage,
       p.product_type AS product_product_type, p.skin_type AS product_skin_type,
       p.concerns AS product_concerns
FROM shop_categories c
LEFT JOIN shop_categories pa ON c.parent_id = pa.id
LEFT JOIN shop_products p ON p.category_id = c.id
""")
def q05_category_with_products(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return catalog.category_with_products(s.categories, s.products)


_Q6 = f"""
SELECT {_PRODUCT_COLS}, (SELECT c.name FROM shop_categories c WHERE c.id = p.category_id) AS category_name,
       IFNULL(rated.stars, 0) AS average_rating, IFNULL(rated.n, 0) AS review_count,
       IFNULL(sold.n, 0) AS order_count
FROM shop_products p
LEFT JOIN {_RATED} rated ON rated.product_id = p.id
LEFT JOIN (SELECT product_id, COUNT(DISTINCT order_id) AS n FROM shop_order_items
           WHERE order_id IN (SELECT id FROM shop_orders) GROUP BY product_id) sold ON sold.product_id = p.id
{{where}}
"""


@register("q06_inventory_report", oracle=_Q6.format(where=""))
def q06_inventory_report(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return catalog.inventory_report(s.products, s.categories, s.reviews, s.order_items)


@register("q06_inventory_report_filtered", oracle=_Q6.format(where="""
WHERE p.category_id = 3
  AND (p.name ILIKE '%O%' OR p.description ILIKE '%O%')
  AND p.price BETWEEN 901.5 AND 995
  AND p.product_type IN ('ECONOMY', 'SMALL', 'PROMO', 'large')
  AND list_has_any(p.concerns, ['red', 'ring', 'Bolt'])"""))
def q06_inventory_report_filtered(spark, sf_dir):
    s = Shop.of(spark, sf_dir)
    return catalog.inventory_report(s.products, s.categories, s.reviews, s.order_items,
                                    category_id=3, search="O", price_min="901.5", price_max=995,
                                    product_types=["ECONOMY", "SMALL", "PROMO", "large"],
                                    concerns=["red", "ring", "Bolt"])
