"""Declared table types: read with them, and report the rows that break them.

``read_typed`` gives every declared column its declared type whatever a file
holds or lacks.  ``enforce`` splits rows into those that keep the declaration
(NOT NULL, text lengths, value lists) and those that break it, with the rules
they break.  Both are projections and filters over one scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import check_rules

_STAMPS = "created_at timestamp_ntz, updated_at timestamp_ntz"

# The columns of the shop tables.  Ids are 64-bit here; times have no zone.
DECLARED = {
    "users": f"id bigint not null, email varchar(255) not null, password varchar(255) not null, "
             f"name varchar(255) not null, role varchar(50), photo_url string, phone varchar(20), {_STAMPS}",
    "categories": "id bigint not null, name varchar(100) not null, description string, image_url string, "
                  "parent_id bigint, created_at timestamp_ntz",
    "products": "id bigint not null, name varchar(255) not null, description string, price decimal(10,2) not null, "
                "category varchar(100) not null, image_url string, stock_quantity int, created_at timestamp_ntz, "
                "image_url2 string, image_url3 string, usage_instructions string, size varchar(50), benefits string, "
                "ingredients string, product_details string, offer_percentage int, category_id bigint",
    "coupons": "id bigint not null, code varchar(50) not null, description string, discount_type varchar(20) not null, "
               "discount_value decimal(10,2) not null, min_purchase_amount decimal(10,2), "
               "max_discount_amount decimal(10,2), start_date timestamp_ntz not null, end_date timestamp_ntz not null, "
               f"usage_limit int, times_used int, is_active boolean, {_STAMPS}",
    "orders": "id bigint not null, user_id bigint, total_amount decimal(10,2) not null, status varchar(50), "
              "created_at timestamp_ntz",
    "order_items": "id bigint not null, order_id bigint, product_id bigint, quantity int not null, "
                   "price_at_time decimal(10,2) not null, created_at timestamp_ntz, coupon_id bigint, "
                   "discount_amount decimal(10,2)",
    "cart": "id bigint not null, user_id bigint, product_id bigint, quantity int not null, selected boolean, "
            "created_at timestamp_ntz",
    "wishlist": "id bigint not null, user_id bigint, product_id bigint, created_at timestamp_ntz",
    "addresses": "id bigint not null, user_id bigint, full_name varchar(255) not null, phone_number varchar(20) not null, "
                 "address_line1 string not null, address_line2 string, city varchar(100) not null, "
                 "state varchar(100) not null, postal_code varchar(20) not null, country varchar(100), "
                 f"address_type varchar(20), is_default boolean, {_STAMPS}",
    "coupon_products": "id bigint not null, coupon_id bigint, product_id bigint, created_at timestamp_ntz",
    "reviews": "id bigint not null, user_id bigint, product_id bigint, rating int, comment string, created_at timestamp_ntz",
    "brand_reviews": "id bigint not null, user_id bigint, rating int, comment string, created_at timestamp_ntz",
}
CHECKED = {"coupons": [("discount_type", "discount_type")], "reviews": [("stars", "rating")],
           "brand_reviews": [("stars", "rating")]}
CORRUPT = "_malformed"

_COLUMN = re.compile(r"(\w+) (varchar\((\d+)\)|decimal\(\d+,\d+\)|\w+)( not null)?(?:, |$)")


def _columns(table: str) -> list[tuple[str, str, int | None, bool]]:
    """(name, Spark type, longest text, NOT NULL) of each declared column."""
    return [(name, "string" if most else kind, int(most) if most else None, bool(required))
            for name, kind, most, required in _COLUMN.findall(DECLARED[table])]


def declared_type(table: str) -> str:
    """The DDL of a table's StructType (``spark.read.schema`` takes it); lengths and NOT NULL are ``enforce``'s."""
    return ", ".join(f"{name} {kind}" for name, kind, _, _ in _columns(table))


def rules_of(table: str, columns: list[str] | None = None) -> list[tuple[str, str]]:
    """Rules [(rule, column)] of ``check_rules`` that a table's declaration makes (on ``columns`` alone, if given)."""
    rules = []
    for name, _, most, required in _columns(table):
        rules += [("not_null", name)] * required + ([(f"max_length:{most}", name)] if most else [])
    rules += CHECKED.get(table, [])
    return [r for r in rules if columns is None or r[1] in columns]


def read_typed(spark: SparkSession, path: str, table: str, fmt: str = "parquet", **options) -> DataFrame:
    """``path`` read with the declared type: other columns are not read, absent ones are null.

    Text formats (csv, json) keep a row that does not fit its types: its text is
    in ``_malformed`` (null for all other rows), and what could be parsed in its columns.
    """
    ddl = declared_type(table)
    reader = spark.read.options(**options)
    if fmt in ("csv", "json"):
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        ddl += f", {CORRUPT} string"
    return reader.schema(ddl).format(fmt).load(path)


def enforce(df: DataFrame, table: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the declaration of ``table``, the others with ``broken_rules``); malformed rows break it."""
    checked = check_rules(df, rules_of(table, columns or df.columns)).drop("broken", "n_broken")
    if CORRUPT in df.columns:
        checked = checked.withColumn("broken_rules", F.when(F.col(CORRUPT).isNotNull(), F.concat_ws(
            ",", F.lit("malformed"), F.when(F.col("broken_rules") != "", F.col("broken_rules")))).otherwise(F.col("broken_rules")))
    kept = checked.filter(F.col("broken_rules") == "").drop("broken_rules", CORRUPT)
    return kept, checked.filter(F.col("broken_rules") != "")
