"""Driver tables -> the shop's 12 tables (FIXTURES.md, part A).

Every table is a lazy DataFrame built with built-in column expressions, so
Catalyst prunes unused columns and pushes filters into the Parquet scans.
The DuckDB twin of each mapping lives in ``shopfront.plans.oracle``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import DEC, NTZ

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
              "lineitem", "events")


def _days(base: str, n: Column) -> Column:
    """``date base + n`` as a zone-less timestamp."""
    return F.date_add(F.lit(base).cast("date"), n.cast("int")).cast(NTZ)


def _event_key() -> Column:
    # K in FIXTURES.md: the number inside props = '{"k": n}'
    return F.regexp_extract("props", r"([0-9]+)", 1).cast("int")


def _rating(value: Column) -> Column:
    return (F.lit(1) + F.floor(value) % 5).cast("int")


class RawTables:
    """Driver parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW_TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self.__dict__[name] = df
            return df
        raise AttributeError(name)


class Shop:
    """The 12 shop tables derived from the driver tables (all lazy)."""

    _cache: dict = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Shop":
        """One instance per (session, folder): file listings and plans are built once."""
        key = (spark, sf_dir.rstrip("/"))
        if key not in cls._cache:
            cls._cache[key] = cls(spark, sf_dir)
        return cls._cache[key]

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.raw = RawTables(spark, sf_dir)

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def users(self) -> DataFrame:
        c = self.raw.customer
        digits = (F.lit(9000000000) + F.col("c_custkey") * 7).cast("string")
        phone = (F.when(F.col("c_custkey") % 6 == 0, F.lit(None).cast("string"))
                 .when(F.col("c_custkey") % 6 == 1,
                       F.concat(F.substring(digits, 1, 5), F.lit("-"), F.substring(digits, 6, 5)))
                 .when(F.col("c_custkey") % 6 == 2, F.substring(digits, 1, 9))
                 .otherwise(digits))
        return c.select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.when(F.col("c_custkey") % 50 == 0, "admin").otherwise("user").alias("role"),
            phone.alias("phone"),
            _days("1995-01-01", F.col("c_custkey") % 900).alias("created_at"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        parents = self.raw.region.select(
            (F.col("r_regionkey") + 100).cast("long").alias("id"),
            F.col("r_name").alias("name"),
            F.lit(None).cast("long").alias("parent_id"),
        )
        children = self.raw.nation.select(
            F.col("n_nationkey").cast("long").alias("id"),
            F.col("n_name").alias("name"),
            (F.col("n_regionkey") + 100).cast("long").alias("parent_id"),
        )
        return parents.unionByName(children).select(
            "id", "name",
            F.concat(F.lit("All about "), F.col("name")).alias("description"),
            "parent_id",
            _days("1994-01-01", F.col("id")).alias("created_at"),
        )

    @cached_property
    def products(self) -> DataFrame:
        p = self.raw.part
        return p.select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.concat_ws(" ", "p_brand", "p_type").alias("description"),
            F.col("p_retailprice").cast(DEC).alias("price"),
            F.col("p_type").alias("category"),
            F.concat(F.lit("/img/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("image_url"),
            F.when(F.col("p_size") == 50, F.lit(None).cast("long"))
             .otherwise(F.substring("p_brand", 7, 10).cast("int") - 1).cast("long").alias("category_id"),
            (F.col("p_size") * 40).alias("stock_quantity"),
            _days("1996-01-01", F.col("p_partkey") % 700).alias("created_at"),
            F.when(F.col("p_size") % 4 == 0, F.lit(None).cast("int"))
             .otherwise(F.col("p_size")).alias("offer_percentage"),
            F.col("p_type").alias("product_type"),
            F.col("p_brand").alias("skin_type"),
            F.split("p_name", " ").cast("array<string>").alias("concerns"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        o = self.raw.orders
        prio, st = F.col("o_orderpriority"), F.col("o_orderstatus")
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_totalprice").cast(DEC).alias("total_amount"),
            F.when(st == "O", "pending").when(st == "P", "processing")
             .when(st == "F", "delivered").alias("status"),
            F.col("o_orderdate").cast(NTZ).alias("created_at"),
            F.when(prio == "5-LOW", "COD").when(prio == "4-NOT SPECIFIED", F.lit(None))
             .otherwise("online").alias("payment_method"),
            F.when(prio == "4-NOT SPECIFIED", "cod").alias("payment_method_type"),
            F.when((prio == "2-HIGH") & (st == "P"), True)
             .when(prio == "3-MEDIUM", F.lit(None).cast("boolean"))
             .otherwise(False).alias("is_temporary"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self.raw.lineitem.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").cast(DEC).alias("price_at_time"),
        )

    def _events(self, kind: str) -> DataFrame:
        return self.raw.events.filter(F.col("event_type") == kind)

    def _first_per(self, kind: str, keys: list) -> DataFrame:
        """First event (lowest event_id) per key, as a partial aggregate."""
        ev = self._events(kind).select(
            "user_id", _event_key().alias("k"),
            F.struct("event_id", "value", "ts").alias("e"))
        return ev.groupBy(*keys).agg(F.min("e").alias("e"))

    @cached_property
    def reviews(self) -> DataFrame:
        first = self._first_per("purchase", ["user_id", "k"])
        return first.select(
            F.col("e.event_id").alias("id"),
            F.col("k").cast("long").alias("product_id"),
            "user_id",
            _rating(F.col("e.value")).alias("rating"),
            F.when(F.col("e.event_id") % 3 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("review of "), F.col("k").cast("string"))).alias("comment"),
            F.col("e.ts").cast(NTZ).alias("created_at"),
        )

    @cached_property
    def brand_reviews(self) -> DataFrame:
        first = self._first_per("signup", ["user_id"])
        return first.select(
            F.col("e.event_id").alias("id"),
            "user_id",
            _rating(F.col("e.value")).alias("rating"),
            F.concat(F.lit("brand note "), F.col("e.event_id").cast("string")).alias("comment"),
            F.col("e.ts").cast(NTZ).alias("created_at"),
        )

    @cached_property
    def wishlist(self) -> DataFrame:
        ev = self._events("click").select("user_id", _event_key().alias("k"), "event_id", "ts")
        return ev.groupBy("user_id", "k").agg(
            F.min("event_id").alias("id"), F.min("ts").cast(NTZ).alias("created_at")
        ).select("id", "user_id", F.col("k").cast("long").alias("product_id"), "created_at")

    @cached_property
    def cart(self) -> DataFrame:
        ev = self._events("view").select("user_id", _event_key().alias("k"), "event_id", "ts")
        agg = ev.groupBy("user_id", "k").agg(
            F.min("event_id").alias("id"),
            F.sum(F.lit(1) + F.col("event_id") % 3).cast("int").alias("quantity"),
            F.min("ts").cast(NTZ).alias("created_at"))
        return agg.select("id", "user_id", F.col("k").cast("long").alias("product_id"),
                          "quantity", (F.col("id") % 2 == 0).alias("selected"), "created_at")

    @cached_property
    def coupons(self) -> DataFrame:
        n = self.raw.nation
        cid = F.col("n_nationkey").cast("long")
        return n.select(
            cid.alias("id"),
            F.concat(F.lit("CODE"), cid.cast("string")).alias("code"),
            F.concat(F.lit("Coupon "), cid.cast("string")).alias("description"),
            F.when(cid % 2 == 0, "percentage").otherwise("fixed").alias("discount_type"),
            (cid + 5).cast(DEC).alias("discount_value"),
            (cid * 100).cast(DEC).alias("min_purchase_amount"),
            F.when(cid % 3 == 0, F.lit(50)).cast(DEC).alias("max_discount_amount"),
            F.lit("2024-01-01").cast("date").cast(NTZ).alias("start_date"),
            _days("2024-01-10", cid).alias("end_date"),
            F.when(cid % 4 == 0, F.lit(None)).otherwise(cid).cast("int").alias("usage_limit"),
            (cid % 6).cast("int").alias("times_used"),
            (cid % 7 != 6).alias("is_active"),
            _days("2023-12-01", cid).alias("created_at"),
        )

    @cached_property
    def coupon_products(self) -> DataFrame:
        n = self.raw.nation.filter(F.col("n_nationkey") % 5 != 0).select("n_nationkey")
        p = self.raw.part.select(
            "p_partkey", (F.substring("p_brand", 7, 10).cast("int") - 1).alias("brand_ix"))
        # nation is a 25-row dimension: a bounded broadcast side
        return p.join(F.broadcast(n), p.brand_ix == n.n_nationkey).select(
            F.col("p_partkey").alias("id"),
            F.col("n_nationkey").cast("long").alias("coupon_id"),
            F.col("p_partkey").alias("product_id"))

    @cached_property
    def addresses(self) -> DataFrame:
        o = self.raw.orders
        agg = o.groupBy("o_custkey", "o_orderpriority").agg(
            F.min("o_orderkey").alias("id"), F.min("o_orderdate").alias("created_at"))
        prio = F.col("o_orderpriority")
        return agg.select(
            "id",
            F.col("o_custkey").alias("user_id"),
            F.concat(F.lit("Line "), F.col("id").cast("string")).alias("address_line1"),
            F.when(F.col("id") % 2 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("Floor "), (F.col("id") % 9).cast("string"))).alias("address_line2"),
            F.concat(F.lit("City "), (F.col("id") % 10).cast("string")).alias("city"),
            (F.lit(9000000000) + F.col("id")).cast("string").alias("phone_number"),
            prio.alias("address_type"),
            F.when(prio == "1-URGENT", True).when(prio == "4-NOT SPECIFIED", F.lit(None).cast("boolean"))
             .otherwise(False).alias("is_default"),
            F.col("created_at").cast(NTZ).alias("created_at"),
        )


SHOP_TABLES = ("users", "categories", "products", "orders", "order_items", "reviews",
               "brand_reviews", "wishlist", "cart", "coupons", "coupon_products", "addresses")


def quote_carts(shop: Shop) -> DataFrame:
    """Test carts for Q16/Q17: one cart per user built from the user's cart rows.

    cart_id = user_id, line order = product id, code = 'code' || user_id % 27
    (codes 25 and 26 do not exist; lower case exercises the case-blind match).
    """
    return shop.cart.select(
        F.col("user_id").alias("cart_id"),
        F.concat(F.lit("code"), (F.col("user_id") % 27).cast("string")).alias("code"),
        F.col("product_id").alias("line_no"),
        "product_id", "quantity")


QUOTE_AS_OF = "2024-01-15 00:00:00"
