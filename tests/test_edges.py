"""Hand-written edge cases (FIXTURES.md part B) for the query and change operators."""

import datetime as dt
import hashlib
import hmac
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from shopfront.functions.columns import avg_1dp
from shopfront.operators import access, catalog, changes as C, kpis, orders, people, promotions, quality

T = dt.datetime


def D(x):
    return Decimal(str(x))


@pytest.fixture(scope="module")
def shop(spark):
    products = spark.createDataFrame([
        (1, "Rose Cream", "soft cream", D("10.00"), "Face", 3, 5, T(2024, 1, 3), None, "cream", "dry", ["Dry", "Acne"]),
        (2, "Blue Serum", "serum", D("20.00"), "Face", 4, None, T(2024, 1, 2), 10, "serum", "oily", ["oily"]),
        (3, "Unsold", "nothing", D("5.00"), "Body", None, 7, T(2024, 1, 1), None, "lotion", "dry", []),
    ], "id long, name string, description string, price decimal(10,2), category string, category_id long, "
       "stock_quantity int, created_at timestamp_ntz, offer_percentage int, product_type string, "
       "skin_type string, concerns array<string>")
    categories = spark.createDataFrame([
        (3, "Creams", 9, T(2024, 1, 1)), (4, "Serums", 9, T(2024, 1, 1)), (9, "Skincare", None, T(2024, 1, 1)),
    ], "id long, name string, parent_id long, created_at timestamp_ntz")
    order_items = spark.createDataFrame([
        (100, 1, 2, D("10.00")), (101, 1, 1, D("10.00")),
    ], "order_id long, product_id long, quantity int, price_at_time decimal(10,2)")
    reviews = spark.createDataFrame([
        (1, 1, 7, 5, "great", T(2024, 1, 5)), (2, 1, 8, 4, None, T(2024, 1, 6)), (3, 1, 9, 4, "ok", T(2024, 1, 7)),
    ], "id long, product_id long, user_id long, rating int, comment string, created_at timestamp_ntz")
    wishlist = spark.createDataFrame([
        (1, 7, 1, T(2024, 1, 1)), (2, 8, 1, T(2024, 1, 1)),
    ], "id long, user_id long, product_id long, created_at timestamp_ntz")
    return dict(products=products, categories=categories, order_items=order_items, reviews=reviews,
                wishlist=wishlist)


def test_revenue_desc_puts_unsold_first(shop):
    out = kpis.product_performance(shop["products"], shop["order_items"], shop["reviews"], shop["wishlist"])
    got = [r["id"] for r in out.collect()]
    assert got[0] in (2, 3) and got[1] in (2, 3)   # never-sold products (null revenue) first
    assert got[-1] == 1


def test_fan_out_as_written_multiplies_by_reviews_and_wishlist(shop):
    out = kpis.product_performance(shop["products"], shop["order_items"], shop["reviews"], shop["wishlist"],
                                   as_written=True, sort=False)
    r = {d["id"]: d for d in rows(out)}
    # 2 items x 3 reviews x 2 wishlist rows: units 3 -> 18, revenue 30 -> 180
    assert r[1]["total_units_sold"] == 18 and r[1]["total_revenue"] == D("180.00")
    assert r[1]["average_rating"] == pytest.approx(13 / 3)
    assert r[1]["review_count"] == 3 and r[1]["wishlist_count"] == 2 and r[1]["total_orders"] == 2
    fixed = {d["id"]: d for d in rows(kpis.product_performance(
        shop["products"], shop["order_items"], shop["reviews"], shop["wishlist"], sort=False))}
    assert fixed[1]["total_units_sold"] == 3 and fixed[1]["total_revenue"] == D("30.00")
    assert fixed[3]["total_units_sold"] is None and fixed[3]["total_orders"] == 0


def test_avg_one_decimal_rounds_half_away_without_double_rounding(spark):
    df = spark.createDataFrame([(13, 4), (1, 2), (81, 25), (32499, 10000)], "t long, n long")
    got = [r[0] for r in df.select(avg_1dp(F.col("t"), F.col("n"))).collect()]
    # 3.25 -> 3.3 ; 0.5 -> 0.5 ; 3.24 -> 3.2 ; 3.2499 -> 3.2 (no 3.25 -> 3.3 double rounding)
    assert got == [D("3.3"), D("0.5"), D("3.2"), D("3.2")]


def test_catalog_search_filters_and_paging(shop):
    out = catalog.catalog_search(shop["products"], shop["categories"], shop["reviews"], category="SKINCARE",
                                 concerns=["acne", "OILY"], limit=1, page=2)
    got = rows(out)
    assert [r["id"] for r in got] == [2]      # newest first: 1 (Jan 3), then 2 (Jan 2)
    assert got[0]["total_matches"] == 2 and got[0]["parent_category_name"] == "Skincare"
    assert got[0]["stock_quantity"] == 0 and got[0]["offer_percentage"] == 10
    none = catalog.catalog_search(shop["products"], shop["categories"], None, search="CREAM", limit=None)
    assert [(r["id"], r["average_rating"], r["review_count"]) for r in rows(none)] == [(1, 0.0, 0)]


def test_product_detail_nested_empty_list(shop):
    out = catalog.product_detail(shop["products"], shop["categories"], shop["reviews"], nested=True)
    got = {r["id"]: r for r in rows(out)}
    assert got[3]["reviews"] == [] and len(got[1]["reviews"]) == 3 and got[1]["review_count"] == 3


def test_product_detail_reviews_as_json_keep_nulls(shop):
    import json
    out = catalog.product_detail(shop["products"], shop["categories"], shop["reviews"], nested=True, as_json=True)
    got = {r["id"]: r["reviews"] for r in rows(out)}
    assert json.loads(got[3]) == []
    first = json.loads(got[1])
    assert len(first) == 3 and set(first[0]) == {"id", "rating", "comment", "created_at", "user_id"}


def test_inventory_filters_are_case_sensitive(shop):
    out = catalog.inventory_report(shop["products"], shop["categories"], shop["reviews"], shop["order_items"],
                                   concerns=["dry"])
    assert rows(out) == []
    out = catalog.inventory_report(shop["products"], shop["categories"], shop["reviews"], shop["order_items"],
                                   concerns=["Dry"], search="CREAM")
    assert [(r["id"], r["order_count"]) for r in rows(out)] == [(1, 2)]


# ---------------------------------------------------------------- coupons

@pytest.fixture(scope="module")
def coupons(spark):
    cp = spark.createDataFrame([
        # id code type value min max start end limit used active created
        (1, "PCT10", "percentage", D(10), D(0), D(3), T(2024, 1, 1), T(2024, 1, 31), None, 0, True),
        (2, "FIX50", "fixed", D(50), D(0), None, T(2024, 1, 1), T(2024, 1, 31), 5, 1, True),
        (3, "OFF", "fixed", D(5), D(0), None, T(2024, 1, 1), T(2024, 1, 31), None, 0, False),
        (4, "OLD", "fixed", D(5), D(0), None, T(2023, 1, 1), T(2023, 1, 31), None, 0, True),
        (5, "FULL", "fixed", D(5), D(0), None, T(2024, 1, 1), T(2024, 1, 31), 2, 2, True),
        (6, "BIG", "fixed", D(5), D(1000), None, T(2024, 1, 1), T(2024, 1, 31), None, 0, True),
        (7, "NULLACT", "fixed", D(5), D(0), None, T(2024, 1, 1), T(2024, 1, 31), None, 0, None),
        (8, "FIXCAP", "fixed", D(30), D(0), D(12), T(2024, 1, 1), T(2024, 1, 31), None, 0, True),
        (9, "LINKED", "fixed", D(30), D(0), D(12), T(2024, 1, 1), T(2024, 1, 31), None, 0, True),
    ], "id long, code string, discount_type string, discount_value decimal(10,2), "
       "min_purchase_amount decimal(10,2), max_discount_amount decimal(10,2), start_date timestamp_ntz, "
       "end_date timestamp_ntz, usage_limit int, times_used int, is_active boolean")
    links = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 9, 1), (4, 9, 2), (5, 9, 3)],
                                  "id long, coupon_id long, product_id long")
    prices = spark.createDataFrame([(1, D("10.00")), (2, D("20.00")), (3, D("0.00"))],
                                   "id long, price decimal(10,2)")
    return cp, links, prices


def _carts(spark, rows_):
    return spark.createDataFrame(rows_, "cart_id long, code string, line_no long, product_id long, quantity int")


def test_quote_reject_chain(spark, coupons):
    cp, links, prices = coupons
    carts = _carts(spark, [(1, "nope", 1, 1, 1), (2, "off", 1, 1, 1), (3, "old", 1, 1, 1), (4, "full", 1, 1, 1),
                           (5, "big", 1, 1, 1), (6, "nullact", 1, 1, 1), (7, "pct10", 1, 99, 1)])
    got = {r["cart_id"]: r for r in rows(promotions.coupon_quote(carts, cp, links, prices, "2024-01-15"))}
    assert got[1]["reason"] == "Invalid coupon code"
    assert got[2]["reason"] == "This coupon is no longer active"
    assert got[6]["reason"] == "This coupon is no longer active"
    assert got[3]["reason"] == "This coupon has expired"
    assert got[4]["reason"] == "This coupon has reached its usage limit"
    assert got[5]["reason"] == "Minimum purchase amount of ₹1000.00 required"
    # only an unknown product: totals 0, still a valid quote of 0
    assert got[7]["valid"] and got[7]["total_amount"] == D("0.00") and got[7]["discount_amount"] == 0


def test_quote_amounts_cap_and_b2(spark, coupons):
    cp, links, prices = coupons
    carts = _carts(spark, [(1, "PCT10", 1, 1, 5), (1, "PCT10", 2, 2, 1),      # applicable 50 -> 5, cap 3
                           (2, "fix50", 1, 1, 2),                            # fixed 50 > applicable 20
                           (3, "fixcap", 1, 2, 1)])                          # no product rows: applies to all
    got = {r["cart_id"]: r for r in rows(promotions.coupon_quote(carts, cp, links, prices, "2024-01-15"))}
    assert got[1]["discount_amount"] == D(3) and got[1]["applicable_amount"] == D("50.00")
    assert got[2]["discount_amount"] == D(20)
    assert got[3]["discount_amount"] == D(20)      # the quote never caps fixed coupons (B10)
    as_written = {r["cart_id"]: r for r in rows(
        promotions.coupon_quote(carts, cp, links, prices, "2024-01-15", as_written=True))}
    assert as_written[3]["discount_amount"] == D(0)   # [null] product list: nothing applies (B2)


def test_allocation_shared_vs_running_and_cap(spark, coupons):
    cp, links, prices = coupons
    carts = _carts(spark, [(1, "LINKED", 1, 1, 1), (1, "LINKED", 2, 2, 1), (1, "LINKED", 3, 3, 4)])
    shared = {r["line_no"]: r["line_discount"] for r in rows(
        promotions.coupon_allocation(carts, cp, links, prices, "2024-01-15"))}
    # shares 30*10/30=10 and 30*20/30=20 -> sum 30 > cap 12 -> scaled by 12/30; zero-price line gets 0
    assert shared == pytest.approx({1: 4.0, 2: 8.0, 3: 0.0})
    running = {r["line_no"]: r["line_discount"] for r in rows(
        promotions.coupon_allocation(carts, cp, links, prices, "2024-01-15", as_written=True))}
    # running totals 10 and 30: 30*10/10=30, 30*20/30=20 -> sum 50 -> scaled to 12: 7.2 and 4.8
    assert running == pytest.approx({1: 7.2, 2: 4.8, 3: 0.0})
    assert sum(running.values()) <= 12 + 1e-9
    # a coupon without product rows: intended applies to all, as written to nothing (B2)
    open_cart = _carts(spark, [(2, "fixcap", 1, 1, 1), (2, "fixcap", 2, 2, 1)])
    b2 = rows(promotions.coupon_allocation(open_cart, cp, links, prices, "2024-01-15"), ["line_no"])
    assert [r["line_discount"] for r in b2] == pytest.approx([4.0, 8.0])
    b2w = rows(promotions.coupon_allocation(open_cart, cp, links, prices, "2024-01-15", as_written=True),
               ["line_no"])
    assert [r["line_discount"] for r in b2w] == [0.0, 0.0]


# ---------------------------------------------------------------- order batches

@pytest.fixture(scope="module")
def order_tables(spark):
    orders_ = spark.createDataFrame([
        (10, 1, D("5.00"), "pending_payment", T(2024, 1, 1), "online", "online", True),
        (11, 2, D("7.00"), "pending", T(2024, 1, 2), "cod", "cod", False),
        (12, 1, D("9.00"), "pending_payment", T(2023, 1, 2), "online", "online", True),
    ], "id long, user_id long, total_amount decimal(10,2), status string, created_at timestamp_ntz, "
       "payment_method string, payment_method_type string, is_temporary boolean")
    items = spark.createDataFrame([(10, 1, 2, D("10.00")), (11, 2, 1, D("20.00")), (12, 1, 1, D("10.00"))],
                                  "order_id long, product_id long, quantity int, price_at_time decimal(10,2)")
    products = spark.createDataFrame([(1, D("10.00"), 1), (2, D("20.00"), 0)],
                                     "id long, price decimal(10,2), stock_quantity int")
    cart = spark.createDataFrame([(1, 1, 1, 1, False), (2, 2, 2, 1, False), (3, 3, 1, 1, True)],
                                 "id long, user_id long, product_id long, quantity int, selected boolean")
    return orders_, items, products, cart


def test_ingest_orders_batch(spark, order_tables):
    orders_, items, products, cart = order_tables
    req = spark.createDataFrame([(1, 1, "cod", None), (2, 3, "cod", D("3.00")), (3, 2, "bitcoin", D("1")),
                                 (4, 2, "online", D("2.00")), (5, 3, "cod", D("4.00"))],
                                "seq long, user_id long, payment_method string, total_amount decimal(10,2)")
    lines = spark.createDataFrame([(1, 2, 1), (2, 2, 2), (3, 1, 1), (4, 1, 1), (5, 2, 1), (5, 99, 1)],
                                  "seq long, product_id long, quantity int")
    ch = C.ingest_orders(orders_, items, products, cart, req, lines, "2024-02-01")
    out = {r["seq"]: r for r in rows(ch.outcome)}
    assert out[3]["error"] == "Invalid payment method" and out[5]["error"] == "Product not found"
    assert out[1]["order_id"] == 14 and out[1]["status"] == "pending" and out[4]["status"] == "pending_payment"
    stock = {r["id"]: r["stock_quantity"] for r in rows(ch.tables["products"])}
    assert stock == {1: 1, 2: -3}          # two cod orders of product 2 sum up; stock may go negative
    new = {r["id"]: r for r in rows(ch.tables["orders"])}
    assert new[14]["total_amount"] == D("0.00") and new[17]["is_temporary"] is True
    assert sorted(r["user_id"] for r in rows(ch.tables["cart"])) == [2]   # cod buyers 1 and 3 emptied
    new_items = [r for r in rows(ch.tables["order_items"]) if r["order_id"] >= 14]
    assert sorted((r["order_id"], r["price_at_time"]) for r in new_items) == [
        (14, D("20.00")), (15, D("20.00")), (17, D("10.00"))]


def test_confirm_and_cancel(spark, order_tables):
    orders_, items, products, cart = order_tables
    pays = spark.createDataFrame([(1, 10, 2, "p1"), (2, 10, 1, "p2"), (3, 10, 1, "p3"), (4, 11, 2, "p4")],
                                 "seq long, order_id long, user_id long, payment_id string")
    ch = C.confirm_payments(orders_, items, products, cart, pays)
    out = {r["seq"]: r["error"] for r in rows(ch.outcome)}
    assert out == {1: "Order not found or not a temporary order", 2: None,
                   3: "Order not found or not a temporary order", 4: "Order not found or not a temporary order"}
    o = {r["id"]: r for r in rows(ch.tables["orders"])}
    assert o[10]["status"] == "confirmed" and o[10]["payment_id"] == "p2" and o[10]["is_temporary"] is False
    assert {r["id"]: r["stock_quantity"] for r in rows(ch.tables["products"])} == {1: -1, 2: 0}
    cancels = spark.createDataFrame([(1, 12, 1), (2, 11, 2)], "seq long, order_id long, user_id long")
    cc = C.cancel_temporary(orders_, items, cancels)
    assert sorted(r["id"] for r in rows(cc.tables["orders"])) == [10, 11]
    assert sorted(r["order_id"] for r in rows(cc.tables["order_items"])) == [10, 11]
    stale = C.purge_stale(orders_, items, "2023-06-01")
    assert sorted(r["id"] for r in rows(stale.tables["orders"])) == [10, 11]


def test_status_change_last_valid_wins(spark, order_tables):
    orders_ = order_tables[0]
    chg = spark.createDataFrame([(1, 10, "shipped"), (2, 10, "lost"), (3, 10, "delivered"), (4, 99, "shipped")],
                                "seq long, order_id long, status string")
    ch = C.change_order_status(orders_, chg, "2024-02-01")
    assert {r["seq"]: r["error"] for r in rows(ch.outcome)} == {1: None, 2: "Invalid status", 3: None,
                                                                 4: "Order not found"}
    o = {r["id"]: r for r in rows(ch.tables["orders"])}
    assert o[10]["status"] == "delivered" and o[10]["updated_at"] == T(2024, 2, 1) and o[11]["updated_at"] is None


# ---------------------------------------------------------------- baskets and duplicates

def test_cart_merge_and_edit(spark, order_tables):
    cart = order_tables[3].withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    adds = spark.createDataFrame([(1, 1, 1, 2), (2, 1, 5, 1), (3, 1, 5, 4)],
                                 "seq long, user_id long, product_id long, quantity int")
    ch = C.merge_cart(cart, adds, "2024-02-01")
    got = {(r["user_id"], r["product_id"]): r for r in rows(ch.tables["cart"])}
    assert got[(1, 1)]["quantity"] == 3 and got[(1, 5)]["quantity"] == 5 and got[(1, 5)]["id"] == 6
    assert [r["action"] for r in rows(ch.outcome, ["seq"])] == ["updated", "inserted", "updated"]
    edits = spark.createDataFrame([
        (1, "set_quantity", 1, 1, 9, None), (2, "set_selected", 1, 1, None, True), (3, "remove", 1, 2, None, None),
        (4, "set_quantity", 2, 1, 3, None), (5, "clear", None, 3, None, None), (6, "set_quantity", 3, 3, 4, None),
        (7, "set_quantity", 1, 1, 8, None)],
        "seq long, op string, id long, user_id long, quantity int, selected boolean")
    ec = C.edit_cart(cart, edits)
    assert {r["seq"]: r["error"] for r in rows(ec.outcome)} == {
        1: None, 2: None, 3: "Cart item not found", 4: "Cart item not found", 5: None,
        6: "Cart item not found", 7: None}
    assert [(r["id"], r["quantity"], r["selected"]) for r in rows(ec.tables["cart"], ["id"])] == [
        (1, 8, True), (2, 1, False)]


def test_wishlist_sequence(spark):
    wl = spark.createDataFrame([(1, 7, 1, T(2024, 1, 1))], "id long, user_id long, product_id long, "
                                                           "created_at timestamp_ntz")
    ops = spark.createDataFrame([(10, "add", 7, 1), (11, "remove", 7, 1), (12, "remove", 7, 1),
                                 (13, "add", 7, 1), (14, "add", 8, 2), (15, "add", 8, 2)],
                                "seq long, op string, user_id long, product_id long")
    ch = C.merge_wishlist(wl, ops, "2024-02-01")
    assert [r["error"] for r in rows(ch.outcome, ["seq"])] == [
        "Item already in wishlist", None, "Item not found in wishlist", None, None, "Item already in wishlist"]
    assert sorted((r["id"], r["user_id"], r["product_id"]) for r in rows(ch.tables["wishlist"])) == [
        (15, 7, 1), (16, 8, 2)]


def test_reviews_duplicates_and_ranges(spark, shop):
    new = spark.createDataFrame([(1, 7, 1, 5, "dup"), (2, 20, 2, 9, "bad"), (3, 20, 2, 3, "ok"),
                                 (4, 20, 2, 4, "again"), (5, 20, 77, 4, "ghost")],
                                "seq long, user_id long, product_id long, rating int, comment string")
    ch = C.add_reviews(shop["reviews"], shop["products"], new, "2024-02-01")
    assert [r["error"] for r in rows(ch.outcome, ["seq"])] == [
        "You have already reviewed this product", "Rating must be between 1 and 5", None,
        "You have already reviewed this product", "Product not found"]


def test_brand_review_replay(spark):
    br = spark.createDataFrame([(1, 7, 4, "x", T(2024, 1, 1))],
                               "id long, user_id long, rating int, comment string, created_at timestamp_ntz")
    ops = spark.createDataFrame([
        (1, "add", 7, 11, 5, "again"), (2, "update", 7, 12, 2, "meh"), (3, "delete", 7, 99, 0, None),
        (4, "delete", 7, 1, 0, None), (5, "update", 7, 13, 3, None), (6, "add", 7, 14, 5, "back"),
        (7, "update", 8, 15, 1, None)],
        "seq long, op string, user_id long, id long, rating int, comment string")
    ch = C.brand_review_changes(br, ops, "2024-02-01")
    assert [r["error"] for r in rows(ch.outcome, ["seq"])] == [
        "You have already submitted a brand review", None,
        "Review not found or you do not have permission to delete it", None, "Review not found", None,
        "Review not found"]
    assert [(r["id"], r["user_id"], r["rating"], r["comment"]) for r in rows(ch.tables["brand_reviews"])] == [
        (8, 7, 5, "back")]   # a fresh id, not the one that the row names


def test_default_address_rules(spark):
    addr = spark.createDataFrame([(1, 7, "a", True, T(2024, 1, 1)), (2, 7, "b", False, T(2024, 1, 2))],
                                 "id long, user_id long, address_line1 string, is_default boolean, "
                                 "created_at timestamp_ntz")
    chg = spark.createDataFrame([(10, "add", 8, None, "first", False), (11, "add", 8, None, "second", False),
                                 (12, "set_default", 7, 2, None, None), (13, "add", 7, None, "c", True),
                                 (14, "set_default", 7, 99, None, None)],
                                "seq long, op string, user_id long, id long, address_line1 string, "
                                "is_default boolean")
    ch = C.enforce_default_address(addr, chg, "2024-02-01")
    got = {r["id"]: r["is_default"] for r in rows(ch.tables["addresses"])}
    assert got == {1: False, 2: False, 13: True, 14: False, 16: True}   # new ids = max(2) + 1 + seq
    per_user = {}
    for r in rows(ch.tables["addresses"]):
        per_user[r["user_id"]] = per_user.get(r["user_id"], 0) + bool(r["is_default"])
    assert all(v <= 1 for v in per_user.values())
    assert {r["seq"]: r["error"] for r in rows(ch.outcome)}[14] == "Address not found"


# ---------------------------------------------------------------- categories, cascade, patches

def test_category_upsert_and_delete(spark, shop):
    cats = shop["categories"].withColumn("description", F.lit(None).cast("string"))
    up = spark.createDataFrame([(1, None, "creams", "d", None), (2, None, "Toners", "d", 9),
                                (3, 4, "SKINCARE", None, None), (4, 77, "Nope", None, None),
                                (5, 4, None, "new text", 3), (6, None, "toners", "d", 9)],
                               "seq long, id long, name string, description string, parent_id long")
    ch = C.upsert_categories(cats, up, "2024-02-01")
    assert [r["error"] for r in rows(ch.outcome, ["seq"])] == [
        "Category name already exists", None, "Category name already exists", "Category not found", None,
        "Category name already exists"]
    got = {r["id"]: r for r in rows(ch.tables["categories"])}
    assert got[4]["name"] == "Serums" and got[4]["description"] == "new text" and got[4]["parent_id"] == 3
    assert got[12]["name"] == "Toners"
    dels = spark.createDataFrame([(1, 9), (2, 3), (3, 42), (4, 4)], "seq long, id long")
    products = shop["products"].filter(F.col("id") != 2)
    dc = C.delete_categories(shop["categories"], products, dels)
    assert [r["error"] for r in rows(dc.outcome, ["seq"])] == [
        "Cannot delete category with existing subcategories", "Cannot delete category with existing products",
        "Category not found", None]


def test_cascade_delete_user_and_restricted_coupon(spark):
    users = spark.createDataFrame([(1,), (2,)], "id long")
    orders_ = spark.createDataFrame([(10, 1), (11, 2)], "id long, user_id long")
    items = spark.createDataFrame([(10, 5, 1), (11, 5, None)], "order_id long, product_id long, coupon_id long")
    cart = spark.createDataFrame([(1, 1, 5), (2, 2, 5)], "id long, user_id long, product_id long")
    coupons_ = spark.createDataFrame([(1,), (2,)], "id long")
    tables = {"users": users, "orders": orders_, "order_items": items, "cart": cart, "coupons": coupons_}
    ch = C.cascade_delete(tables, "users", spark.createDataFrame([(1,)], "id long"))
    assert [r["id"] for r in rows(ch.tables["orders"])] == [11]
    assert [r["order_id"] for r in rows(ch.tables["order_items"])] == [11]
    assert [r["user_id"] for r in rows(ch.tables["cart"])] == [2]
    cc = C.cascade_delete(tables, "coupons", spark.createDataFrame([(1,), (2,)], "id long"))
    assert {r["id"]: r["error"] for r in rows(cc.outcome)} == {1: "restricted by order_items.coupon_id", 2: None}
    assert [r["id"] for r in rows(cc.tables["coupons"])] == [1]


def test_patch_keep_and_overwrite(spark):
    t = spark.createDataFrame([(1, "a", 5, "x"), (2, "b", 6, "y")], "id long, name string, offer int, note string")
    p = spark.createDataFrame([(1, 1, None, None, "n1"), (2, 1, "A", None, None), (3, 3, "Z", 1, None)],
                              "seq long, id long, name string, offer int, note string")
    ch = C.patch_rows(t, p, keep_cols=["name", "note"], overwrite_cols=["offer"], as_of="2024-02-01")
    got = {r["id"]: r for r in rows(ch.tables["table"])}
    assert (got[1]["name"], got[1]["note"], got[1]["offer"]) == ("A", "n1", None)   # offer reset (B9)
    assert got[2]["updated_at"] is None and got[1]["updated_at"] == T(2024, 2, 1)
    assert {r["seq"]: r["error"] for r in rows(ch.outcome)} == {1: None, 2: None, 3: "Not found"}


def test_add_products_parse_like_the_form(spark, shop):
    r = spark.createDataFrame([
        (1, "A", None, "12.5abc", "3", "", ""), (2, "", None, "1", "3", None, None),
        (3, "B", None, "x", "3", None, None), (4, "C", None, "1", "x3", None, None),
        (5, "D", None, "1", "55", None, None), (6, "E", None, "1", "3", "1", "101"),
        (7, "F", None, "1", "4", "q", None)],
        "seq long, name string, description string, price string, category_id string, "
        "stock_quantity string, offer_percentage string")
    ch = C.add_products(shop["products"], shop["categories"], r, "2024-02-01")
    assert [x["error"] for x in rows(ch.outcome, ["seq"])] == [
        None, "Name, price, and category are required", "Invalid price format", "Invalid category ID format",
        "Invalid category ID", "Invalid offer percentage. Must be between 0 and 100",
        "Invalid stock quantity format"]
    new = [x for x in rows(ch.tables["products"]) if x["id"] > 3]
    assert [(x["price"], x["category"], x["stock_quantity"], x["offer_percentage"], x["description"])
            for x in new] == [(D("12.50"), "Creams", 0, 0, "")]


# ---------------------------------------------------------------- quality and access

def test_fk_audit_counts_keys_without_sorting_child_rows(spark):
    """Keys are counted before the shuffle; no side of a join is sorted, whatever its size."""
    link = lambda child, column, parent: quality.Link(child, column, parent, "cascade")
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    tables = {
        "users": frame([(1,), (2,), (2,), (None,)], "id long"),
        "gone": frame([], "id int"),
        # key 1 holds most rows; null, unknown and repeated keys
        "orders": frame([(1, 7)] * 3000 + [(2, None), (None, 8), (None, 8), (9, 9), (9, None), (0, 7)],
                        "user_id int, gone_id long"),
        "cart": frame([(5,), (2,)], "user_id long"),
        "none": frame([], "user_id long"),
    }
    links = (link("orders", "user_id", "users"), link("cart", "user_id", "users"), link("none", "user_id", "users"),
             link("orders", "gone_id", "gone"), link("orders", "absent", "users"), link("absent", "id", "users"))
    thresholds = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in thresholds}
    try:
        for k in thresholds:
            spark.conf.set(k, "-1")
        got = quality.fk_audit(tables, links)
        found = sorted(map(tuple, got.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == [("cart", "user_id", "users", "cascade", 2, 0, 1),
                     ("orders", "gone_id", "gone", "cascade", 3006, 2, 3004),
                     ("orders", "user_id", "users", "cascade", 3006, 2, 3)]
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][4:] == [
        ("child_rows", "bigint"), ("null_links", "bigint"), ("orphan_rows", "bigint")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Sort" not in plan and "Join" not in plan


def test_payment_signature_matches_python_hmac(spark):
    secret = "made-up-test-secret"
    good = hmac.new(secret.encode(), b"order_1|pay_1", hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("order_1", "pay_1", good, D("1.005")), ("order_1", "pay_2", good, D("0"))],
                               "gateway_order_id string, payment_id string, signature string, amount decimal(10,3)")
    got = rows(quality.payment_audit(df, secret), ["payment_id"])
    assert [(r["signature_ok"], r["amount_minor"], r["amount_ok"]) for r in got] == [(True, 100, True),
                                                                                      (False, 0, False)]


def test_check_rules(spark):
    df = spark.createDataFrame([(1, "a@b.co", "98765-43210", "cod"), (2, "bad@", "12345", "card"),
                                (3, None, None, None)], "id long, email string, phone string, method string")
    got = rows(quality.check_rules(df, [("email", "email"), ("phone", "phone"), ("payment_method", "method")],
                                   keep=["id"]), ["id"])
    assert [r["broken_rules"] for r in got] == ["", "email:email,phone:phone,payment_method:method",
                                                "email:email,payment_method:method"]


def test_visibility_policies(spark, order_tables):
    orders_, items = order_tables[0], order_tables[1]
    mine = access.visible_rows(items, "order_items", "select", 1, "user", {"orders": orders_})
    assert sorted(r["order_id"] for r in rows(mine)) == [10, 12]
    assert rows(access.visible_rows(items, "order_items", "update", 1, "admin", {"orders": orders_})) == []
    assert len(rows(access.visible_rows(orders_, "orders", "select", None, None))) == 0
    owners = access.row_owners(items, "order_items", "select", {"orders": orders_})
    assert sorted((r["order_id"], r["owner_id"]) for r in rows(owners)) == [(10, 1), (11, 2), (12, 1)]


def test_recent_orders_top_n_ties(spark, order_tables):
    orders_, items = order_tables[0], order_tables[1]
    prods = spark.createDataFrame([(1, "one"), (2, "two")], "id long, name string")
    got = rows(orders.recent_orders(orders_, items, prods, n=1), ["user_id"])
    assert [(r["user_id"], r["id"], r["position"]) for r in got] == [(1, 10, 1), (2, 11, 1)]
    nested = rows(people.customer_dashboard(
        spark.createDataFrame([(1, "u", "e", None, T(2024, 1, 1))],
                              "id long, name string, email string, phone string, created_at timestamp_ntz"),
        orders_, items, prods, spark.createDataFrame([], "id long, user_id long"),
        spark.createDataFrame([], "id long, user_id long"), n=5, nested=True))
    assert nested[0]["total_orders"] == 2 and len(nested[0]["recent_orders"]) == 2
    assert nested[0]["cart_count"] == 0
