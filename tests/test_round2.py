"""Cases that the change batches do not hold: fresh ids, zero totals, repeated cart rows, null status, unknown ids."""

import datetime as dt
import json
from decimal import Decimal as D

import pytest

import __spark_entry__ as E
from conftest import rows
from shopfront.operators import changes as C
from shopfront.operators import migrate, promotions, quality

AS_OF = dt.datetime(2024, 1, 1)
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["c01_merge_cart", "c03_merge_wishlist", "c04_ingest_orders_orders",
                                  "c10_add_products_products", "c11_add_reviews_reviews", "c12_upsert_categories",
                                  "c14_replace_coupon_products", "c16_default_address", "d06_seed_categories"])
def test_snapshot_ids_are_unique(spark, name):
    ids = E.queries()[name](spark, SF).select("id")
    assert ids.count() == ids.distinct().count()


def test_negative_seq_is_refused(spark):
    existing = spark.createDataFrame([(3,)], "id long")
    adds = spark.createDataFrame([(-1,)], "seq long")
    with pytest.raises(Exception, match="seq must not be negative"):
        adds.select(C._next_id(existing, adds.seq)).collect()


def test_null_status_is_invalid(spark):
    orders = spark.createDataFrame([(1, "pending")], "id long, status string")
    changes = spark.createDataFrame([(0, 1, None)], "seq long, order_id long, status string")
    got = C.change_order_status(orders, changes, AS_OF)
    assert rows(got.outcome)[0]["error"] == "Invalid status"
    assert rows(got.tables["orders"])[0]["status"] == "pending"


def test_two_cart_rows_of_one_product_stay_two(spark):
    cart = spark.createDataFrame([(1, 7, 5, 1), (2, 7, 5, 2)], "id long, user_id long, product_id long, quantity int")
    coupons = spark.createDataFrame([(9, 0)], "id long, times_used int")
    alloc = spark.createDataFrame([(7, "A", 1, 5, 9, True, 1.0), (7, "A", 2, 5, 9, True, 2.0)],
                                  "cart_id long, code string, line_no int, product_id long, coupon_id long, "
                                  "valid boolean, line_discount double")
    got = C.apply_coupons(cart, coupons, alloc)
    assert [(r["id"], float(r["discount_amount"])) for r in rows(got.tables["cart"], ["id"])] == [(1, 2.0), (2, 2.0)]


def test_unknown_root_id_is_reported(spark):
    users = spark.createDataFrame([(1,)], "id long")
    got = C.cascade_delete({"users": users}, "users", spark.createDataFrame([(1,), (99,)], "id long"))
    assert {r["id"]: r["error"] for r in rows(got.outcome)} == {1: None, 99: "not found"}


def test_copy_keeps_unique_columns_unique(spark):
    source = spark.createDataFrame([(1, "a@x"), (2, "b@x"), (3, None)], "id long, email string")
    target = spark.createDataFrame([(7, "a@x"), (8, None)], "id long, email string")
    got = rows(migrate.copy_matching(source, target, unique=("email",)), ["id"])
    assert [r["id"] for r in got] == [2, 3, 7, 8]


@pytest.mark.parametrize("as_written", [False, True])
def test_zero_total_cart_gets_no_discount(spark, as_written):
    carts = spark.createDataFrame([(1, "C", 1, 5, 2)], "cart_id long, code string, line_no int, product_id long, "
                                                       "quantity int")
    products = spark.createDataFrame([(5, D("0.00"))], "id long, price decimal(10,2)")
    from shopfront.sources.fixtures import Shop
    coupons = Shop.of(spark, SF).coupons.limit(1)
    one = coupons.collect()[0].asDict()
    one.update(code="C", discount_type="fixed", is_active=True)
    coupons = spark.createDataFrame([one], coupons.schema)
    links = spark.createDataFrame([], "id long, coupon_id long, product_id long")
    got = rows(promotions.coupon_allocation(carts, coupons, links, products, AS_OF, as_written=as_written))
    assert len(got) == 1 and got[0]["line_discount"] in (None, 0.0)


def test_orders_keep_shipping_fields_and_items_get_ids(spark):
    orders = spark.createDataFrame([(1, 7, "x")], "id long, user_id long, shipping_city string")
    items = spark.createDataFrame([(4, 1, 5, 2)], "id long, order_id long, product_id long, quantity int")
    products = spark.createDataFrame([(5, D("2.00"), 10)], "id long, price decimal(10,2), stock_quantity int")
    cart = spark.createDataFrame([(1, 7)], "id long, user_id long")
    req = spark.createDataFrame([(0, 7, "cod", 4, "Pune")], "seq long, user_id long, payment_method string, "
                                                            "total_amount int, shipping_city string")
    lines = spark.createDataFrame([(0, 5, 1, 0), (0, 5, 2, 1)], "seq long, product_id long, quantity int, line_seq long")
    got = C.ingest_orders(orders, items, products, cart, req, lines, AS_OF)
    assert [(r["id"], r["shipping_city"]) for r in rows(got.tables["orders"], ["id"])] == [(1, "x"), (2, "Pune")]
    assert [r["id"] for r in rows(got.tables["order_items"], ["id"])] == [4, 5, 6]
    with pytest.raises(ValueError, match="line_seq"):
        C.ingest_orders(orders, items, products, cart, req, lines.drop("line_seq"), AS_OF)


def test_brand_rating_is_checked_and_missing_ids_are_fresh(spark):
    old = spark.createDataFrame([(3, 1, 4, "a", AS_OF)], "id long, user_id long, rating int, comment string, "
                                                         "created_at timestamp_ntz")
    ops = spark.createDataFrame([(0, "update", 1, None, 9, "b"), (1, "add", 2, None, 9, "c"),
                                 (2, "add", 2, None, 5, "d"), (3, "add", 2, None, 9, "e")],
                                "seq long, op string, user_id long, id long, rating int, comment string")
    got = C.brand_review_changes(old, ops, AS_OF)
    bad = "Rating must be between 1 and 5"
    assert [r["error"] for r in rows(got.outcome, ["seq"])] == [
        bad, bad, None, "You have already submitted a brand review"]
    kept = rows(got.tables["brand_reviews"], ["id"])
    assert [(r["id"], r["rating"], r["comment"]) for r in kept] == [(3, 4, "a"), (6, 5, "d")]


CATS = "id long, name string, description string, parent_id long, image_url string"


def test_category_batch_names_and_images(spark):
    cats = spark.createDataFrame([(1, "Oil", None, None, "o.png"), (2, "Soap", None, None, None),
                                  (3, "SOAP", None, None, None)], CATS)
    batch = spark.createDataFrame([(0, 1, "Balm", None, None, None), (1, 1, "balm", None, None, "b.png"),
                                   (2, None, "BALM", None, None, None), (3, 2, "soap", None, None, None),
                                   (4, None, "Wax", None, None, "w.png")], "seq long, " + CATS)
    got = C.upsert_categories(cats, batch, AS_OF)
    taken = "Category name already exists"
    assert [r["error"] for r in rows(got.outcome, ["seq"])] == [None, None, taken, taken, None]
    new = {r["id"]: (r["name"], r["image_url"]) for r in rows(got.tables["categories"])}
    assert new == {1: ("balm", "b.png"), 2: ("Soap", None), 3: ("SOAP", None), 8: ("Wax", "w.png")}


def test_second_delete_of_a_category_is_not_found(spark):
    cats = spark.createDataFrame([(1, None), (2, None)], "id long, parent_id long")
    products = spark.createDataFrame([], "id long, category_id long")
    got = C.delete_categories(cats, products, spark.createDataFrame([(0, 1), (1, 1)], "seq long, id long"))
    assert [r["error"] for r in rows(got.outcome, ["seq"])] == [None, "Category not found"]
    assert [r["id"] for r in rows(got.tables["categories"])] == [2]


def test_patches_need_the_owner(spark):
    table = spark.createDataFrame([(1, 7, "a", "x"), (2, 8, "b", "y"), (3, None, "c", "z")],
                                  "id long, user_id long, city string, line2 string")
    patches = spark.createDataFrame(
        [(1, 1, 7, "A", None), (2, 1, 8, "stranger", "s"), (3, 2, 8, None, "Y"), (4, 3, None, "nobody", "n"),
         (5, 9, 7, "unknown", "u"), (6, 2, 8, "B", "YY")], "seq long, id long, user_id long, city string, line2 string")
    got = C.patch_rows(table, patches, ["city"], ["line2"], "2026-01-01 00:00:00", stamp=None, owner="user_id")
    assert sorted(map(tuple, got.tables["table"].collect())) == [
        (1, 7, "A", None), (2, 8, "B", "YY"), (3, None, "c", "z")]
    assert {r.seq: r.error for r in got.outcome.collect()} == {
        1: None, 2: "Not found", 3: None, 4: "Not found", 5: "Not found", 6: None}
    assert got.tables["table"].columns == table.columns and got.outcome.columns == ["seq", "id", "error"]


def test_profile_sample_is_the_smallest_row(spark):
    rows = spark.createDataFrame([(2, "b", None), (1, "z", ["q"]), (1, "a", ["r", None])], "`k.1` long, v string, tags array<string>")
    empty = rows.filter("v = ''")
    summary, columns = quality.profile_tables(spark, {"rows": rows, "empty": empty})
    got = {r.table_name: r for r in summary.collect()}
    assert json.loads(got["rows"].sample_row) == {"k.1": 1, "v": "a", "tags": ["r", None]}
    assert got["empty"].sample_row is None and got["empty"].row_count == 0 and got["rows"].n_columns == 3
    assert columns.filter("table_name = 'rows'").count() == 3
