"""Documents as lines, declared table types, the database copy."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from shopfront.operators import migrate
from shopfront.sources import documents, schemas
from shopfront.sources.fixtures import Shop


def _documents(path):
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    decoder, at, out = json.JSONDecoder(), 0, []
    while text[at:].strip():
        at += len(text[at:]) - len(text[at:].lstrip())
        doc, at = decoder.raw_decode(text, at)
        out.append(doc)
    return out


def test_documents_of_a_hot_parent_span_files(spark, tmp_path):
    parents = spark.createDataFrame([(i, None if i == 2 else f'p"{i}') for i in range(6)], "id long, note string")
    # parent 3 owns most rows; repeated children, null order values, orphans, null parents
    kids = [(3 if i % 4 else i % 6, i % 50 if i % 7 else None, f"v{i % 3}") for i in range(4000)]
    kids += [(99, 1, "orphan"), (None, 1, "none")]
    children = spark.createDataFrame([k for k in kids if k[0] != 5], "pid long, ord int, v string")
    lines = documents.nested_lines(parents, children, "id", "pid", ["ord"], "kids", partitions=16)
    hot = lines.filter("id = 3").select(F.spark_partition_id().alias("p")).distinct().count()
    assert hot > 4
    documents.write_documents(lines, str(tmp_path / "d"))
    got = _documents(tmp_path / "d")
    want = []
    for p in range(6):
        own = sorted((o is not None, o or 0, v) for q, o, v in kids if q == p and p != 5)
        want.append({"id": p, "note": None if p == 2 else f'p"{p}',
                     "kids": [{"ord": o if there else None, "v": v} for there, o, v in own]})
    assert got == want
    none = documents.nested_lines(parents.filter("id < 0"), children, "id", "pid", ["ord"], "kids")
    assert none.count() == 0


def test_typed_read(spark, tmp_path):
    path = str(tmp_path / "users")
    spark.createDataFrame([(1, "a@b.c", "Ann", "x" * 20, "extra"), (2, None, "Bob", "é" * 20, "extra"),
                           (3, "c@d.e", "n" * 256, "x" * 21, "extra")],
                          "id int, email string, name string, phone string, other string").write.parquet(path)
    df = schemas.read_typed(spark, path, "users")
    assert [(f.name, f.dataType.simpleString()) for f in df.schema][:2] == [("id", "bigint"), ("email", "string")]
    assert "other" not in df.columns and len(df.columns) == 9
    kept, broken = schemas.enforce(df, "users", ["id", "email", "name", "phone"])
    assert [r["id"] for r in rows(kept)] == [1]
    assert {r["id"]: r["broken_rules"] for r in rows(broken)} == {
        2: "not_null:email", 3: "max_length:255:name,max_length:20:phone"}
    _, all_broken = schemas.enforce(df, "users")  # the file lacks a declared column that must be there
    assert {r["id"] for r in rows(all_broken) if "not_null:password" in r["broken_rules"]} == {1, 2, 3}


def test_typed_read_of_text_keeps_malformed_rows(spark, tmp_path):
    path = tmp_path / "reviews.json"
    path.write_text('{"id": 1, "rating": 5}\n{"id": "x", "rating": 4}\n{"id": 3, "rating": 9}\nnot json\n{"id": 4}\n')
    kept, broken = schemas.enforce(schemas.read_typed(spark, str(path), "reviews", "json"), "reviews")
    assert sorted(r["id"] for r in rows(kept)) == [1, 4]
    got = {r["_malformed"] or r["id"]: r["broken_rules"] for r in rows(broken)}
    assert got == {'{"id": "x", "rating": 4}': "malformed,not_null:id", "not json": "malformed,not_null:id",
                   3: "stars:rating"}


def test_database_copy_twice_is_the_same(spark):
    s = Shop.of(spark, SF_SMALL)
    source = {t: s.table(t) for t in ("users", "products", "orders", "cart", "coupons", "coupon_products", "reviews")}
    empty = {t: df.limit(0) for t, df in source.items()}
    once, refused = migrate.copy_database(source, empty)
    assert all(df.count() == 0 for df in refused.values())
    assert {t: once[t].count() for t in source} == {t: df.count() for t, df in source.items()}
    twice, _ = migrate.copy_database(source, once)
    assert {t: twice[t].count() for t in source} == {t: df.count() for t, df in source.items()}


def test_database_copy_refuses_links_to_rows_that_stay_out(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id long, email string")
    there = spark.createDataFrame([(9, "b")], "id long, email string")  # holds the second user's address
    carts = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 7)], "id long, user_id long")
    done, refused = migrate.copy_database({"users": users, "cart": carts}, {"users": there, "cart": carts.limit(0)})
    assert sorted(r["id"] for r in rows(done["users"])) == [1, 9]
    assert sorted(r["id"] for r in rows(done["cart"])) == [1, 3]
    assert sorted(r["id"] for r in rows(refused["cart"])) == [2, 4]
