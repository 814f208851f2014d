"""Plans and splits: pages before joins, hot keys over many tasks, patterns without nested loops."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from shopfront.functions.joins import with_children
from shopfront.operators import catalog, changes as C, migrate, people
from shopfront.sources.fixtures import Shop


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows_per_task(df):
    """Rows of each task of the last stage (whole rows, so that no column is pruned)."""
    def count(batches):
        yield pd.DataFrame({"n": [sum(len(b) for b in batches)]})
    return [r.n for r in df.mapInPandas(count, "n long").collect()]


@pytest.fixture
def small_skew(spark):
    """No broadcast by size and small skew bounds, so that adaptive execution splits what it may."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_children_of_a_hot_parent_are_spread(small_skew):
    """A parent that owns a third of all children is joined in many tasks; the result is the left outer join."""
    spark = small_skew
    n = 60_000
    parents = spark.range(300).select("id", F.concat(F.lit("p"), "id").alias("name"))
    kids = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") % 280).alias("_k"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"), F.col("id").alias("child")).repartition(8)
    got = with_children(parents, kids, "id", "_k")
    want = parents.join(kids, F.col("id") == F.col("_k"), "left").drop("_k")
    assert max(_rows_per_task(got)) < n / 3 <= max(_rows_per_task(want))
    hot = got.filter("id = 7")  # its rows, a third of all
    assert max(_rows_per_task(hot)) < n / 6 < max(_rows_per_task(want.filter("id = 7")))
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_children_join_with_empty_sides(spark):
    p = spark.createDataFrame([(1, "a"), (None, "b")], "id long, name string")
    k = spark.createDataFrame([(1, 5), (None, 6), (9, 7)], "_k long, v int")
    assert sorted(map(tuple, with_children(p, k, "id", "_k").collect()), key=repr) == [(1, "a", 5), (None, "b", None)]
    assert len(with_children(p, k.filter("v < 0"), "id", "_k").collect()) == 2
    assert with_children(p.filter("id > 5"), k, "id", "_k").count() == 0


@pytest.mark.parametrize("options", [{}, {"category": "FRANCE", "min_price": 10}, {"page": 3, "limit": 7}])
def test_search_joins_its_page_alone(small_skew, options):
    """Both joins sit above the page, which is cut from the filtered products first."""
    s = Shop(small_skew, SF_SMALL)
    got = catalog.catalog_search(s.products, s.categories, s.reviews, **options)
    plan = _plan(got)
    joins = [plan.index(x) for x in re.findall(r"SortMergeJoin \[category_id#\d+L?\], \[_cid#\d+L?\], LeftOuter", plan)[:1]]
    cuts = [m.start() for m in re.finditer("TakeOrderedAndProject|GlobalLimit", plan)]
    assert joins and cuts and joins[0] < max(cuts)
    limit = options.get("limit", 10)
    every = catalog.catalog_search(s.products, s.categories, s.reviews, **{**options, "limit": None, "page": 1}).collect()
    start = (options.get("page", 1) - 1) * limit
    assert got.collect() == every[start:start + limit]


def test_patterns_meet_texts_by_grams(spark):
    rng = random.Random(2)
    alphabet = "abAB xy"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in range(300)] + [None, "", "50% off", "a_b", "a\\b"]
    patterns = ["%ab%", "a_b", "%", "", "_", "x%y", "AB", "%a%b%x%", "__", "y", "%b a%", "50\\% off", None, "zzz%", "%zz"]

    def like(text, pattern):
        out, i = "", 0
        while i < len(pattern):
            c = pattern[i]
            if c == "\\" and i + 1 < len(pattern):
                out, i = out + re.escape(pattern[i + 1]), i + 2
                continue
            out, i = out + {"%": ".*", "_": "."}.get(c, re.escape(c)), i + 1
        return re.fullmatch(out, text, re.S | re.I) is not None

    t = spark.createDataFrame([(x,) for x in texts], "t string")
    for some in (patterns, ["%ab%", "x%y"], ["%"], [None], ["zzz%"]):
        p = spark.createDataFrame([(x,) for x in some], "p string")
        got = {r.t for r in migrate.texts_like_any(t, "t", p, "p").collect()}
        assert got == {x.lower() for x in texts if x is not None and any(q is not None and like(x, q) for q in some)}
    assert "NestedLoop" not in _plan(migrate.texts_like_any(t, "t", p, "p"))


def test_backfill_as_written_has_no_nested_loop(small_skew):
    s = Shop(small_skew, SF_SMALL)
    df = migrate.backfill_category(s.products, s.categories, as_written=True)
    df.collect()
    assert "NestedLoop" not in _plan(df) and "CartesianProduct" not in _plan(df)


def test_one_row_out_of_range_is_refused_alone(spark):
    s = Shop(spark, SF_SMALL)
    cid = s.categories.select(F.min("id")).first()[0]
    r = spark.createDataFrame(
        [(0, "a", "", "1e12", str(cid), "1", "0"), (1, "b", "", "9.5", str(cid), "3000000000", "0"),
         (2, "c", "", "99999999.99", str(cid), "2147483647", "0"), (3, "d", "", "5", str(cid), "9" * 30, "0")],
        "seq long, name string, description string, price string, category_id string, stock_quantity string, offer_percentage string")
    out = C.add_products(s.products, s.categories, r, "2024-02-01")
    assert [x["error"] for x in rows(out.outcome, ["seq"])] == [
        "Price out of range", "Stock quantity out of range", None, "Invalid stock quantity format"]
    assert out.tables["products"].count() == s.products.count() + 1


def test_seeded_parents_have_pictures(spark):
    table = spark.createDataFrame([], "id long, name string, description string, parent_id long, image_url string, "
                                      "created_at timestamp_ntz")
    got = rows(migrate.seed_categories(table, migrate.seed_tree(spark), "2024-02-01"))
    pictures = {r["name"]: r["image_url"] for r in got}
    for name, _, image in migrate.SEED_ROOTS:
        assert pictures[name] == image
    assert pictures["Serums"] is None


def test_brand_summary_without_a_table_is_empty(spark):
    s = Shop(spark, SF_SMALL)
    none, some = people.brand_review_summary(None, s.users), people.brand_review_summary(s.brand_reviews, s.users)
    assert none.collect() == [] and none.dtypes == some.dtypes
