"""Migration jobs: D2 copy_matching, D5 backfill_category, D6 seed_categories, D7 evolve."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.model import COPY_ORDER, LINKS, Link

# The category tree the shop seeds (root: description, image;
# then the children of each root, in order).
SEED_ROOTS = (
    ("Skincare", "Products for skin care and maintenance", "https://example.com/skincare.jpg"),
    ("Makeup", "Cosmetic products for beauty enhancement", "https://example.com/makeup.jpg"),
    ("Haircare", "Products for hair care and styling", "https://example.com/haircare.jpg"),
    ("Fragrances", "Perfumes and body sprays", "https://example.com/fragrances.jpg"),
    ("Bath & Body", "Body care and bathing products", "https://example.com/bath-body.jpg"),
)
SEED_CHILDREN = {
    "Skincare": ("Face Creams", "Serums", "Cleansers", "Masks", "Sunscreen"),
    "Makeup": ("Lipstick", "Foundation", "Eye Makeup", "Blush", "Brushes"),
    "Haircare": ("Shampoo", "Conditioner", "Hair Oils", "Hair Masks", "Styling Products"),
    "Fragrances": ("Women's Perfume", "Men's Cologne", "Body Mists", "Gift Sets"),
    "Bath & Body": ("Body Wash", "Lotions", "Scrubs", "Hand Care", "Body Oils"),
}


def copy_matching(source: DataFrame, target: DataFrame, key: str | tuple = "id", unique: tuple = ()) -> DataFrame:
    """Append ``source`` rows to ``target`` over the columns both share.

    Rows whose key, or whose value of a ``unique`` column (or tuple of columns),
    already exists in the target are skipped (ON CONFLICT DO NOTHING; nulls never conflict);
    target-only columns are null for copied rows; the result has
    the target's columns.  Running it twice gives the same table.
    """
    shared = [c for c in source.columns if c in target.columns]
    if not shared:
        return target
    fresh = source.select(*shared)
    for columns in ([u] if isinstance(u, str) else list(u) for u in (key, *unique)):
        if set(columns) <= set(shared):
            fresh = fresh.join(target.select(*columns), columns, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True).select(*target.columns)


# The unique columns of the shop tables.
UNIQUE = {"users": ("email",), "categories": ("name",), "coupons": ("code",), "wishlist": (("user_id", "product_id"),),
          "coupon_products": (("coupon_id", "product_id"),), "reviews": (("user_id", "product_id"),),
          "brand_reviews": ("user_id",)}


def copy_database(source: dict[str, DataFrame], target: dict[str, DataFrame],
                  links: tuple[Link, ...] = LINKS) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Every table of ``source`` that ``target`` has too, copied by ``copy_matching``, parents before children.

    Returns (the new target tables, the refused rows).  A row whose foreign key
    names no row of the new parent table is refused and reported, where a
    database stops the whole copy; links within a table and links to tables that
    are in neither database are not checked.  All results are lazy.
    """
    done, refused = dict(target), {}
    for name in (t for t in COPY_ORDER if t in source and t in target):
        rows, held = source[name], source[name].columns
        bad = F.lit(False)
        for i, link in enumerate(x for x in links if x.child == name and x.parent != name):
            if link.column in held and link.parent in done:
                ids = done[link.parent].select(F.col("id").alias(f"_p{i}")).distinct()
                rows = rows.join(ids, F.col(link.column) == F.col(f"_p{i}"), "left")
                bad = bad | (F.col(link.column).isNotNull() & F.col(f"_p{i}").isNull())
        key = "id" if "id" in held else tuple(held)
        refused[name] = rows.filter(bad).select(*held)
        done[name] = copy_matching(rows.filter(~bad).select(*held), target[name], key, UNIQUE.get(name, ()))
    return done, refused


GRAM = 3


def texts_like_any(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """The distinct lower-cased ``text``s that match any ``pattern`` case-blind (ILIKE), without comparing all pairs.

    A text that matches has every run of literal characters of the pattern in
    it.  Each distinct pattern gives the first ``GRAM`` characters of its longest
    run (fewer if it has no longer one, none if it is all wildcards), each
    distinct text all its grams of those lengths; the two meet on equal grams
    and only those pairs are verified.  A pattern with an escape meets all texts.
    """
    t = texts.select(F.lower(F.col(text)).alias(text)).filter(F.col(text).isNotNull()).distinct()
    p = patterns.select(F.lower(F.col(pattern)).alias("_like")).filter("_like is not null").distinct()
    runs = F.transform(F.split("_like", "[%_]"), lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))
    longest = F.array_max(runs)["r"]
    p = p.withColumn("_gram", F.when(F.col("_like").contains("\\"), F.lit("")).otherwise(F.substring(longest, 1, GRAM)))
    sizes = p.select(F.length("_gram").alias("_size")).distinct()
    grams = F.when(F.col("_size") == 0, F.array(F.lit(""))).when(
        F.length(text) >= F.col("_size"), F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.length(text) - F.col("_size") + 1), lambda i: F.substring(F.col(text), i, F.col("_size")))))
    sized = t.withColumn("_size", F.explode(sizes.select(F.collect_set("_size")).scalar()))
    met = sized.withColumn("_gram", F.explode(grams)).join(p, "_gram")
    return met.filter(F.expr(f"`{text}` like _like")).select(text).distinct()


def backfill_category(products: DataFrame, categories: DataFrame, text_col: str = "category",
                      as_written: bool = False) -> DataFrame:
    """Fill a null ``category_id`` from the product's category text.

    Intended: the category whose name equals the text case-blind (lowest id
    wins).  ``as_written``: when the text matches any subcategory name as an
    ILIKE pattern the reference's query returns every category, so the
    lowest category id is taken; otherwise the case-blind equality applies.
    Adds ``backfill`` = 'matched' | 'unmatched' | null (already set).
    """
    by_name = categories.groupBy(F.lower("name").alias("_lname")).agg(F.min("id").alias("_by_name"))
    need = F.col("category_id").isNull()
    out = products.join(by_name, F.lower(F.col(text_col)) == F.col("_lname"), "left")
    pick = F.col("_by_name")
    if as_written:
        subs = categories.filter(F.col("parent_id").isNotNull()).select(F.col("name").alias("_pattern"))
        hits = texts_like_any(products.filter(need).select(F.col(text_col).alias("_t")), "_t", subs, "_pattern")
        lowest = categories.select(F.min("id")).scalar()
        out = out.join(hits.withColumnRenamed("_t", "_hit"), F.lower(F.col(text_col)) == F.col("_hit"), "left")
        pick = F.when(F.col("_hit").isNotNull(), lowest).otherwise(F.col("_by_name"))
    cols = [F.when(need, pick).otherwise(F.col("category_id")).cast(products.schema["category_id"].dataType)
            .alias("category_id") if c == "category_id" else F.col(c) for c in products.columns]
    return out.select(*cols, F.when(need, F.when(pick.isNotNull(), "matched").otherwise("unmatched"))
                      .alias("backfill"))


def seed_tree(spark) -> DataFrame:
    """The fixed seed tree as rows (seq, parent, description, image, child)."""
    rows = [(i + 1, r, d, img, c) for i, (r, d, img, c) in
            enumerate((r, d, img, c) for r, d, img in SEED_ROOTS for c in SEED_CHILDREN[r])]
    return spark.createDataFrame(
        rows, "seq long, parent string, parent_description string, parent_image string, child string")


def seed_categories(categories: DataFrame, tree: DataFrame, as_of) -> DataFrame:
    """Insert-if-absent by exact name: parents first, then children.

    ``tree``: seq (unique per row), parent, parent_description,
    parent_image (goes to ``image_url`` where the table has it), child (may be null).  A new parent takes id max(id) + 1 +
    2*min(seq) of its rows, a new child max(id) + 2*seq + 2 of its first row,
    so ids are unique without a numbering pass.  A child gets its parent's
    id (existing or new) and the text 'X in Y category'; a name that exists
    already (as parent or child) is skipped.  Running it twice changes
    nothing.
    """
    base = categories.select(F.coalesce(F.max("id") + 1, F.lit(0)).cast("long")).scalar()
    taken = categories.select(F.col("name").alias("_n"))
    parents = tree.groupBy("parent").agg(
        F.min(F.struct("seq", "parent_description", "parent_image")).alias("_p"))
    new_parents = (parents.join(taken, F.col("parent") == F.col("_n"), "left_anti")
                   .select((base + 2 * F.col("_p.seq")).alias("id"), F.col("parent").alias("name"),
                           F.col("_p.parent_description").alias("description"),
                           F.lit(None).cast("long").alias("parent_id"), F.col("_p.parent_image").alias("image_url")))
    parent_ids = (categories.select(F.col("name").alias("_pn"), F.col("id").alias("_pid"))
                  .unionByName(new_parents.select(F.col("name").alias("_pn"), F.col("id").alias("_pid"))))
    children = (tree.filter(F.col("child").isNotNull())
                .groupBy("child").agg(F.min(F.struct("seq", "parent")).alias("_c"))
                .join(taken, F.col("child") == F.col("_n"), "left_anti")
                .join(new_parents.select(F.col("name").alias("_clash")), F.col("child") == F.col("_clash"), "left_anti")
                .join(parent_ids, F.col("_c.parent") == F.col("_pn"))
                .select((base + 2 * F.col("_c.seq") + 1).alias("id"), F.col("child").alias("name"),
                        F.concat(F.col("child"), F.lit(" in "), F.col("_c.parent"), F.lit(" category"))
                        .alias("description"), F.col("_pid").alias("parent_id")))
    new = new_parents.unionByName(children, allowMissingColumns=True).withColumn("created_at", F.lit(as_of).cast("timestamp_ntz"))
    new = new.select(*[c for c in new.columns if c in categories.columns])
    return categories.unionByName(new, allowMissingColumns=True).select(*categories.columns)


@dataclass(frozen=True)
class ColumnSpec:
    """One schema step: add if missing / drop and re-add / fill nulls."""
    name: str
    dtype: str
    default: object = None
    mode: str = "add"   # 'add' | 'replace' | 'backfill'


def evolve(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """Apply schema steps in order; re-running gives the same frame.

    add: a missing column appears filled with its default; replace: the
    column is dropped and re-added, so every row gets the default (the
    reference's type fix); backfill: nulls become the default.
    """
    for s in specs:
        value = F.lit(s.default).cast(s.dtype)
        if s.mode == "add":
            if s.name not in df.columns:
                df = df.withColumn(s.name, value)
        elif s.mode == "replace":
            df = df.drop(s.name).withColumn(s.name, value)
        elif s.mode == "backfill":
            if s.name in df.columns:
                df = df.withColumn(s.name, F.coalesce(F.col(s.name).cast(s.dtype), value))
            else:
                df = df.withColumn(s.name, value)
        else:
            raise ValueError(f"unknown mode {s.mode}")
    return df
