"""Data-quality jobs: D1 check_rules, D3 profile_tables, D4 fk_audit, D8 payment_audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crypto import hmac_sha256_hex
from ..sources.model import DISCOUNT_TYPES, LINKS, ORDER_STATUSES, PAYMENT_METHODS, Link

# The shape rules the shop applies to submitted fields.
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE_PATTERN = r"^\d{10}$"          # after removing '-' and blanks
PHONE_STRIP = r"[-\s]"


def _ok(rule: str, c: Column) -> Column:
    """True when the value passes ``rule`` (null-safe: the result is never null)."""
    present = c.isNotNull() & (c.cast("string") != "")
    if rule == "required":
        return present
    if rule == "not_null":
        return c.isNotNull()
    if rule == "stars":      # a CHECK: null passes
        return F.coalesce(c.between(1, 5), F.lit(True))
    if rule.startswith("max_length:"):   # in characters, as VARCHAR(n)
        return c.isNull() | (F.length(c) <= int(rule.partition(":")[2]))
    if rule == "email":
        return c.isNotNull() & c.rlike(EMAIL_PATTERN)
    if rule == "phone":      # optional field: only a given value must have 10 digits
        return c.isNull() | (c == "") | F.regexp_replace(c, PHONE_STRIP, "").rlike(PHONE_PATTERN)
    if rule == "offer_range":
        v = c.cast("string").try_cast("long")
        return c.isNull() | (v.isNotNull() & (v >= 0) & (v <= 100))
    if rule == "rating_range":
        v = c.cast("string").try_cast("long")
        return v.isNotNull() & (v >= 1) & (v <= 5)
    if rule == "discount_type":
        return c.isNotNull() & c.isin(list(DISCOUNT_TYPES))
    if rule == "payment_method":
        return c.isNotNull() & c.isin(list(PAYMENT_METHODS))
    if rule == "order_status":
        return c.isNotNull() & c.isin(list(ORDER_STATUSES))
    if rule == "numeric":
        return c.isNull() | c.cast("string").try_cast("double").isNotNull()
    raise ValueError(f"unknown rule {rule}")


RULES = ("required", "email", "phone", "offer_range", "rating_range", "discount_type",
         "payment_method", "order_status", "numeric", "not_null", "stars", "max_length:n")


def check_rules(df: DataFrame, rules: list[tuple[str, str]], keep: list[str] | None = None) -> DataFrame:
    """Per row, which of ``rules`` [(rule, column), ...] it breaks.

    Adds ``broken`` (array of 'rule:column' in rule order), ``broken_rules``
    (the same joined by ',', '' when clean) and ``n_broken``.
    """
    flags = [F.when(~_ok(r, F.col(c)), F.lit(f"{r}:{c}")) for r, c in rules]
    broken = F.filter(F.array(*flags), lambda x: x.isNotNull())
    out = df.select(*(keep or df.columns), broken.alias("broken"))
    return out.withColumn("broken_rules", F.array_join("broken", ",")) \
              .withColumn("n_broken", F.size("broken"))


def profile_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """D3: (table summary, column list).

    Summary: one row per table with its row count, column count and a
    sample row as JSON (the row with the smallest first column, of equals
    the smallest in the further columns, so the sample is stable; only that
    row is rendered).  Counts are partial aggregates, one job per table
    union.  Column list: table, position, name and type from the schemas.
    """
    parts = []
    for name, df in tables.items():
        sample = F.min(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count"), sample.alias("_s")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("n_columns"),
            F.to_json("_s", {"ignoreNullFields": "false"}).alias("sample_row")))
    summary = reduce(DataFrame.unionByName, parts)
    cols = [(name, i + 1, f.name, f.dataType.simpleString())
            for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    columns = spark.createDataFrame(cols, "table_name string, position int, column_name string, data_type string")
    return summary, columns


def fk_audit(tables: dict[str, DataFrame], links: tuple[Link, ...] = LINKS) -> DataFrame:
    """For every link among ``tables``: child rows, null links and orphans.

    An orphan is a non-null key with no parent row.  Per parent table its
    ids and the keys of all links into it are unioned as (key, link number)
    and aggregated by key: how often each link holds the key, and whether
    the parent has it.  Keys are counted before the shuffle, so a hot or
    null key is one row a task, and no side is sorted: a task holds one
    entry per distinct key of its part, not its child rows.  Links whose
    tables or column are absent are skipped, as are empty child tables.
    """
    by_parent: dict[str, list[Link]] = {}
    for link in links:
        if link.child in tables and link.parent in tables and link.column in tables[link.child].columns:
            by_parent.setdefault(link.parent, []).append(link)
    counts = []
    for parent, ls in by_parent.items():
        sides = [(tables[parent], "id", -1)] + [(tables[l.child], l.column, i) for i, l in enumerate(ls)]
        keys = reduce(DataFrame.unionByName, [df.select(F.col(c).cast("long").alias("_k"), F.lit(i).alias("_link"))
                                              for df, c, i in sides])
        by_key = keys.groupBy("_k").agg((F.min("_link") == -1).alias("_hit"), *[
            F.count_if(F.col("_link") == i).alias(f"_n{i}") for i in range(len(ls))])
        orphan = F.col("_k").isNotNull() & ~F.col("_hit")
        total = by_key.agg(*[F.coalesce(F.sum(F.when(which, F.col(f"_n{i}"))), F.lit(0)).alias(f"_{name}{i}")
                             for i in range(len(ls)) for name, which in (
                                 ("rows", F.lit(True)), ("nulls", F.col("_k").isNull()), ("orphans", orphan))])
        counts.append(total.select(F.inline(F.array(*[F.struct(
            F.lit(l.child).alias("child_table"), F.lit(l.column).alias("column_name"),
            F.lit(l.parent).alias("parent_table"), F.lit(l.on_delete).alias("on_delete"),
            F.col(f"_rows{i}").alias("child_rows"), F.col(f"_nulls{i}").alias("null_links"),
            F.col(f"_orphans{i}").alias("orphan_rows")) for i, l in enumerate(ls)]))))
    return reduce(DataFrame.unionByName, counts).filter(F.col("child_rows") > 0)


def payment_audit(payments: DataFrame, secret: bytes | str) -> DataFrame:
    """Check payment signatures and amounts in bulk.

    ``payments``: gateway_order_id, payment_id, signature, amount.
    ``signature_ok`` = signature equals hex HMAC-SHA256(secret,
    gateway_order_id + '|' + payment_id); ``amount_minor`` = Math.round of
    the amount times 100 in double arithmetic, i.e. floor(double(amount) *
    100 + 0.5) (1.005 gives 100, as in the reference); ``amount_ok`` =
    amount > 0.
    """
    msg = F.concat(F.col("gateway_order_id"), F.lit("|"), F.col("payment_id"))
    return payments.select(
        "*",
        (F.coalesce(F.col("signature") == hmac_sha256_hex(secret, msg), F.lit(False))).alias("signature_ok"),
        F.floor(F.col("amount").cast("double") * F.lit(100.0) + F.lit(0.5)).cast("long").alias("amount_minor"),
        F.coalesce(F.col("amount") > 0, F.lit(False)).alias("amount_ok"))
