"""Operator 12: how filters interact, by the Hart-Mas-Colell potential of their removal game.

The players are the filters; a coalition's worth v(S) is the number of documents
that fail any of its filters.  Documents are first reduced to counts per (part,
mask of failed filters), at most 2^k rows a part, with map-side combining, so
the game itself reads nothing but those counts.  The potential follows the
recursion P(S) = (v(S) + sum over i in S of P(S without i)) / |S|, P(none) = 0;
filter i has Shapley value P(all) - P(all without i).  All potentials are
carried times k!, which keeps every one of them a whole number, and k! times the
Shapley value is the sum of the filter's removals over all k! orders.  What a
filter removes at its step of an order is v(prefix with it) - v(prefix), so no
order is ever replayed over documents.

Copies are found by the SHA-256 of the whole text.  Only hashes, ids and masks
are shuffled: once by hash (the smaller side holds repeated texts alone, the
larger one is splittable when a text is hot) and once by doc_id for the labels.

Defined results: a null text is an empty text; a null part is the part ''; a
null doc_id has no order, so it is never a later copy and makes none, and has
no label; rows that repeat a doc_id and its text are not copies of each other;
a doc_id with several label rows has a label if any of them says 1; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The name under which a filter is given the table-wide test for earlier copies.
COPY = "earlier copy"


def quality_filters() -> dict[str, Callable[[Column, Column], Column] | str]:
    """Filter name -> failure condition of (text, its words), or ``COPY``."""
    return {
        "A": lambda text, words: F.size(words) < 200,
        "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": lambda text, words: 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 2 * F.length(text),
        "D": lambda text, words: text.rlike("[#$%&*|]"),
        "E": COPY,
    }


def failure_masks(docs: DataFrame, filters: dict, part: str = "source") -> DataFrame:
    """(doc_id, part, mask): bit i is set if the document fails the i-th filter."""
    text = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text"))
    split = text.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    bits = [F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0)
            for i, fails in enumerate(filters.values()) if fails is not COPY]
    copy_bit = sum(1 << i for i, fails in enumerate(filters.values()) if fails is COPY)
    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256)) if copy_bit else F.lit(None).cast("binary")
    rows = split.select("doc_id", "part", sum(bits, F.lit(0)).alias("mask"), key.alias("key"))
    if not copy_bit:
        return rows.drop("key")
    rows = cut(rows)
    repeated = (rows.filter("doc_id is not null").groupBy("key")
                .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                .filter(F.col("first") < F.col("last")).select("key", "first"))
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(repeated, "key", "left").select(
        "doc_id", "part", (F.col("mask") + F.when(later, copy_bit).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, marks: DataFrame, tallies: list[str]) -> DataFrame:
    """(part, mask, n and one count a tally); ``marks`` has (doc_id and boolean tallies), one row a doc_id."""
    joined = masks.join(marks, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.count_if(F.col(t)).alias(t) for t in tallies])


def removal_games(counts: DataFrame, k: int, tallies: list[str]) -> DataFrame:
    """Per part: total, and for n and each tally an array of v(S) by coalition mask (``v_...``)."""
    def worth(name):
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(name))), F.lit(0))
                         for s in range(1 << k)])
    return counts.groupBy("part").agg(F.sum("n").alias("total"), *[worth(t).alias(f"v_{t}") for t in ["n", *tallies]])


def potentials(games: DataFrame, k: int) -> DataFrame:
    """``games`` with ``potential``: k! times the potential of every coalition, by mask."""
    by_size = sorted(range(1, 1 << k), key=int.bit_count)
    out = games.withColumn("_p0", F.lit(0).cast("long"))
    for size in range(1, k + 1):
        out = out.withColumns({
            f"_p{s}": F.expr(f"({factorial(k)} * v_n[{s}] + "
                             + " + ".join(f"_p{s ^ (1 << i)}" for i in range(k) if s >> i & 1) + f") div {size}")
            for s in by_size if s.bit_count() == size})
    kept = [*games.columns, F.array(*[F.col(f"_p{s}") for s in range(1 << k)]).alias("potential")]
    return out.select(*kept)


def order_steps(games: DataFrame, names: list[str], tallies: list[str]) -> DataFrame:
    """One row per part, order of the filters and step, from coalition differences."""
    k, full = len(names), (1 << len(names)) - 1
    orders = list(permutations(range(k)))
    before = [sum(1 << i for i in o[:j]) for o in orders for j in range(k)]

    def pick(values: list, at: Column) -> Column:
        return F.get(F.lit(values), at)

    at = F.col("_at")
    rows = games.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(before) - 1))).alias("_at"))
    rows = rows.withColumns({
        "filter_order": pick(["".join(names[i] for i in o) for o in orders], F.floor(at / k).cast("int")),
        "step": (at % k + 1).cast("int"), "_before": pick(before, at),
        "_own": pick([1 << i for o in orders for i in o], at)})
    after, rest = F.col("_before") + F.col("_own"), F.lit(full) - F.col("_own")

    def gain(array: str, start: Column, end: Column) -> Column:
        return F.get(array, end) - F.get(array, start)

    removed = gain("v_n", F.col("_before"), after)
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - F.get("v_n", after)).alias("kept"), removed.alias("removed"),
        (F.get("v_n", F.col("_own")) - removed).alias("redundant"),
        gain("v_n", rest, F.lit(full)).alias("unique_fails"),
        *[gain(f"v_{t}", F.col("_before"), after).alias(f"{t}_lost") for t in tallies],
        gain("potential", rest, F.lit(full)).alias("shapley"))


def audit_filters(docs: DataFrame, marks: DataFrame, filters: dict, part: str = "source") -> DataFrame:
    """All steps of all orders of ``filters`` per part of ``docs``.

    ``marks`` holds doc_id and boolean columns; each is counted as ``<column>_lost``.  Names of filters are one
    letter each; up to about seven filters (k! orders a part are returned).
    """
    tallies = [c for c in marks.columns if c != "doc_id"]
    marks = marks.filter("doc_id is not null").groupBy("doc_id").agg(*[F.bool_or(t).alias(t) for t in tallies])
    counts = mask_counts(failure_masks(docs, filters, part), marks, tallies)
    return order_steps(potentials(removal_games(counts, len(filters), tallies), len(filters)), list(filters), tallies)
