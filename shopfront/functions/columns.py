"""Column-expression helpers (all JVM-side built-ins, no Python per row)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.model import MONEY


def money(c: Column | str) -> Column:
    """Money result column with a fixed width, equal across engines."""
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def all_of(preds: list[Column]) -> Column:
    """AND of the given predicates; an empty list keeps every row."""
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def any_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds) if preds else F.lit(False)


def lower_in(c: Column | str, values: list[str]) -> Column:
    """Case-blind ``= ANY(array)``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.lower(col).isin([v.lower() for v in values])


def lower_overlap(c: Column | str, values: list[str]) -> Column:
    """Case-blind array overlap ``&&``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.arrays_overlap(F.transform(col, F.lower), F.array(*[F.lit(v.lower()) for v in values]))


def avg_1dp(total: Column, n: Column) -> Column:
    """AVG(int)::numeric(10,1) without double rounding.

    Half away from zero on the exact ratio total/n (both integers, n > 0):
    floor((20*total + n) / (2*n)) / 10 for non-negative totals.
    """
    t = total.cast("long")
    k = n.cast("long")
    tenths = F.floor((F.lit(20) * t + k) / (F.lit(2) * k))
    return (tenths.cast("decimal(20,0)") / F.lit(10)).cast("decimal(10,1)")


def first_by(df: DataFrame, keys: list[str], order: list[Column], cols: list[str]) -> DataFrame:
    """Per key, the row that sorts first by ``order`` (a skew-safe partial aggregate).

    ``min(struct(order..., cols...))`` combines map-side, so a hot key never
    gathers its rows in one task the way a window sort would.
    """
    packed = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                      *[F.col(c).alias(c) for c in cols])
    out = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in cols])


def last_by(df: DataFrame, keys: list[str], order: list[Column], cols: list[str]) -> DataFrame:
    """Per key, the row that sorts last by ``order`` (max of a struct)."""
    packed = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                      *[F.col(c).alias(c) for c in cols])
    out = df.groupBy(*keys).agg(F.max(packed).alias("_last"))
    return out.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in cols])
