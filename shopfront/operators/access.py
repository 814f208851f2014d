"""Q23 row visibility: the shop's row policies as DataFrame filters.

``visible_rows`` answers for one caller (a filter, or a semi join through
the parent table for 'owner_via').  ``row_owners`` answers for all users at
once: it tags each row with the one user who owns it, which is linear in
the table instead of pairing every row with every user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.model import POLICIES, Policy


def policy_for(table: str, action: str) -> Policy | None:
    for p in POLICIES:
        if p.table == table and p.action == action:
            return p
    return None


def visible_rows(df: DataFrame, table: str, action: str, user_id: int | None, role: str | None,
                 parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows of ``table`` the caller may ``action``; no policy means no rows."""
    p = policy_for(table, action)
    if p is None:
        return df.filter(F.lit(False))
    if p.kind == "public":
        return df
    if p.kind == "admin":
        return df if role == "admin" else df.filter(F.lit(False))
    if user_id is None:
        return df.filter(F.lit(False))
    if p.kind == "owner":
        return df.filter(F.col("user_id") == F.lit(user_id))
    if p.kind == "self":
        return df.filter(F.col("id") == F.lit(user_id))
    if p.kind == "owner_via":
        col, parent = p.via
        mine = (parents or {})[parent].filter(F.col("user_id") == F.lit(user_id)).select(
            F.col("id").alias("_pid"))
        return df.join(mine, F.col(col) == F.col("_pid"), "left_semi")
    raise ValueError(f"unknown policy kind {p.kind}")


def row_owners(df: DataFrame, table: str, action: str,
               parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """Every row of an owner-governed table with ``owner_id``, the user who may see it.

    Public and admin-only tables have no single owner; they raise.
    """
    p = policy_for(table, action)
    if p is None:
        return df.filter(F.lit(False)).withColumn("owner_id", F.lit(None).cast("long"))
    if p.kind == "owner":
        return df.withColumn("owner_id", F.col("user_id"))
    if p.kind == "self":
        return df.withColumn("owner_id", F.col("id"))
    if p.kind == "owner_via":
        col, parent = p.via
        own = (parents or {})[parent].select(F.col("id").alias("_pid"), F.col("user_id").alias("owner_id"))
        return df.join(own, F.col(col) == F.col("_pid"), "inner").drop("_pid")
    raise ValueError(f"{table}/{action} is not owner-governed ({p.kind})")
