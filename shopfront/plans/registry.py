"""Registry of named queries: a Spark builder and its DuckDB oracle SQL.

A builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver tables of that folder.  The oracle is plain SQL over the driver's
views, with the shop tables supplied as CTEs (``with_fixtures``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle_fixtures import with_fixtures

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, ctes: dict | None = None):
    """Decorator: add a builder under ``name`` with an optional oracle SQL body."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_fixtures(oracle, ctes)
        return fn
    return deco


MODULES = ("q_catalog", "q_kpis", "q_orders", "q_promotions", "q_changes", "q_quality", "q_streams", "q_documents")


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")
