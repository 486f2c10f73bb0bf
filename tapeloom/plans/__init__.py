"""The registered queries of the core, by family."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("problems", "composites", "decisions", "filters", "joins", "aggregates", "windows", "scalars", "inputs", "streams", "mutations")
FLAGSHIP = "merge_trust_order"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of the core."""
    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    """SQL of those that SQL can express."""
    found = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__name__}.{name}"), "ORACLE", {})
    return found


def covered() -> dict[str, list[str]]:
    """Inventory ids and the queries that cover them."""
    out: dict[str, list[str]] = {}
    for name in MODULES:
        for query, ids in getattr(importlib.import_module(f"{__name__}.{name}"), "COVERS", {}).items():
            for i in ids:
                out.setdefault(i, []).append(query)
    return out
