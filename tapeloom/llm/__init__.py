"""Operators for preparing training data from the catalogue's texts and names.

Nothing else in the library imports this package; it imports the rest freely.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("mojibake", "names", "lookalike", "canonical", "linkage", "packing", "mixing", "spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of problems 2 to 9."""
    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    """SQL of those queries that SQL can express."""
    found = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__name__}.{name}"), "ORACLE", {})
    return found
