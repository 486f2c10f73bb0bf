"""Similarity of texts by matching blocks, for which SQL has no form.

The measure is asymmetric and depends on the order of its arguments, as in Python's own library, which is
called here batch by batch. Cheap relational legs come first in every use, so that few rows reach it.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F

from tapeloom.functions.text import contains_either, initial_forms, norm_key, words


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple, float] = {}

    def one(x, y):
        if x is None or y is None:
            return None
        if (x, y) not in seen:
            seen[x, y] = SequenceMatcher(None, x, y).ratio()
        return seen[x, y]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """X-9: twice the matching letters over all letters; null where either text is null, 1 for two empty ones."""
    return F.pandas_udf(_ratios, "double")(a, b)


def names_related(a: Column, b: Column) -> Column:
    """X-36: whether two names may be one act's. False where either has no key."""
    x, y = norm_key(a), norm_key(b)
    cheap = (x == y) | contains_either(x, y, 4) | F.arrays_overlap(words(a), words(b)) | F.array_contains(initial_forms(b), x) | F.array_contains(initial_forms(a), y)
    return F.when((x == "") | (y == "") | x.isNull() | y.isNull(), False).when(F.coalesce(cheap, F.lit(False)), True).otherwise(ratio(x, y) >= 0.6)


def same_song(a: Column, b: Column) -> Column:
    """X-12: whether two titles are one song: equal, contained (six letters at least), or 0.85 similar."""
    x, y = norm_key(a), norm_key(b)
    return F.when((x == "") | (y == "") | x.isNull() | y.isNull(), False).when((x == y) | contains_either(x, y, 6), True).otherwise(ratio(x, y) >= 0.85)
