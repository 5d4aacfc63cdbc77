"""Headline similarity: token Jaccard or matching-blocks ratio, whichever is larger."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def similar(a: str, b: str, threshold: float) -> bool:
    """Same answer as comparing the full similarity; cheap upper bounds go first. Inputs are lower case."""
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return False
    if len(ta & tb) / len(ta | tb) >= threshold:
        return True
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) if x and y else 0.0 for x, y in zip(a, b)], dtype="float64")


def jaccard(a: Column, b: Column) -> Column:
    x = F.array_distinct(F.filter(F.split(F.lower(a), r"\s+"), lambda w: w != ""))
    y = F.array_distinct(F.filter(F.split(F.lower(b), r"\s+"), lambda w: w != ""))
    union = F.size(F.array_union(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def headline_similarity(a: Column, b: Column) -> Column:
    j = jaccard(a, b)
    return F.when(j > 0, F.greatest(j, sequence_ratio(F.lower(a), F.lower(b)))).otherwise(sequence_ratio(F.lower(a), F.lower(b)))


def matcher(threshold: float):
    """UDF: is a lower-case title similar to any of a short list of kept ones?"""

    @F.pandas_udf(T.BooleanType())
    def any_similar(title: pd.Series, kept: pd.Series) -> pd.Series:
        return pd.Series([any(similar(t, k, threshold) for k in ks) if t else False for t, ks in zip(title, kept)], dtype="bool")

    return any_similar
