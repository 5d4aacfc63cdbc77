"""Joins with small dimensions, checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmart.sources.bind import DIMENSION_ROWS

_checked: dict[tuple, bool] = {}


def is_small(df: DataFrame, key: tuple | None = None, rows: int = DIMENSION_ROWS) -> bool:
    """True when the frame has at most ``rows`` rows. Counts stop one row past the bound."""
    if key is not None and key in _checked:
        return _checked[key]
    small = df.limit(rows + 1).count() <= rows
    if key is not None:
        _checked[key] = small
    return small


def broadcast_if_small(df: DataFrame, key: tuple | None = None) -> DataFrame:
    """A broadcast hint behind a row count; otherwise the join is left to adaptive execution,
    whose skew handling splits a source or country that holds much of the archive."""
    return F.broadcast(df) if is_small(df, key) else df


def with_source(articles: DataFrame, sources: DataFrame, columns: list[str], how: str = "left") -> DataFrame:
    """Attach source columns as ``source_<column>``."""
    dim = sources.select(F.col("id").alias("source_id"), *[F.col(c).alias(f"source_{c}") for c in columns])
    key = ("sources", sources.sparkSession.sparkContext.applicationId, tuple(sorted(sources.inputFiles())))
    return articles.join(broadcast_if_small(dim, key), "source_id", how)
