"""One annotation per article, under a named policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICIES = ("latest", "latest_success", "first_relevant", "first")


def pick_annotation(annotations: DataFrame, policy: str = "latest") -> DataFrame:
    """Keep one row per article.

    ``latest``: newest of any status; ``latest_success``: newest success;
    ``first_relevant``: first success that is relevant; ``first``: first of any status.
    A max/min over a struct combines on the map side, so an article with very many
    annotations never gathers in one task.
    """
    rows = annotations
    if policy == "latest_success":
        rows = rows.where(F.col("status") == "success")
    elif policy == "first_relevant":
        rows = rows.where((F.col("status") == "success") & F.col("is_relevant"))
    elif policy not in ("latest", "first"):
        raise ValueError(f"unknown policy {policy}")
    row = F.struct(*[F.col(c) for c in annotations.columns if c != "article_id"])
    if policy.startswith("latest"):
        best = F.max_by(row, F.struct("created_at", "annotation_id"))
    else:
        best = F.min_by(row, F.col("annotation_id"))
    return rows.groupBy("article_id").agg(best.alias("a")).select("article_id", "a.*")


def out_of_scope(annotations: DataFrame) -> DataFrame:
    """Article ids whose latest annotation says not relevant (null is not false)."""
    return pick_annotation(annotations.select("article_id", "annotation_id", "created_at", "status", "is_relevant")).where(
        F.col("is_relevant").eqNullSafe(False)
    ).select("article_id")
