"""Reading list as the latest state of an action log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_actions(actions: DataFrame) -> DataFrame:
    """Current list rows per (user, article).

    Saving is idempotent, unsaving deletes, reading saves if needed, unread keeps the row.
    Everything is a max over a struct, so actions combine before the shuffle.
    """
    at = F.struct("ts", "event_id")
    keys = ["user_id", "article_id"]
    gone = actions.groupBy(*keys).agg(F.max(F.when(F.col("action") == "unsave", at)).alias("gone_at"))
    live = actions.join(gone, keys).where(F.col("gone_at").isNull() | (at > F.col("gone_at")))
    mark = F.col("action").isin("read", "unread")
    # an unread of something not on the list changes nothing, so the row starts with a save or read
    start = F.min(F.when(F.col("action").isin("save", "read"), at))
    g = live.groupBy(*keys).agg(
        start.alias("first"),
        F.max(F.when(mark, F.struct("ts", "event_id", (F.col("action") == "read").alias("is_read")))).alias("last_mark"),
    ).where(F.col("first").isNotNull())
    read = F.coalesce(F.col("last_mark.is_read"), F.lit(False))
    return g.select(*keys, F.col("first.ts").alias("saved_at"), read.alias("is_read"), F.when(read, F.col("last_mark.ts")).alias("read_at"))


def counts(saved: DataFrame) -> DataFrame:
    return saved.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("all"), F.count_if(~F.col("is_read")).alias("unread"), F.count_if("is_read").alias("read")
    )
