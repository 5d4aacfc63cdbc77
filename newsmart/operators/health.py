"""Source health and arrival freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmart.functions.numbers import round_half_up
from newsmart.functions.scoring import source_status


def source_health(articles: DataFrame, sources: DataFrame, as_of: Column, stale_days: int = 7) -> DataFrame:
    """Status, item count and newest item of every source."""
    at = F.coalesce("published_at", "collected_at")
    g = articles.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("oldest"), F.max(at).alias("newest"),
        F.max_by("collected_at", F.struct(at, F.col("id"))).alias("last_collected"),
    )
    rows = sources.join(g, sources["id"] == g["source_id"], "left").withColumn("items", F.coalesce("n", F.lit(0)))
    status = source_status(
        F.col("active"), F.col("source_type"), F.col("feed_url"), F.lit("OK"), F.col("items"), F.col("newest"), as_of, stale_days
    )
    return rows.withColumn("status", status)


def arrivals(articles: DataFrame, annotations: DataFrame, as_of: Column) -> DataFrame:
    """Items collected in the last 30 minutes to 4 hours and the age of the newest of each stage."""
    c = F.col("collected_at")
    within = lambda text: F.count_if((c >= as_of - F.expr(text)) & (c <= as_of))
    age = lambda col: round_half_up(
        (F.unix_micros(as_of) - F.unix_micros(F.max(F.when(F.col(col) <= as_of, F.col(col))))) / F.lit(60000000.0), 1
    )
    a = articles.agg(
        within("INTERVAL 30 MINUTES").alias("last_30m"), within("INTERVAL 1 HOUR").alias("last_1h"),
        within("INTERVAL 2 HOURS").alias("last_2h"), within("INTERVAL 4 HOURS").alias("last_4h"),
        age("collected_at").alias("item_minutes"), age("published_at").alias("published_minutes"),
    )
    return a.select("*", annotations.agg(age("processed_at").alias("x")).scalar().alias("annotation_minutes"))


def soak(articles: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per collection day: volume, duplicate URLs, corrupt rows, hourly rate and backlog."""
    done = annotations.select(F.col("article_id").alias("id"), F.lit(True).alias("done")).distinct()
    rows = articles.select("id", "title", "canonical_url", F.to_date("collected_at").cast("string").alias("day")).join(done, "id", "left")
    per_url = rows.groupBy("day", "canonical_url").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("title") == "") | (F.col("canonical_url") == "")).alias("bad"),
        F.count_if(F.col("done").isNull()).alias("open"),
    )
    return per_url.groupBy("day").agg(
        F.sum("n").alias("new_items"), (F.sum("n") - F.count(F.lit(1))).alias("duplicate_urls"), F.sum("bad").alias("corrupt"),
        round_half_up(F.sum("n") / F.lit(24.0), 4).alias("per_hour"), F.sum("open").alias("backlog"),
    )
