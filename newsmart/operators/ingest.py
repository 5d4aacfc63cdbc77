"""Batch ingest of landed feed items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions.text import clean_markup, strip, title_fingerprint
from newsmart.functions.urls import canonicalize_url, permalink
from newsmart.operators.joins import broadcast_if_small


def normalise(items: DataFrame) -> DataFrame:
    """Titled items with a permalink, canonical URL and title fingerprint."""
    url = permalink(F.col("link"), F.col("guid"))
    t = strip(F.col("title"))
    return (
        items.withColumn("title", t).withColumn("url", url).where((F.col("title") != "") & F.col("url").isNotNull())
        .withColumn("canonical_url", canonicalize_url(F.col("url"))).withColumn("title_fingerprint", title_fingerprint(F.col("title")))
    )


def collectable(sources: DataFrame) -> DataFrame:
    """Collection outcome each source can have before any item is read."""
    t = F.lower(F.coalesce("source_type", F.lit("rss")))
    return sources.withColumn(
        "collection",
        F.when(~F.col("active"), F.lit("SKIPPED_INACTIVE"))
        .when(t.isin(lx.FEED_SOURCE_TYPES) & (F.coalesce("feed_url", F.lit("")) != ""), F.lit("OK"))
        .when(t.isin(lx.UNSUPPORTED_SOURCE_TYPES), F.lit("SKIPPED_UNSUPPORTED"))
        .otherwise(F.lit("UNKNOWN_TYPE")),
    )


def from_open_sources(items: DataFrame, sources: DataFrame) -> DataFrame:
    ok = collectable(sources).where(F.col("collection") == "OK").select(F.col("name").alias("source_name"), F.col("id").alias("source_id"))
    return items.join(broadcast_if_small(ok), "source_name")


def new_items(normal: DataFrame, archive_urls: DataFrame) -> DataFrame:
    """The first item of every URL not yet archived, first by source name then item id.

    The winner is a min per URL (combined before the shuffle, so a URL repeated across a third
    of the batch costs one row per task); its columns come back by unique item id.
    """
    first = normal.groupBy("canonical_url").agg(F.min(F.struct("source_name", "item_id")).alias("f"))
    fresh = first.join(archive_urls.select("canonical_url").distinct(), "canonical_url", "left_anti")
    return normal.join(fresh.select(F.col("f.item_id").alias("item_id")), "item_id", "left_semi")


def with_clean_summary(rows: DataFrame) -> DataFrame:
    return rows.withColumn("raw_summary", clean_markup(F.col("summary"))).drop("summary")


def ingest_summary(items: DataFrame, fresh: DataFrame, sources: DataFrame) -> DataFrame:
    """Fetched, new, duplicate counts and status per source, then one total row."""
    s = collectable(sources).select("name", "collection")
    f = items.groupBy(F.col("source_name").alias("name")).agg(F.count(F.lit(1)).alias("fetched"))
    n = fresh.groupBy(F.col("source_name").alias("name")).agg(F.count(F.lit(1)).alias("new"))
    r = s.join(f, "name", "left").join(n, "name", "left")
    ok = F.col("collection") == "OK"
    r = r.select(
        "name", F.when(ok, F.coalesce("fetched", F.lit(0))).otherwise(F.lit(0)).alias("fetched"), F.coalesce("new", F.lit(0)).alias("new"),
        F.when(ok & F.col("fetched").isNull(), F.lit("EMPTY")).otherwise(F.col("collection")).alias("status"),
    )
    r = r.withColumn("duplicates", F.col("fetched") - F.col("new"))
    total = r.agg(F.sum("fetched").alias("fetched"), F.sum("new").alias("new"), F.sum("duplicates").alias("duplicates"))
    return r.unionByName(total.select(F.lit("TOTAL").alias("name"), "fetched", "new", "duplicates", F.lit("OK").alias("status")))
