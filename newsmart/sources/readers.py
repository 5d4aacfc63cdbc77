"""Landed-file readers. Every schema is explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmart.functions.text import strip
from newsmart.functions.urls import permalink

REGISTRY = (
    "name STRING, website_url STRING, feed_url STRING, source_type STRING, category STRING, trust_tier STRING, "
    "provenance STRING, active BOOLEAN, replacement_candidate BOOLEAN, country_code STRING, source_family STRING, notes STRING"
)
ANNOTATION = (
    "is_relevant BOOLEAN, primary_category STRING, rejection_reason STRING, topics ARRAY<STRING>, countries ARRAY<STRING>, "
    "entities ARRAY<STRING>, summary STRING, importance_score INT, relevance_score INT, event_type STRING"
)
RSS_ITEM = "title STRING, link STRING, guid STRING, pubDate STRING, updated STRING, description STRING"
ATOM_LINK = "ARRAY<STRUCT<_href: STRING, _rel: STRING>>"
ATOM_ENTRY = f"title STRING, link {ATOM_LINK}, id STRING, published STRING, updated STRING, summary STRING"
PRICE_PAYLOAD = "instrument BIGINT, timestamp ARRAY<BIGINT>, close ARRAY<DOUBLE>"
QUESTION = "STRUCT<id: BIGINT, category: STRING, question: STRING>"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).json(path, multiLine=True)


def feed_time(c: Column) -> Column:
    """RFC 822 or ISO publication time as a UTC instant."""
    zoned = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]+,\s*", ""), "(GMT|UTC|UT|Z)$", "+0000")
    return F.coalesce(F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(F.trim(c)))


def feed_entries(raw: DataFrame) -> DataFrame:
    """Titled entries with a usable permalink, from parsed item columns."""
    return raw.select(
        *[c for c in raw.columns if c not in ("title", "link", "guid", "pubDate", "updated", "description")],
        strip(F.col("title")).alias("title"), permalink(F.col("link"), F.col("guid")).alias("url"),
        F.coalesce(feed_time(F.col("pubDate")), feed_time(F.col("updated"))).alias("published_at"),
        F.col("description").alias("summary"),
    ).where((F.col("title") != "") & F.col("url").isNotNull())


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    return feed_entries(spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    e = spark.read.format("xml").option("rowTag", "entry").schema(ATOM_ENTRY).load(path)
    main = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return feed_entries(
        e.select(
            "title", F.get(main, 0)["_href"].alias("link"), F.col("id").alias("guid"), F.col("published").alias("pubDate"), "updated",
            F.col("summary").alias("description"),
        )
    )


def parse_rss_items(xml: DataFrame, column: str = "xml") -> DataFrame:
    """The same entries from rows that hold one item's XML each."""
    keep = [c for c in xml.columns if c != column]
    return feed_entries(xml.select(*keep, F.from_xml(column, RSS_ITEM).alias("x")).select(*keep, "x.*"))


def parse_annotations(rows: DataFrame, column: str = "output_json") -> DataFrame:
    """Typed view of annotation JSON. Broken text gives nulls; entity items may be objects or names."""
    x = rows.withColumn("x", F.from_json(column, ANNOTATION, {"mode": "PERMISSIVE"}))
    return x.select(*rows.columns, "x.*")


def parse_price_payloads(rows: DataFrame, as_of: Column, column: str = "payload") -> DataFrame:
    """(instrument, at, close) points; null, non-positive and future points are dropped."""
    x = rows.select(F.from_json(column, PRICE_PAYLOAD).alias("x")).select(
        "x.instrument", F.explode(F.arrays_zip(F.col("x.timestamp").alias("t"), F.col("x.close").alias("c"))).alias("p")
    )
    at = F.timestamp_seconds("p.t")
    return x.where((F.col("p.c") > 0) & (at <= as_of)).select("instrument", at.alias("at"), F.col("p.c").alias("close"))


def parse_gold(rows: DataFrame, column: str = "json") -> DataFrame:
    """Questions from a bare list or from an object with a ``questions`` list."""
    listed = F.from_json(column, f"ARRAY<{QUESTION}>")
    wrapped = F.from_json(column, f"STRUCT<questions: ARRAY<{QUESTION}>>")["questions"]
    items = F.when(F.ltrim(F.col(column)).startswith("["), listed).otherwise(wrapped)
    return rows.select(F.explode(items).alias("q")).select("q.*")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return parse_gold(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))
