"""Evidence records, citations and extractive answers for a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmart.functions.text import strip
from newsmart.operators.annotations import pick_annotation
from newsmart.operators.joins import with_source

NOTHING = (
    "No matching intelligence records were found in the archive for this query. "
    "Try broadening search keywords or removing category/date filters."
)


def evidence_records(page: DataFrame, articles: DataFrame, annotations: DataFrame, sources: DataFrame) -> DataFrame:
    """Numbered records of each question's result page."""
    latest = pick_annotation(annotations).select(
        F.col("article_id").alias("id"), F.col("summary").alias("a_sum"), F.col("primary_category").alias("a_cat"), "topics", F.lit(True).alias("noted")
    )
    a = with_source(articles.select("id", "source_id", "title", "raw_summary", "canonical_url", "published_at", "collected_at", "primary_category"), sources, ["name"])
    r = page.select("query_id", "id", F.col("rank").alias("number")).join(a, "id").join(latest, "id", "left")
    cat = F.when(F.col("noted"), F.col("a_cat")).otherwise(F.col("primary_category"))
    return r.select(
        "query_id", "number", "id", "title", "canonical_url", F.coalesce("source_name", F.lit("RSS Feed")).alias("source"),
        F.coalesce("published_at", "collected_at").alias("at"), F.coalesce(F.when(cat != "", cat), F.lit("World")).alias("category"),
        F.coalesce(F.when(F.col("a_sum") != "", F.col("a_sum")), F.col("raw_summary"), F.col("title")).alias("summary"),
        F.slice(F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.regexp_replace(strip(t), "^#+", "")), 1, 4).alias("topics"),
    )


def answer_packs(queries: DataFrame, records: DataFrame) -> DataFrame:
    """One answer per question: citations, date range and extractive text. A page is at most its size."""
    item = F.struct("number", "id", "title", "source", "summary", "category", F.date_format("at", "yyyy-MM-dd").alias("date"), "canonical_url")
    g = records.groupBy("query_id").agg(
        F.array_sort(F.collect_list(item)).alias("c"), F.date_format(F.min("at"), "MMM dd, yyyy").alias("lo"), F.date_format(F.max("at"), "MMM dd, yyyy").alias("hi")
    )
    bullets = F.transform("c", lambda x: F.concat(F.lit("["), x["id"].cast("string"), F.lit("] "), x["title"]))
    n = F.coalesce(F.size("c"), F.lit(0))
    found = F.col("c").isNotNull()
    return queries.select("query_id", "question").join(g, "query_id", "left").select(
        "query_id", "question", F.when(found, n).otherwise(F.lit(0)).alias("evidence_count"), F.col("c").alias("citations"),
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(found, F.concat("lo", F.lit(" – "), "hi")).alias("date_range"),
        F.when(found, F.concat(F.lit("Based on "), n.cast("string"), F.lit(" matching archive record(s): "), F.array_join(bullets, "; "))).otherwise(F.lit(NOTHING)).alias("answer"),
        F.when(found, F.lit("high")).otherwise(F.lit("low")).alias("confidence"), (~found).alias("insufficient_evidence"),
    )


def cited_only(packs: DataFrame) -> DataFrame:
    """Keep the citations whose numbers are in ``cited``; all of them when none is."""
    kept = F.filter("citations", lambda c: F.array_contains(F.col("cited"), c["number"]))
    return packs.withColumn("final", F.when(F.size(kept) > 0, kept).otherwise(F.col("citations"))).withColumn(
        "fake", F.array_except("cited", F.transform("citations", lambda c: c["number"]))
    )
