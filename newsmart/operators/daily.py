"""Article editions: pool, eligibility, near-duplicate suppression, caps, rescoring and sections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmart.functions import dates, scoring
from newsmart.operators import suppress
from newsmart.operators.annotations import pick_annotation
from newsmart.operators.joins import with_source
from newsmart.operators.selection import Cap, capped_selection
from newsmart.operators.suppress import TILE
from newsmart.session import cut_lineage

SIZE, MIN_SIZE = 25, 12


def pool(articles: DataFrame, as_of: Column, enough: int = 10) -> DataFrame:
    """Per local day: articles published that day, or by effective time when there are too few."""
    keep = articles.where(F.coalesce("published_at", "collected_at") <= as_of)
    by_eff = keep.withColumn("edition_date", dates.local_date(F.coalesce("published_at", "collected_at")))
    published = F.col("published_at").isNotNull()
    n = by_eff.groupBy("edition_date").agg(F.count_if(published).alias("n_published"))
    return by_eff.join(n, "edition_date").where(published | (F.col("n_published") < enough)).drop("n_published")


def with_reason(rows: DataFrame, annotations: DataFrame, sources: DataFrame) -> DataFrame:
    """First failing eligibility rule, or ELIGIBLE."""
    a = pick_annotation(annotations, "latest_success").select(
        F.col("article_id").alias("id"), F.lit(True).alias("annotated"), "is_relevant", F.col("primary_category").alias("annotated_category"),
        "relevance_score", "importance_score",
    )
    r = with_source(rows, sources, ["active", "category", "trust_tier", "country_code", "name"]).join(a, "id", "left")
    cat = F.coalesce("annotated_category", "primary_category", "source_category")
    reason = (
        F.when(~F.coalesce("source_active", F.lit(True)), F.lit("inactive_source")).when(F.col("annotated").isNull(), F.lit("ai_failed"))
        .when(F.col("is_relevant").eqNullSafe(False), F.lit("out_of_scope")).when(F.col("is_relevant").isNull(), F.lit("null_relevance"))
        .when(cat.isNull(), F.lit("invalid_category")).otherwise(F.lit("ELIGIBLE"))
    )
    return r.withColumn("reason", reason)


def scored(rows: DataFrame, bridge: DataFrame) -> DataFrame:
    """Eligible rows with country, category and preliminary score ``s`` (no diversity yet)."""
    first = bridge.groupBy(F.col("article_id").alias("id")).agg(F.min("country_code").alias("bridge_country"))
    r = rows.where(F.col("reason") == "ELIGIBLE").join(first, "id", "left")
    r = r.withColumn("country", F.upper(F.coalesce("bridge_country", "source_country_code"))).withColumn(
        "category", F.when(F.col("annotated_category") != "", F.col("annotated_category")).otherwise(F.lit("World"))
    )
    return r.withColumn("s", _score(F.lit(0), F.lit(0)))


def _score(n_source: Column, n_country: Column) -> Column:
    at = F.coalesce("published_at", "collected_at")
    age = dates.hours_between(dates.day_end_inclusive(F.col("edition_date")), at)
    return scoring.edition_score(F.col("relevance_score"), F.col("importance_score"), age, F.col("source_trust_tier"), n_source, n_country)


def score_order(score: Column) -> Column:
    return F.struct((-score).alias("s"), F.col("id").alias("i"))


def suppress_duplicates(rows: DataFrame, threshold: float = 0.70, tile: int = TILE) -> DataFrame:
    """Greedy near-duplicate suppression in score order within each edition: a row goes when a kept, better row has its URL
    or a similar headline. The lexicographically first independent set over the tables of equal URLs and similar titles
    (operators/suppress.py) is what the sequential pass keeps."""
    named = rows.select("edition_date", score_order(F.col("s.score")).alias("ord"), "id", F.lower("title").alias("t"), F.coalesce("canonical_url", F.lit("")).alias("url"))
    return rows.join(suppress.kept(named, threshold, tile), ["edition_date", "id"], "left_semi")


def select_articles(rows: DataFrame) -> DataFrame:
    """Capped selection with the relaxed refill: (edition_date, id, outcome, pick order)."""
    item = F.struct("id", F.coalesce("source_id", F.lit(0)).alias("source"), "category", F.expr("nullif(country, 'GLOBAL')").alias("country"))
    caps = [Cap("source_cap", "source", 2), Cap("category_cap", "category", math.ceil(SIZE * 0.30)), Cap("country_cap", "country", math.ceil(SIZE * 0.25))]
    d = capped_selection(rows, "edition_date", score_order(F.col("s.score")), item, SIZE, caps).select(
        "edition_date", "ord", "outcome", F.col("item.id").alias("id")
    )
    n = d.groupBy("edition_date").agg(F.count_if(F.col("outcome") == "SELECTED").alias("n"))
    # the refill needs at most MIN_SIZE rejected rows per edition
    rej = d.where(F.col("outcome") != "SELECTED").withColumn("rn", F.row_number().over(Window.partitionBy("edition_date").orderBy("ord"))).where(
        F.col("rn") <= MIN_SIZE
    )
    refill = rej.join(n, "edition_date").where(F.col("rn") <= F.lit(MIN_SIZE) - F.col("n")).select("edition_date", "id", F.lit("REFILLED").alias("fill"))
    return d.join(refill, ["edition_date", "id"], "left").select("edition_date", "id", F.coalesce("fill", "outcome").alias("outcome"), "ord")


def rescored(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Final score of the chosen with their own source and country counts, and the lead. Bounded per edition."""
    sel = chosen.where(F.col("outcome").isin("SELECTED", "REFILLED")).select("edition_date", "id")
    r = rows.drop("s").join(sel, ["edition_date", "id"])
    src = F.count(F.lit(1)).over(Window.partitionBy("edition_date", F.coalesce("source_id", F.lit(0))))
    geo = F.count(F.lit(1)).over(Window.partitionBy("edition_date", F.coalesce("country", F.lit("GLOBAL"))))
    r = r.withColumn("n_source", src).withColumn("n_country", F.when(F.col("country").isNotNull(), geo).otherwise(F.lit(0)))
    r = r.withColumn("s", _score(F.col("n_source"), F.col("n_country")))
    ed = Window.partitionBy("edition_date")
    r = r.withColumn("rank", F.row_number().over(ed.orderBy(F.desc("s.score"), "id")))
    strong = F.min(F.when(F.col("s.raw_importance") >= 50, F.col("rank"))).over(ed)
    return r.withColumn("is_lead", F.col("rank") == F.coalesce(strong, F.lit(1)))


def with_sections(rows: DataFrame) -> DataFrame:
    """Sections with running slots, in final order: top scores first fill Top Intelligence, then
    important rows fill Strategic Briefs, the rest follow their category."""
    mapped = scoring.edition_section(F.when(F.col("annotated_category").isNotNull(), F.col("annotated_category")).otherwise(F.lit("world")))
    before = Window.partitionBy("edition_date").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(before), F.lit(0))
    x = rows.withColumn("mapped", mapped)
    high = (F.col("s.score") >= 75.0) & ~F.col("is_lead")
    x = x.withColumn("top", F.col("is_lead") | (high & (1 + prior(high) < 3)))
    wants = ~F.col("top") & ((F.col("s.raw_importance") >= 70) | (F.col("mapped") == "Strategic Briefs"))
    x = x.withColumn("brief", ~F.col("top") & (F.col("s.raw_importance") >= 70) & (prior(wants) < 4))
    sec = F.when(F.col("top"), F.lit("Top Intelligence")).when(F.col("brief"), F.lit("Strategic Briefs")).otherwise(F.col("mapped"))
    # the lead takes position one, the others keep their order
    place = F.row_number().over(Window.partitionBy("edition_date").orderBy(F.desc("is_lead"), "rank"))
    reason = F.concat(scoring.selection_reason(F.col("s")), F.when(F.col("is_lead"), F.lit(" (Lead Story)")).otherwise(F.lit("")))
    return x.withColumn("section", sec).withColumn("position", place).withColumn("selection_reason", reason)


def build(articles: DataFrame, sources: DataFrame, annotations: DataFrame, bridge: DataFrame, as_of: Column) -> DataFrame:
    """All editions end to end."""
    rows = cut_lineage(scored(with_reason(pool(articles, as_of), annotations, sources), bridge))
    unique = suppress_duplicates(rows)
    return with_sections(rescored(unique, select_articles(unique)))
