"""Event clusters: components of linked articles with a primary article and a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions import dates, scoring
from newsmart.functions.numbers import hash_sum, round_half_up
from newsmart.operators import pairs
from newsmart.operators.annotations import pick_annotation
from newsmart.operators.joins import with_source
from newsmart.session import cut_lineage


def assign(feats: DataFrame, threshold: float = 0.70) -> DataFrame:
    """(id, label) for every feature row; label is the smallest member id."""
    rows, n, sets = pairs.nodes(feats)
    n = cut_lineage(n)
    comp = pairs.node_components(rows, n, sets, threshold)
    named = n.select("sig", "slot", "node").join(comp, "node", "left").select("sig", "slot", F.coalesce("label", "node").alias("label"))
    # one row per node on the right; a slot full of copies is split by adaptive skew handling
    return rows.select("id", "sig", "slot").join(named, ["sig", "slot"]).select("id", "label")


def assign_articles(articles: DataFrame, sources: DataFrame, annotations: DataFrame | None, threshold: float = 0.70) -> DataFrame:
    return assign(pairs.features(articles, sources, annotations), threshold)


def fingerprint(members: DataFrame, by: list[str]) -> DataFrame:
    """Cluster id from count, smallest id and an order-free hash sum of the member ids: one rule at every size."""
    g = members.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), hash_sum(F.col("id")).alias("mix"))
    text = F.concat_ws("-", F.col("n").cast("string"), F.col("first_id").cast("string"), F.col("mix").cast("string"))
    return g.select(
        *by, F.concat(F.lit("evt_"), F.col("first_id").cast("string"), F.lit("_"), F.substring(F.sha2(text, 256), 1, 16)).alias("cluster_id")
    )


def scored_members(articles: DataFrame, labels: DataFrame, sources: DataFrame, annotations: DataFrame, as_of: Column, keys: list[str] | None = None) -> DataFrame:
    """Members with their editorial score under the cluster's corroboration."""
    keys = keys or ["label"]
    a = with_source(
        articles.select("id", "source_id", "title", "published_at", "collected_at", "primary_category"), sources,
        ["name", "source_type", "trust_tier", "category"],
    )
    n = pick_annotation(annotations, "first_relevant").select(
        F.col("article_id").alias("id"), "importance_score", F.col("primary_category").alias("annotated")
    )
    m = labels.join(a, "id").join(n, "id", "left")
    per = m.groupBy(*keys).agg(F.greatest(F.lit(1), F.count_distinct("source_id")).alias("n_sources"))
    m = m.join(per, keys)
    hours = dates.hours_between(as_of, F.coalesce("published_at", "collected_at"))
    s = scoring.editorial_score(
        F.col("importance_score"), F.col("source_source_type"), F.col("source_trust_tier"), hours,
        F.coalesce("primary_category", "source_category"), F.col("n_sources"),
    )
    return m.withColumn("editorial", s["total"])


def primary_rank() -> Column:
    """Score, official source, newest publication, smallest id."""
    return F.struct(
        F.col("editorial"), F.coalesce(F.col("source_source_type").isin(lx.OFFICIAL_SOURCE_TYPES), F.lit(False)).cast("int").alias("official"),
        F.coalesce(F.unix_micros("published_at"), F.lit(0)).alias("pub"), (-F.col("id")).alias("low"),
    )


def summarise(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One record per cluster. Every value is a combining aggregate; members are never listed."""
    keys = keys or ["label"]
    at = F.coalesce("published_at", "collected_at")
    prim = F.struct(
        "id", "title", "source_id", "source_name", "source_source_type", "editorial", "importance_score", "annotated", "primary_category",
        "source_category", "published_at", "collected_at",
    )
    g = scored.groupBy(*keys).agg(
        F.max_by(prim, primary_rank()).alias("p"), F.count(F.lit(1)).alias("article_count"), F.max("n_sources").cast("int").alias("distinct_source_count"),
        F.min(at).alias("earliest_at"), F.max(at).alias("latest_at"),
    )
    category = scoring.resolve_category(F.col("p.annotated"), F.col("p.primary_category"), F.col("p.title"), F.col("p.source_category"))
    score = round_half_up(F.least(F.lit(100.0), F.col("p.editorial") + scoring.corroboration_bonus(F.col("distinct_source_count"))), 1)
    return g.select(
        *keys, F.col("p.id").alias("primary_id"), F.col("p.title").alias("canonical_title"), F.col("p.source_id").alias("primary_source_id"),
        F.col("p.source_name").alias("primary_source"), F.col("p.source_source_type").alias("primary_source_type"),
        F.col("p.importance_score").alias("primary_importance"), F.col("p.editorial").alias("primary_score"),
        F.col("p.published_at").alias("primary_published_at"), F.col("p.collected_at").alias("primary_collected_at"),
        category.alias("category"), "distinct_source_count", "article_count", score.alias("cluster_score"), "earliest_at", "latest_at",
    )


def build(articles: DataFrame, sources: DataFrame, annotations: DataFrame, as_of: Column, threshold: float = 0.70) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) with their final ids."""
    labels = cut_lineage(assign_articles(articles, sources, annotations, threshold))
    scored = scored_members(articles, labels, sources, annotations, as_of)
    ids = fingerprint(labels, ["label"])
    clusters = summarise(scored).join(ids, "label")
    members = labels.join(ids, "label").join(clusters.select("label", "primary_id"), "label").select(
        "cluster_id", F.col("id").alias("article_id"), (F.col("id") == F.col("primary_id")).alias("is_primary"),
        F.when(F.col("id") == F.col("primary_id"), F.lit("PRIMARY")).otherwise(F.lit("SUPPORTING")).alias("relationship"),
        F.when(F.col("id") == F.col("primary_id"), F.lit(1.0)).otherwise(F.lit(0.85)).alias("similarity"),
    )
    return clusters, members


def confusion(labelled: DataFrame) -> DataFrame:
    """expected ``e`` and predicted ``p`` flags -> counts, precision, recall, F1 and the no-false-merge gate."""
    e, p = F.col("e"), F.col("p")
    c = labelled.agg(
        F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(~e & ~p).alias("tn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    r = lambda x: round_half_up(x, 6)
    return c.select(
        "*", r(tp / (tp + fp)).alias("precision"), r(tp / (tp + fn)).alias("recall"), r(F.lit(2.0) * tp / (tp * 2 + fp + fn)).alias("f1"),
        (fp == 0).alias("gate"),
    )


def compression(sizes: DataFrame) -> DataFrame:
    """Cluster sizes ``n`` -> before/after counts, singletons, largest."""
    n = F.col("n")
    return sizes.agg(
        F.sum(n).alias("articles"), F.count(F.lit(1)).alias("clusters"), F.count_if(n == 1).alias("singletons"), F.count_if(n > 1).alias("multis"),
        F.max(n).alias("largest"), round_half_up((F.lit(1.0) - F.count(F.lit(1)) / F.sum(n)) * F.lit(100.0), 2).alias("compression_pct"),
    )
