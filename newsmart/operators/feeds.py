"""Article feeds: recency, diversity, sections, pages and summaries.

Feeds start from a sorted ``limit``, which Spark runs as a per-partition top-k, so
everything after it works on a bounded set whatever the archive's size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions import dates
from newsmart.functions.scoring import feed_sections
from newsmart.operators.annotations import out_of_scope, pick_annotation
from newsmart.operators.joins import with_source
from newsmart.operators.windows import global_rank

EFFECTIVE = F.coalesce


def effective() -> Column:
    return F.coalesce("published_at", "collected_at")


def newest_first() -> list[Column]:
    return [effective().desc(), F.col("id").desc()]


def in_category(articles: DataFrame, sources: DataFrame, category: str | None) -> DataFrame:
    """Case-insensitive source category; ``all`` or nothing keeps everything."""
    if not category or category.lower() == "all":
        return articles
    chosen = sources.where(F.lower("category") == category.lower())
    return with_source(articles, chosen, ["category"], "inner").drop("source_category")


def candidates(articles: DataFrame, as_of: Column, n: int) -> DataFrame:
    """The n newest articles that are not in the future, numbered in feed order."""
    top = articles.where(dates.not_future(F.col("published_at"), as_of)).orderBy(*newest_first()).limit(n)
    return top.withColumn("ord", F.row_number().over(Window.orderBy(*newest_first())))


def annotations_of(annotations: DataFrame, few: DataFrame) -> DataFrame:
    """Annotations of a bounded set of articles; the bound is the feed's own limit."""
    ids = F.broadcast(few.select(F.col("id").alias("article_id")))
    return annotations.join(ids, "article_id", "left_semi")


def drop_out_of_scope(few: DataFrame, annotations: DataFrame) -> DataFrame:
    bad = out_of_scope(annotations_of(annotations, few)).withColumnRenamed("article_id", "id")
    return few.join(bad, "id", "left_anti")


def diversity_cap(feed: DataFrame, per_source: int, n: int, partition: list[str] | None = None) -> DataFrame:
    """First ``per_source`` rows of each source in order, then the overflow in order, up to n."""
    part = partition or []
    within = Window.partitionBy(*part, F.coalesce("source_id", F.lit(0))).orderBy("ord")
    rn = F.row_number().over(within)
    ranked = feed.withColumn("overflow", rn > per_source)
    place = Window.partitionBy(*part).orderBy("overflow", "ord") if part else Window.orderBy("overflow", "ord")
    return ranked.withColumn("position", F.row_number().over(place)).where(F.col("position") <= n)


def recent_feed(
    articles: DataFrame, annotations: DataFrame, sources: DataFrame, as_of: Column, mode: str = "balanced",
    limit: int = 50, category: str | None = None,
) -> DataFrame:
    """Newest articles as ``chronological``, ``ai_curated`` or ``balanced``."""
    cand = candidates(in_category(articles, sources, category), as_of, limit * 4)
    if mode == "chronological":
        return cand.where(F.col("ord") <= limit).withColumn("position", F.col("ord"))
    kept = drop_out_of_scope(cand, annotations)
    if mode == "ai_curated":
        good = annotations_of(annotations, cand).where((F.col("status") == "success") & F.col("is_relevant"))
        kept = kept.join(good.select(F.col("article_id").alias("id")).distinct(), "id", "left_semi")
    return diversity_cap(kept, 2, limit)


def top_story(articles: DataFrame, annotations: DataFrame, as_of: Column) -> DataFrame:
    """Newest in-scope article of the twenty newest; the newest when none is in scope."""
    cand = candidates(articles, as_of, 20)
    bad = out_of_scope(annotations_of(annotations, cand)).select(F.col("article_id").alias("id"), F.lit(True).alias("oos"))
    return cand.join(bad, "id", "left").orderBy(F.coalesce("oos", F.lit(False)), "ord").limit(1).drop("oos", "ord")


def section_feed(
    articles: DataFrame, annotations: DataFrame, sources: DataFrame, as_of: Column, limit: int = 120,
    slots: int = 6, spill: int = 8,
) -> DataFrame:
    """Front page: the first article leads; each next one takes its first section with room."""
    feed = recent_feed(articles, annotations, sources, as_of, "balanced", limit)
    latest = pick_annotation(annotations_of(annotations, feed)).select(
        F.col("article_id").alias("id"), F.when(F.col("is_relevant"), F.col("primary_category")).alias("annotated")
    )
    rows = with_source(feed, sources, ["category"]).join(latest, "id", "left")
    cat = F.coalesce("annotated", "source_category")
    item = F.struct("position", "id", "source_id", feed_sections(cat).alias("sections"))
    listed = rows.where(F.col("position") > 1).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def room(acc, name, n):
        return F.size(F.filter(acc, lambda a: a == name)) < n

    def place(acc, x):
        fits = F.filter(x["sections"], lambda s: room(acc, s, slots))
        spare = F.when(room(acc, F.lit("Latest Updates"), spill), F.lit("Latest Updates")).otherwise(F.lit(""))
        return F.concat(acc, F.array(F.when(F.size(fits) > 0, F.get(fits, 0)).otherwise(spare)))

    taken = F.aggregate("items", F.array().cast("array<string>"), place)
    placed = (
        listed.select(F.explode(F.arrays_zip(F.col("items"), taken.alias("section"))).alias("z"))
        .select("z.items.*", F.col("z.section").alias("section")).where(F.col("section") != "")
        .select("id", "source_id", "section", F.col("position").alias("ord"))
    )
    spread = diversity_cap(placed, 2, slots, ["section"]).select("section", "position", "id")
    lead = rows.where(F.col("position") == 1).select(F.lit("Top Story").alias("section"), "position", "id")
    return lead.unionByName(spread)


def paginate(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page with totals. Rows are ranked over range partitions, so the last page of a long history is as cheap as the
    first; a page past the end is clamped."""
    ranked = global_rank(rows, order)
    total = ranked.count()
    pages = max(1, math.ceil(total / size))
    page = min(max(1, page), pages)
    out = ranked.where(F.col("rank").between((page - 1) * size + 1, page * size)).drop("rank")
    return out.select(
        "*", F.lit(page).alias("page"), F.lit(total).cast("bigint").alias("total"), F.lit(pages).alias("total_pages"),
        F.lit(page > 1).alias("has_prev"), F.lit(page < pages).alias("has_next"),
    )


def categories_in_order(sources: DataFrame, preferred=("AI", "Markets", "Geopolitics")) -> DataFrame:
    """Distinct categories of active sources, the preferred ones first."""
    rank = F.coalesce(*[F.when(F.col("category") == c, F.lit(i)) for i, c in enumerate(preferred)], F.lit(len(preferred)))
    names = sources.where(F.col("active") & F.col("category").isNotNull()).select("category").distinct()
    return names.withColumn("position", F.row_number().over(Window.orderBy(rank, "category")))


def category_summary(articles: DataFrame, annotations: DataFrame, sources: DataFrame, as_of: Column, k: int = 3) -> DataFrame:
    """Count and the k-item balanced sample of every category, all categories at once."""
    a = with_source(articles.where(dates.not_future(F.col("published_at"), as_of)), sources, ["category"], "inner").where(
        F.col("source_category").isNotNull()
    )
    counts = a.groupBy("source_category").agg(F.count(F.lit(1)).alias("articles"))
    newest = Window.partitionBy("source_category").orderBy(*newest_first())
    # the rank filter is pushed below the shuffle, so each map task sends at most 4k rows per category
    cand = a.withColumn("ord", F.row_number().over(newest)).where(F.col("ord") <= k * 4)
    kept = cand.join(out_of_scope(annotations).withColumnRenamed("article_id", "id"), "id", "left_anti")
    sample = diversity_cap(kept, 2, k, ["source_category"]).groupBy("source_category").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"].cast("string")), ",").alias("sample_ids")
    )
    return categories_in_order(sources).join(counts, F.col("category") == F.col("source_category"), "left").drop("source_category").join(
        sample, F.col("category") == F.col("source_category"), "left"
    ).select("position", "category", F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("sample_ids", F.lit("")).alias("sample_ids"))


def source_summary(articles: DataFrame, sources: DataFrame, family: str | None = None, category: str | None = None) -> DataFrame:
    """Every matching source with its article count, zero when it has none."""
    s = sources
    if family and family.lower() != "all":
        s = s.where(F.lower("source_family") == family.lower())
    if category and category.lower() != "all":
        s = s.where(F.lower("category") == category.lower())
    counts = articles.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return s.join(counts, s["id"] == counts["source_id"], "left").select(*[s[c] for c in sources.columns], F.coalesce("n", F.lit(0)).alias("article_count"))
