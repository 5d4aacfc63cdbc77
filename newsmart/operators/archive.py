"""Archive-wide counts, quality checks and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions import dates
from newsmart.functions.entities import country_info
from newsmart.functions.text import clean_topic, str_array, strip
from newsmart.operators.annotations import pick_annotation
from newsmart.operators.joins import with_source


def one_row(*parts: DataFrame) -> DataFrame:
    """Side-by-side single-row aggregates, read as scalar subqueries."""
    first, *rest = parts
    extra = [p.select(c).scalar().alias(c) for p in rest for c in p.columns]
    return first.select("*", *extra)


def published_on(articles: DataFrame, day: Column, as_of: Column) -> DataFrame:
    p = F.col("published_at")
    return articles.where(dates.in_local_day(p, day) & (p <= as_of))


def counters(articles: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    p = F.col("published_at")
    today = dates.in_local_day(p, dates.local_date(as_of)) & (p <= as_of)
    a = articles.agg(F.count(F.lit(1)).alias("total_archive"), F.count_if(today).alias("today_articles"))
    return one_row(a, sources.agg(F.count_if("active").alias("active_sources")))


def country_pairs(articles: DataFrame, bridge: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct (article, country): the bridge and the source's own country."""
    direct = articles.select("id").join(bridge.withColumnRenamed("article_id", "id"), "id").select("id", "country_code")
    own = with_source(articles.select("id", "source_id"), sources, ["country_code"], "inner").where(
        F.col("source_country_code").isNotNull()
    ).select("id", F.col("source_country_code").alias("country_code"))
    return direct.unionByName(own).distinct()


def annotation_state(latest: DataFrame) -> Column:
    return (
        F.when(F.col("status").isNull(), F.lit("awaiting"))
        .when((F.col("status") == "success") & F.col("is_relevant").eqNullSafe(False), F.lit("out_of_scope"))
        .when(F.col("status") == "success", F.lit("relevant"))
        .when(F.col("status") == "out_of_scope", F.lit("out_of_scope"))
        .when(F.col("status").isin(lx.FAILED_STATUSES), F.lit("failed"))
        .otherwise(F.lit("awaiting"))
    )


def todays_population(articles: DataFrame, annotations: DataFrame, as_of: Column) -> DataFrame:
    """Articles collected or published today with the state of their latest annotation."""
    day = dates.local_date(as_of)
    rows = articles.where(dates.in_local_day(F.col("collected_at"), day) | dates.in_local_day(F.col("published_at"), day))
    latest = pick_annotation(annotations).withColumnRenamed("article_id", "id")
    return rows.select("id", "published_at", "collected_at").join(latest, "id", "left").withColumn("state", annotation_state(latest))


def context_stats(articles: DataFrame, annotations: DataFrame, as_of: Column) -> DataFrame:
    day, n = dates.local_date(as_of), lambda s: F.count_if(F.col("state") == s)
    agg = todays_population(articles, annotations, as_of).agg(
        F.count_if(dates.in_local_day(F.col("collected_at"), day)).alias("collected_today"),
        F.count_if(dates.in_local_day(F.col("published_at"), day)).alias("published_today"),
        n("relevant").alias("relevant"), n("out_of_scope").alias("out_of_scope"), n("failed").alias("failed"),
        n("awaiting").alias("awaiting"),
    )
    done = F.col("relevant") + F.col("out_of_scope")
    total = done + F.col("failed") + F.col("awaiting")
    return agg.select(
        "*", F.when(total > 0, F.floor(done / total * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0)).otherwise(F.lit(0.0)).alias("coverage_pct")
    )


def _top(counts: DataFrame, kind: str, k: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), "name").limit(k).select(F.lit(kind).alias("kind"), "name", "n")


def focus(articles: DataFrame, annotations: DataFrame, as_of: Column) -> DataFrame:
    """Top six topics, five countries and two lenses among today's relevant annotations."""
    rel = todays_population(articles, annotations, as_of).where((F.col("state") == "relevant") & F.col("topics").isNotNull())
    topics = rel.select(F.explode("topics").alias("t")).where(strip(F.col("t")) != "")
    topics = topics.groupBy(clean_topic(F.col("t")).alias("name")).agg(F.count(F.lit(1)).alias("n")).where(F.col("name") != "")
    raw = rel.select(F.explode("countries").alias("c")).where(strip(F.col("c")) != "").groupBy(strip(F.col("c")).alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    )
    lenses = F.array(*[F.struct(F.lit(v[0]).alias("name"), str_array(v[1]).alias("codes")) for v in lx.LENSES.values()])
    code = country_info(F.col("name"))["code"]
    groups = raw.select(F.explode(F.filter(lenses, lambda g: F.array_contains(g["codes"], code))).alias("g"), "n").groupBy(
        F.col("g.name").alias("name")
    ).agg(F.sum("n").alias("n"))
    return _top(topics, "topic", 6).unionByName(_top(raw, "country", 5)).unionByName(_top(groups, "group", 2))


def lens_articles(
    articles: DataFrame, bridge: DataFrame, sources: DataFrame, as_of: Column, lens: str | None = None,
    country: str | None = None, category: str | None = None,
) -> DataFrame:
    """Today's articles seen through a country group, a country or a source category."""
    rows = published_on(articles, dates.local_date(as_of), as_of)
    if category:
        chosen = sources.where(F.lower("category") == category.lower())
        rows = with_source(rows, chosen, ["category"], "inner").drop("source_category")
    for codes in ([lx.LENSES[lens][1]] if lens and lens != "world" else []) + ([[country.upper()]] if country else []):
        hit = country_pairs(rows, bridge, sources).where(F.col("country_code").isin(codes)).select("id").distinct()
        rows = rows.join(hit, "id", "left_semi")
    return rows


def missing_fields(articles: DataFrame, as_of: Column) -> DataFrame:
    blank = lambda c: F.count_if(F.col(c).isNull() | (F.col(c) == ""))
    return articles.agg(
        F.count(F.lit(1)).alias("articles"), blank("title").alias("missing_title"), blank("canonical_url").alias("missing_url"),
        F.count_if(F.col("published_at").isNull()).alias("missing_date"), blank("raw_summary").alias("missing_summary"),
        F.count_if(F.col("published_at") > as_of).alias("future_dated"),
    )


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def searchability(articles: DataFrame, annotations: DataFrame, sources: DataFrame) -> DataFrame:
    """What search can use for each article, and whether it is complete."""
    latest = pick_annotation(annotations).select(
        F.col("article_id").alias("id"), F.col("status"), F.col("is_relevant"), F.col("summary"), F.col("topics"), F.col("entities")
    )
    a = with_source(articles.select("id", "source_id", "title", "raw_summary", "primary_category"), sources, ["name"])
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    rows = a.join(latest, "id", "left").select(
        "id", has("title").alias("has_title"), has("raw_summary").alias("has_summary"), has("summary").alias("has_annotation_summary"),
        (F.coalesce(F.size("topics"), F.lit(0)) > 0).alias("has_topics"), (F.coalesce(F.size("entities"), F.lit(0)) > 0).alias("has_entities"),
        F.col("source_name").isNotNull().alias("has_source"), F.col("is_relevant").eqNullSafe(True).alias("relevant"),
    )
    full = F.col("has_title") & F.col("has_summary") & F.col("has_annotation_summary") & F.col("has_topics") & F.col("has_entities")
    return rows.withColumn("searchable", F.col("relevant") & (F.col("has_title") | F.col("has_summary"))).withColumn("complete", full)


def fixture_rows(articles: DataFrame, name_patterns: list[str], url_patterns: list[str]) -> DataFrame:
    """Rows that look like test fixtures, with the first pattern class that matched."""
    any_of = lambda c, ps: F.lit(False) if not ps else _or([F.col(c).ilike(p) for p in ps])
    return articles.withColumn(
        "reason", F.when(any_of("title", name_patterns), F.lit("TITLE")).when(any_of("canonical_url", url_patterns), F.lit("URL"))
    ).where(F.col("reason").isNotNull())


def _or(cols):
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out
