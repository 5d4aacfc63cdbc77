"""Retrieval evaluation: gold, per-question metrics, aggregates, traces and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmart.functions import dates
from newsmart.functions.numbers import round_half_up
from newsmart.functions.text import words
from newsmart.operators.joins import broadcast_if_small
from newsmart.operators.pairs import once


def gold_by_passage(questions: DataFrame, documents: DataFrame, inner: int = 4) -> DataFrame:
    """(query_id, id): documents that contain the passage word for word.

    Passages and documents meet on a run of inner words (whole in any document that holds the
    passage), then the text decides. Documents send only runs some passage has.
    """
    w = words(F.col("passage"))
    key = questions.select("query_id", "passage", F.array_join(F.slice(w, 2, inner), " ").alias("run"))
    split = once(documents.select(F.col("doc_id").alias("id"), "text"), "w", words(F.col("text"))).select("id", "w")
    d = F.col("w")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(d) - inner + 1, F.lit(1))), lambda i: F.array_join(F.slice(d, i, inner), " "))
    places = split.select("id", F.explode(runs).alias("run"))
    met = places.join(broadcast_if_small(key.select("run").distinct()), "run").join(key.select("query_id", "run"), "run").select("query_id", "id").distinct()
    both = met.join(questions.select("query_id", "passage"), "query_id").join(documents.select(F.col("doc_id").alias("id"), "text"), "id")
    return both.where(F.col("text").contains(F.col("passage"))).select("query_id", "id")


def question_metrics(questions: DataFrame, gold: DataFrame, records: DataFrame, packs: DataFrame, today: Column) -> DataFrame:
    """Hit rate, coverage, diversity, date scope, citation validity and refusal per question.

    questions: query_id, category, scope. gold: query_id, id, core. All joins are on question and article. Citations are
    valid when every cited article was retrieved for its question; a result page bounds both lists.
    """
    r4 = lambda c: round_half_up(c, 4)
    hit = gold.join(records.select("query_id", "id", F.lit(1).alias("got")), ["query_id", "id"], "left")
    core, got = F.col("core"), F.coalesce("got", F.lit(0)) == 1
    g = hit.groupBy("query_id").agg(
        F.count_if(core).alias("n_core"), F.count_if(core & got).alias("core_hits"), F.count_if(~core).alias("n_optional"), F.count_if(~core & got).alias("optional_hits")
    )
    topic = questions.select("query_id", F.lower("category").alias("topic"), "scope")
    local = dates.local_date(F.col("at"))
    in_scope = (
        F.when(F.col("scope") == "today", local == today).when(F.col("scope") == "yesterday", local == F.date_sub(today, 1))
        .when(F.col("scope") == "this_week", (local >= F.date_sub(today, 6)) & (local <= today)).otherwise(F.lit(True))
    )
    e = records.join(topic, "query_id").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("evidence"), F.count_distinct("id").alias("ids"), F.count_distinct("source").alias("sources"), F.collect_set("id").alias("retrieved"),
        F.bool_or(F.lower("category").contains(F.col("topic"))).alias("on_topic"), F.bool_and(in_scope).alias("scoped"),
    )
    m = questions.join(g, "query_id", "left").join(e, "query_id", "left").join(packs.select("query_id", "insufficient_evidence", "citations"), "query_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    answerable = n("n_core") > 0
    ratio = lambda a, b: r4(F.col(a) / F.col(b))
    ok = F.col("evidence") > 0
    strangers = F.array_except(F.transform("citations", lambda c: c["id"]), F.coalesce("retrieved", F.expr("cast(array() as array<bigint>)")))
    return m.select(
        "query_id", "category", "scope", answerable.alias("answerable"), n("evidence").alias("evidence_count"),
        F.when(n("n_core") > 0, ratio("core_hits", "n_core")).otherwise(F.lit(1.0)).alias("core_hit_rate"),
        F.when(n("n_optional") > 0, ratio("optional_hits", "n_optional")).otherwise(F.lit(1.0)).alias("optional_coverage"),
        F.coalesce(F.col("on_topic").cast("double"), F.lit(0.0)).alias("topic_coverage"),
        F.when(ok, r4(F.lit(1.0) - F.col("ids") / F.col("evidence"))).otherwise(F.lit(0.0)).alias("duplicate_rate"),
        F.when(ok, ratio("sources", "evidence")).otherwise(F.lit(0.0)).alias("source_diversity"),
        F.coalesce("scoped", F.lit(True)).alias("temporal_pass"),
        (strangers.isNull() | (F.size(strangers) == 0)).alias("citation_valid"),
        (answerable | F.coalesce("insufficient_evidence", F.lit(True)) | (n("evidence") == 0)).alias("refusal_pass"),
    )


def run_aggregate(m: DataFrame, group: str | None = None) -> DataFrame:
    """Averages, pass rates and the weighted score, overall or per group."""
    a = F.col("answerable")
    pct = lambda c: round_half_up(F.count_if(c) / F.count(F.lit(1)) * F.lit(100.0), 1)
    g = m.groupBy(group) if group else m.groupBy()
    r = g.agg(
        F.count(F.lit(1)).alias("questions"), F.coalesce(round_half_up(F.avg(F.when(a, F.col("core_hit_rate"))), 4), F.lit(0.0)).alias("hit_rate"),
        pct("temporal_pass").alias("temporal_pct"), pct("citation_valid").alias("citation_pct"),
        F.when(F.count_if(~a) > 0, round_half_up(F.count_if(~a & F.col("refusal_pass")) / F.count_if(~a) * F.lit(100.0), 1)).otherwise(F.lit(100.0)).alias("refusal_pct"),
        round_half_up(F.avg("evidence_count"), 2).alias("avg_evidence"),
    )
    w = F.lit(0.25) * (F.col("hit_rate") * F.lit(100.0)) + F.lit(0.25) * F.col("temporal_pct") + F.lit(0.20) * F.col("citation_pct") + F.lit(0.20) * F.col("refusal_pct") + F.lit(10.0)
    return r.withColumn("overall", round_half_up(w, 2))


def item_scores(m: DataFrame) -> DataFrame:
    s = F.col("core_hit_rate") * F.lit(40.0) + F.when(F.col("citation_valid"), F.lit(30.0)).otherwise(F.lit(0.0)) + F.when(F.col("temporal_pass"), F.lit(30.0)).otherwise(F.lit(0.0))
    refused = F.when(F.col("refusal_pass"), F.lit(100.0)).otherwise(F.lit(0.0))
    return m.withColumn("item_score", round_half_up(F.when(F.col("answerable"), s).otherwise(refused), 2))


def extremes(scored: DataFrame, k: int = 5) -> DataFrame:
    """k strongest and k weakest questions, each by a partial top-k."""
    top = scored.orderBy(F.desc("item_score"), "query_id").limit(k).select(F.lit("strongest").alias("side"), "query_id", "item_score")
    low = scored.orderBy("item_score", F.desc("query_id")).limit(k).select(F.lit("weakest").alias("side"), "query_id", "item_score")
    return top.unionByName(low)


def ranked_positions(ranked: DataFrame, size: int = 10) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return ranked.withColumn("rank", F.row_number().over(w)).withColumn("shown", F.col("rank") <= size)


def gold_trace(gold: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Candidate and final rank of every gold pair under two variants, and what changed."""
    side = lambda df, p: df.select("query_id", "id", F.col("ord").alias(f"{p}_cand"), F.col("rank").alias(f"{p}_rank"), F.col("shown").alias(f"{p}_shown"))
    j = gold.join(side(before, "a"), ["query_id", "id"], "left").join(side(after, "b"), ["query_id", "id"], "left")
    a, b = F.coalesce("a_shown", F.lit(False)), F.coalesce("b_shown", F.lit(False))
    return j.select(
        "query_id", "id", "a_cand", "a_rank", "b_cand", "b_rank",
        F.when(~a & b, F.lit("RECOVERED")).when(a & ~b, F.lit("DEGRADED")).when(a, F.lit("KEPT")).otherwise(F.lit("MISSED")).alias("change"),
    )


def failure_class(gold: DataFrame, ranked: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """Why a gold article is not shown: absent, future, filtered or out of pool, or ranked too low."""
    a = articles.select("id", "published_at", F.lit(True).alias("present"))
    j = gold.join(a, "id", "left").join(ranked.select("query_id", "id", "rank", "shown"), ["query_id", "id"], "left")
    return j.select(
        "query_id", "id",
        F.when(F.col("present").isNull(), F.lit("NOT_IN_ARCHIVE")).when(F.col("published_at") > as_of, F.lit("FUTURE_DATED"))
        .when(F.col("rank").isNull(), F.lit("NOT_RETRIEVED")).when(~F.col("shown"), F.lit("RANKED_TOO_LOW")).otherwise(F.lit("HIT")).alias("cause"),
    )


def rule_efficiency(queries: DataFrame, before: DataFrame, after: DataFrame, gold: DataFrame) -> DataFrame:
    """Per expansion rule: questions that fired it, new candidates, recovered gold and false candidates."""
    new = after.select("query_id", "id").join(before.select("query_id", "id"), ["query_id", "id"], "left_anti")
    new = new.join(gold.select("query_id", "id", F.lit(True).alias("gold")), ["query_id", "id"], "left")
    per = new.groupBy("query_id").agg(F.count(F.lit(1)).alias("new"), F.count_if("gold").alias("recovered"))
    r = queries.select("query_id", F.explode("rules").alias("rule")).join(per, "query_id", "left")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return r.groupBy("rule").agg(
        F.count(F.lit(1)).alias("triggered"), z("new").alias("new_candidates"), z("recovered").alias("gold_recovered"), (z("new") - z("recovered")).alias("false_candidates")
    )


def gold_drift(gold: DataFrame, articles: DataFrame) -> DataFrame:
    """First reason a gold article cannot be trusted any more."""
    a = articles.select("id", "title", "canonical_url", F.lit(True).alias("present"))
    return gold.join(a, "id", "left").withColumn(
        "drift",
        F.when(F.col("present").isNull(), F.lit("missing_article")).when(F.length(F.coalesce("title", F.lit(""))) < 10, F.lit("short_title"))
        .when(~F.col("canonical_url").rlike("^https?://"), F.lit("bad_url")).otherwise(F.lit("ok")),
    )


def split_gold(gold: DataFrame, split: DataFrame) -> DataFrame:
    """Core/optional marks from a split table; unmarked gold is core."""
    return gold.join(split, ["query_id", "id"], "left").withColumn("core", F.coalesce("is_core", F.lit(True))).drop("is_core")
