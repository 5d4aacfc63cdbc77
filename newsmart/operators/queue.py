"""Annotation queue: states, status counts, batches and freshness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions import dates
from newsmart.functions.numbers import round_half_up
from newsmart.functions.scoring import job_state
from newsmart.operators.archive import one_row

BLOCKING = ["COMPLETED", "NON_RETRYABLE", "PROCESSING", "COOLDOWN"]


def states(annotations: DataFrame, as_of: Column) -> DataFrame:
    return annotations.withColumn("state", job_state(F.col("status"), F.coalesce("processed_at", "created_at"), as_of))


def eligible(articles: DataFrame, annotations: DataFrame, as_of: Column) -> DataFrame:
    """Articles without a blocking annotation of the configured kind."""
    blocked = states(annotations, as_of).where(F.col("state").isin(BLOCKING)).select(F.col("article_id").alias("id"))
    return articles.join(blocked.distinct(), "id", "left_anti")


def fifo(articles: DataFrame, annotations: DataFrame, limit: int) -> DataFrame:
    """Oldest collected first among articles with no annotation at all."""
    done = annotations.select(F.col("article_id").alias("id")).distinct()
    return articles.join(done, "id", "left_anti").orderBy(F.col("collected_at").asc_nulls_last(), "id").limit(limit)


def status(articles: DataFrame, annotations: DataFrame, as_of: Column) -> DataFrame:
    """One row of queue counts; articles are matched to annotations once."""
    a = states(annotations, as_of)
    st, n = F.col("state"), lambda c: F.count_if(c)
    relevant_not = F.col("is_relevant").eqNullSafe(False)
    outs = a.agg(
        n(st == "PROCESSING").alias("processing"), n(st == "STALE").alias("stale_processing"),
        n((F.col("status") == "success") & ~relevant_not).alias("completed_relevant"),
        n((F.col("status") == "out_of_scope") | ((F.col("status") == "success") & relevant_not)).alias("completed_out_of_scope"),
        n(F.col("status").isin(lx.FAILED_STATUSES)).alias("failed"), n(st == "NON_RETRYABLE").alias("non_retryable"),
        n(st.isin("STALE", "RETRYABLE")).alias("retryable"),
        F.max(F.when(F.col("status") != "processing", F.col("processed_at"))).alias("newest_processed"),
    )
    ids = annotations.select(F.col("article_id").alias("id"), F.lit(True).alias("seen")).distinct()
    open_ = F.col("seen").isNull()
    arts = articles.select("id", "collected_at", "published_at").join(ids, "id", "left").agg(
        F.count(F.lit(1)).alias("total_articles"), n(open_).alias("unprocessed"),
        F.min(F.when(open_, F.coalesce("collected_at", "published_at"))).alias("oldest_unprocessed"),
    )
    done = F.col("completed_relevant") + F.col("completed_out_of_scope")
    return one_row(arts, outs).select(
        "*", done.alias("completed_total"), (F.col("unprocessed") + F.col("retryable")).alias("eligible"),
        round_half_up(F.greatest(F.lit(0.0), dates.hours_between(as_of, F.col("oldest_unprocessed"))), 2).alias("queue_age_hours"),
        round_half_up(done / F.col("total_articles") * F.lit(100.0), 2).alias("coverage_pct"),
    )


def tier_counts(prioritised: DataFrame, annotations: DataFrame) -> DataFrame:
    """Exact tier breakdown of the unprocessed articles."""
    done = annotations.select(F.col("article_id").alias("id")).distinct()
    return prioritised.join(done, "id", "left_anti").groupBy(F.col("r.priority_tier").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def batch(prioritised: DataFrame, annotations: DataFrame, as_of: Column, size: int, fresh_hours: int = 2) -> DataFrame:
    """Dual-lane pick: 70 % fresh by base score, 30 % backlog by effective score, shortages shared.

    Each lane is cut to the batch size by a partial top-k first, so lane sizes above it do not matter.
    """
    at = F.coalesce("collected_at", "published_at")
    rows = eligible(prioritised, annotations, as_of).select(
        "id", at.alias("at"), (at >= as_of - F.expr(f"INTERVAL {fresh_hours} HOURS")).alias("fresh"),
        F.col("r.base_score").alias("base"), F.col("r.effective_score").alias("eff"),
    )
    score = F.when(F.col("fresh"), F.col("base").cast("double")).otherwise(F.col("eff"))
    lane = Window.partitionBy("fresh").orderBy(score.desc(), "at", "id")
    top = rows.withColumn("rn", F.row_number().over(lane)).where(F.col("rn") <= size)
    want_fresh = math.ceil(size * 0.7)
    have = Window.partitionBy()
    f = F.sum(F.col("fresh").cast("int")).over(have)
    b = F.sum((~F.col("fresh")).cast("int")).over(have)
    fresh0 = F.least(F.lit(want_fresh), f)
    back = F.least(F.lit(size) - fresh0, b)
    fresh = F.least(F.lit(size) - back, f)
    quota = F.when(F.col("fresh"), fresh).otherwise(back)
    picked = top.withColumn("quota", quota).where(F.col("rn") <= F.col("quota"))
    return picked.withColumn("position", F.row_number().over(Window.orderBy(F.desc("fresh"), "rn"))).select(
        "position", "id", F.when(F.col("fresh"), F.lit("fresh")).otherwise(F.lit("backlog")).alias("lane")
    )


def freshness(articles: DataFrame, annotations: DataFrame, as_of: Column) -> DataFrame:
    """Minutes since the last item and annotation, lane sizes and the status ladder."""
    done = annotations.where(F.col("status").isin(["success", "out_of_scope", "invalid_json"])).select(
        F.col("article_id").alias("id"), F.lit(True).alias("done")
    ).distinct()
    at = F.coalesce("collected_at", "published_at")
    waiting, new = F.col("done").isNull(), at >= as_of - F.expr("INTERVAL 2 HOURS")
    minutes = lambda c: round_half_up((F.unix_micros(as_of) - F.unix_micros(c)) / F.lit(60000000.0), 1)
    a = articles.select("id", "collected_at", "published_at").join(done, "id", "left").agg(
        F.max("collected_at").alias("latest_item"), F.count_if(waiting & new).alias("fresh_queue"),
        F.count_if(waiting & ~new).alias("backlog_queue"), F.min(F.when(waiting & new, at)).alias("oldest_fresh"),
    )
    p = annotations.where(F.col("status").isin(lx.FINAL_STATUSES)).agg(F.max("processed_at").alias("latest_done"))
    x = one_row(a, p)
    ingest, work = minutes(F.col("latest_item")), minutes(F.col("latest_done"))
    ok_i, ok_w = F.coalesce(ingest <= 45, F.lit(False)), F.coalesce(work <= 30, F.lit(False))
    word = lambda c: F.when(c, F.lit("HEALTHY")).otherwise(F.lit("STALE"))
    return x.select(
        ingest.alias("minutes_since_item"), work.alias("minutes_since_annotation"), "fresh_queue", "backlog_queue",
        F.greatest(F.lit(0.0), minutes(F.col("oldest_fresh"))).alias("oldest_fresh_minutes"),
        word(ok_i).alias("ingest_status"), word(ok_w).alias("annotation_status"),
        F.when(ok_i & ok_w, F.lit("FRESH")).otherwise(F.lit("STALE")).alias("overall"),
    )
