"""Annotation job states with timeouts, as a stream of status events.

The newest status of every article is an aggregate that Spark keeps in its state store, without a watermark: an event that
arrives late is folded like any other and only counts if it is the newest. Each micro-batch writes the articles it changed.
Timeouts need no timers: a status holds until its deadline, and the clock is the newest event seen, so the states
at any clock follow from the last status of each article.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.sources.versions import exists

LAST = "article_id long, status string, at timestamp, epoch long"
STALE_S, COOLDOWN_S = 900, 300


def newest(events: DataFrame) -> DataFrame:
    """events (article_id, status, processed_at, seq) -> article_id, status, at of the newest; on a stream or a table."""
    last = F.max(F.struct(F.col("processed_at").alias("at"), "seq", "status")).alias("last")
    return events.groupBy("article_id").agg(last).select("article_id", "last.status", "last.at")


def states_at(last: DataFrame, clock: Column, stale_s: int = STALE_S, cooldown_s: int = COOLDOWN_S) -> DataFrame:
    """(article_id, state, at): a processing job past its deadline is stale, a failed one past its cooldown retryable."""
    status = F.col("status")
    failed = status.isin(lx.RETRYABLE_STATUSES)
    wait = F.when(status == "processing", F.lit(stale_s)).when(failed, F.lit(cooldown_s))
    due = F.col("at") + F.make_dt_interval(secs=wait)
    over = due <= clock
    state = (
        F.when(status == "processing", F.when(over, F.lit("STALE")).otherwise(F.lit("PROCESSING")))
        .when(failed & over, F.lit("RETRYABLE")).when(status.isin(lx.FINAL_STATUSES), F.lit("COMPLETED"))
        .when(status == "invalid_json", F.lit("NON_RETRYABLE")).otherwise(F.lit("COOLDOWN"))
    )
    return last.select("article_id", state.alias("state"), F.when(over, due).otherwise(F.col("at")).alias("at"))


def run_available(events: DataFrame, folder: str) -> DataFrame:
    """Drain the events and return each article's state at the newest event."""

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changed/epoch={epoch}")

    q = (
        newest(events).writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return states(events.sparkSession, folder)


def states(spark: SparkSession, folder: str, clock: Column | None = None) -> DataFrame:
    """Each article's state at ``clock``, by default the newest event."""
    path = f"{folder}/changed"
    changed = spark.read.schema(LAST).parquet(path) if exists(spark, path) else spark.createDataFrame([], LAST)
    last = changed.groupBy("article_id").agg(F.max_by(F.struct("status", "at"), "epoch").alias("l")).select("article_id", "l.*")
    if clock is None:
        last, clock = last.crossJoin(F.broadcast(changed.agg(F.max("at").alias("clock")))), F.col("clock")  # one row
    return states_at(last, clock)
