"""Incremental ingest: the batch job's steps inside ``foreachBatch``, against an index of the archived URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmart.operators import ingest
from newsmart.sources.versions import exists
from newsmart.streaming.urlindex import UrlIndex

COLUMNS = ["item_id", "source_name", "title", "canonical_url", "title_fingerprint", "published_at", "collected_at"]
ARCHIVE = "item_id long, source_name string, title string, canonical_url string, title_fingerprint string, published_at timestamp, collected_at timestamp, epoch long"
COUNTERS = "source_name string, fetched long, new long, epoch long"


def archive_writer(folder: str, compact_every: int = 64):
    """Append the new items of each micro-batch to ``folder``/archive, and its counts per source to ``folder``/counters.

    Each epoch owns its partitions of archive, index and counters, and looks at those of earlier epochs only: a replay after
    a lost executor or driver puts the same rows in the same place, so nothing is written twice.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        index = UrlIndex(batch.sparkSession, f"{folder}/urls")
        normal = ingest.normalise(batch).persist()
        try:
            fresh = ingest.new_items(normal, index.known(normal, epoch)).select(*COLUMNS)
            at = f"{folder}/archive/epoch={epoch}"
            fresh.write.mode("overwrite").parquet(at)
            fresh = batch.sparkSession.read.schema(fresh.schema).parquet(at)
            index.add(fresh, epoch)
            n = F.count(F.lit(1))
            counts = batch.groupBy("source_name").agg(n.alias("fetched")).alias("f").join(fresh.groupBy("source_name").agg(n.alias("new")).alias("n"), F.expr("f.source_name <=> n.source_name"), "left")
            counts = counts.select("f.source_name", "fetched", F.coalesce("new", F.lit(0).cast("long")).alias("new"))
            counts.write.mode("overwrite").parquet(f"{folder}/counters/epoch={epoch}")
        finally:
            normal.unpersist()
        if epoch and epoch % compact_every == 0:
            index.compact(epoch - 1)  # earlier epochs are committed when this one runs

    return write


def archive(spark: SparkSession, folder: str) -> DataFrame:
    """What has been archived; no rows where nothing has landed."""
    path = f"{folder}/archive"
    return spark.read.schema(ARCHIVE).parquet(path) if exists(spark, path) else spark.createDataFrame([], ARCHIVE)


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """Fetched, new and duplicate items per source over all micro-batches."""
    path = f"{folder}/counters"
    rows = spark.read.schema(COUNTERS).parquet(path) if exists(spark, path) else spark.createDataFrame([], COUNTERS)
    total = rows.groupBy("source_name").agg(F.sum("fetched").alias("fetched"), F.sum("new").alias("new"))
    return total.withColumn("duplicates", F.col("fetched") - F.col("new"))


def run_available(items: DataFrame, folder: str, compact_every: int = 64) -> DataFrame:
    """Drain the landed items once and return the archive.

    There is no time bound: each batch drops repeats of its own and what the archive holds, so an item that lands late
    is kept like any other.
    """
    q = (
        items.writeStream.foreachBatch(archive_writer(folder, compact_every))
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return archive(items.sparkSession, folder)
