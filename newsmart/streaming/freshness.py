"""Arrival monitor over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(rows: DataFrame, time: str, kind: str, size: str = "2 hours", slide: str = "30 minutes") -> DataFrame:
    """Arrivals and newest arrival per sliding window; works on a stream or a table."""
    return rows.groupBy(F.window(time, size, slide).alias("w"), F.col(kind)).agg(
        F.count(F.lit(1)).alias("n"), F.max(time).alias("newest")
    ).select(F.col("w.start").alias("window_start"), kind, "n", "newest")


def run_available(rows: DataFrame, time: str, kind: str, folder: str) -> DataFrame:
    """Drain a stream of arrivals into window counts and return them.

    Each micro-batch stores its own partial counts, a replayed one over its former ones; windows are their sums. There is no
    time bound, so an arrival that lands late is counted like any other.
    """
    spark = rows.sparkSession

    def keep(batch: DataFrame, epoch: int) -> None:
        window_counts(batch, time, kind).write.mode("overwrite").parquet(f"{folder}/windows/epoch={epoch}")

    q = rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    parts = spark.read.parquet(f"{folder}/windows")
    return parts.groupBy("window_start", kind).agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))
