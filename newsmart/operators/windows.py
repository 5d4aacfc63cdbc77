"""Ranks over a whole table without gathering it in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsmart.session import cut_lineage


def global_rank(df: DataFrame, order: list, partitions: int | None = None) -> DataFrame:
    """Row number over the full order (which must end in a unique column).

    The rows are range-partitioned and written once, so partition membership is fixed; each
    partition is numbered on its own and shifted by the sizes of those before it. Only one
    count per partition is ever brought together.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fixed = cut_lineage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # one row per range partition: bounded by n
    return fixed.join(F.broadcast(shift), "_part").withColumn("rank", local + F.col("_shift")).drop("_part", "_shift")


def nearest_rank(df: DataFrame, column: str, p: float) -> DataFrame:
    """Nearest-rank percentile from value counts: ties never need to be sorted row by row."""
    per = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(column)).first()[0]
    target = math.ceil(p * total)
    # the distinct values are cut to one bucket first, so the running sum sees a bounded slice
    return _value_at(per, column, target)


def _value_at(per: DataFrame, column: str, target: int, buckets: int = 1000) -> DataFrame:
    lo, hi = per.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return per.select(column).limit(0)
    width = (hi - lo) / buckets or 1.0
    bucketed = per.withColumn("_b", F.least(F.floor((F.col(column) - lo) / width), F.lit(buckets - 1)))
    sums = {r["_b"]: r["n"] for r in bucketed.groupBy("_b").agg(F.sum("_n").alias("n")).collect()}  # at most `buckets` rows
    before = 0
    for b in sorted(sums):
        if before + sums[b] >= target:
            break
        before += sums[b]
    part = bucketed.where(F.col("_b") == b)
    run = F.sum("_n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)) + before
    return part.withColumn("_run", run).where(F.col("_run") >= target).orderBy(column).limit(1).select(column)
