"""Neighbours inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_in_group(rows: DataFrame, group: str, key: str, width: int = 100_000) -> DataFrame:
    """The next larger ``key`` of the same group, per row.

    A group is cut into key ranges of fixed width, so no window sees more than ``width`` rows;
    the last row of a range looks up the first key of the group's next non-empty range.
    """
    g = F.xxhash64(group).alias("_g")
    r = rows.select(F.col(group), F.col(key), g, F.floor(F.col(key) / width).alias("_range"))
    inner = r.withColumn("next", F.lead(key).over(Window.partitionBy(group, "_range").orderBy(key)))
    firsts = r.groupBy(group, "_range").agg(F.min(key).alias("_first"))
    after = F.lead("_first").over(Window.partitionBy(group).orderBy("_range"))
    jump = firsts.select(group, "_range", after.alias("_after"))
    return inner.join(jump, [group, "_range"]).select(group, key, F.coalesce("next", "_after").alias("next"))
