"""The URLs an archive holds, as an index in hash buckets: a batch reads the buckets of its own URLs only.

New URLs of an epoch are a delta of their own, so a replayed epoch replaces what its first run left. ``compact`` folds
deltas into a base, which becomes visible through a version pointer together with the last epoch it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmart.sources.versions import Folder, VersionedTable

BUCKETS = 256
SCHEMA = "canonical_url string, bucket int"


def bucket(url: str = "canonical_url", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


class UrlIndex:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.base = VersionedTable(spark, f"{folder}/base")
        self._deltas = Folder(spark, f"{folder}/delta")

    def _through(self) -> int:
        name = self.base.current()[1]
        return int(name.rsplit("-", 1)[1]) if name else -1

    def _rows(self, before: int) -> DataFrame:
        """All URLs of epochs before ``before``, with their bucket as a partition column."""
        schema = self.spark.createDataFrame([], SCHEMA).schema
        through, rows = self._through(), self.base.read(schema)
        if self._deltas.names():
            delta = self.spark.read.schema(f"{SCHEMA}, epoch long").parquet(f"{self.folder}/delta")
            rows = rows.unionByName(delta.where((F.col("epoch") > through) & (F.col("epoch") < before)).drop("epoch"))
        return rows

    def known(self, urls: DataFrame, epoch: int) -> DataFrame:
        """Archived URLs in the buckets of ``urls`` (canonical_url), as of the epochs before this one."""
        own = [r[0] for r in urls.select(bucket(buckets=self.buckets)).distinct().collect()]  # at most ``buckets`` numbers
        return self._rows(epoch).where(F.col("bucket").isin(own)).select("canonical_url")

    def add(self, urls: DataFrame, epoch: int) -> None:
        rows = urls.select("canonical_url", bucket(buckets=self.buckets).alias("bucket"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/delta/epoch={epoch}")

    def compact(self, through: int) -> None:
        """Fold the deltas of the epochs up to ``through``, which must be committed, into a new base."""
        rows = self._rows(through + 1)
        self.base.replace(lambda _: rows.repartition("bucket"), ["bucket"], str(through))
        self._deltas.remove(lambda name: int(name.removeprefix("epoch=")) <= through)
