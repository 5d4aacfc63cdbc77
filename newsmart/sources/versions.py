"""Tables whose replacement becomes visible at once or not at all.

A version is a folder of its own. Pointers are empty files whose names hold a number and the version's folder: creating one
is a single step of the file system, and the greatest number is the current version. Whoever reads keeps the folder found at
the start, so a reader never sees half a replacement; a writer that dies leaves a folder that no pointer names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer published first."""


class Folder:
    """Names in a folder of the session's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        p = self._new(self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if s.getPath().getName()[0] not in "._") if self._fs.exists(p) else []

    def create(self, name: str) -> bool:
        """Create an empty file; False if it exists. One step."""
        return self._fs.createNewFile(self._new(f"{self.path}/{name}"))

    def remove(self, which) -> None:
        for name in self.names():
            if which(name):
                self._fs.delete(self._new(f"{self.path}/{name}"), True)


def exists(spark: SparkSession, path: str) -> bool:
    return bool(Folder(spark, path).names())


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._data, self._pointers, self._claims = (Folder(spark, f"{self.path}/{x}") for x in ("data", "pointers", "claims"))

    def current(self) -> tuple[int, str | None]:
        """(number, name) of the current version; (0, None) before the first."""
        names = self._pointers.names()
        return (int(names[-1][:12]), names[-1][13:]) if names else (0, None)

    def read(self, schema: StructType) -> DataFrame:
        """The current version; no rows before the first."""
        name = self.current()[1]
        return self.spark.read.schema(schema).parquet(f"{self.path}/data/{name}") if name else self.spark.createDataFrame([], schema)

    def stage(self, rows: DataFrame, partition: list[str] = (), note: str = "") -> str:
        """Write a version that nobody sees yet; its name ends in ``note``."""
        name = uuid.uuid4().hex + (f"-{note}" if note else "")
        rows.write.partitionBy(*partition).parquet(f"{self.path}/data/{name}")
        return name

    def publish(self, name: str, after: int) -> None:
        """Make a staged version current, if the current one still is number ``after``."""
        number = f"{after + 1:012d}"
        if self.current()[0] != after or not self._claims.create(number):
            raise Conflict(f"{self.path} has moved past version {after}")
        self._pointers.create(f"{number}-{name}")

    def replace(self, make, partition: list[str] = (), note: str = "") -> None:
        """Publish ``make(current rows)``; make gets the version's folder name (None at first) and returns the rows to write."""
        after, name = self.current()
        self.publish(self.stage(make(name), partition, note), after)

    def forget(self, keep: int = 2) -> None:
        """Remove versions older than the last ``keep`` and what no pointer names. Not while others write."""
        last = self._pointers.names()[-keep:]
        self._pointers.remove(lambda p: p not in last)
        self._data.remove(lambda d: d not in {p[13:] for p in last})


def replace_keys_in(table: VersionedTable, fresh: DataFrame, key: str) -> None:
    """Keyed replacement: all rows of the keys in ``fresh`` give way to its rows, in one step."""
    from newsmart.sources.writers import replace_keys

    table.replace(lambda _: replace_keys(table.read(fresh.schema), fresh, key))
