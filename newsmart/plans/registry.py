"""Query registry: a name, the survey rows it covers, the Spark plan and the check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from newsmart.plans.sqltext import with_ctes
from newsmart.sources.bind import Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register ``plan(tables)`` under its own name."""

    def wrap(plan: Callable[[Tables], DataFrame]):
        name = plan.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, tuple(covers.split()), plan, with_ctes(sql) if sql else None)
        return plan

    return wrap


_SHARED: dict[tuple, object] = {}


def shared(t: Tables, name: str, make: Callable[[], object]):
    """A checkpointed intermediate that several queries of one session read, as long as the tables' files stay the same."""
    key = (t.spark.sparkContext.applicationId, t.path, t.version(), name)
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


def forget_shared() -> None:
    """Drop the shared intermediates (the benchmark does before each query)."""
    _SHARED.clear()
