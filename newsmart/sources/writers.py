"""Keyed writes as DataFrame results, plus the few places that touch storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmart import lexicon as lx


def match_dimension(new: DataFrame, old: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Pair new rows with existing ids by the first key that matches, then the next."""
    todo, done = new, None
    for k in keys:
        side = old.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(id_column).alias("_old_id"))
        pairs = todo.join(side, k, "left").select(*new.columns, "_old_id")
        hit = pairs.where(F.col("_old_id").isNotNull())
        done = hit if done is None else done.unionByName(hit)
        todo = pairs.where(F.col("_old_id").isNull()).drop("_old_id")
    return done.unionByName(todo.withColumn("_old_id", F.lit(None).cast(old.schema[id_column].dataType)))


def upsert_dimension(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], id_column: str = "id") -> DataFrame:
    """New version of the dimension with ``change_type`` INSERTED, UPDATED or UNCHANGED."""
    m = match_dimension(new, old, keys, id_column)
    prior = old.select(F.col(id_column).alias("_old_id"), *[F.col(f).alias(f"_old_{f}") for f in fields])
    j = m.join(prior, "_old_id", "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_old_{f}"))
    kind = F.when(F.col("_old_id").isNull(), F.lit("INSERTED")).when(same, F.lit("UNCHANGED")).otherwise(F.lit("UPDATED"))
    return j.withColumn("change_type", kind).select(F.col("_old_id").alias("old_id"), *new.columns, "change_type")


def retire_missing(old: DataFrame, new: DataFrame, keys: list[str], children: DataFrame, id_column: str = "id") -> DataFrame:
    """Rows absent from the new set under every key: DELETE without children, else DEACTIVATE."""
    gone = old
    for k in keys:
        gone = gone.join(new.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    n = children.groupBy(id_column).agg(F.count(F.lit(1)).alias("children"))
    return gone.select(*old.columns).join(n, id_column, "left").withColumn("children", F.coalesce("children", F.lit(0))).withColumn(
        "action", F.when(F.col("children") == 0, F.lit("DELETE")).otherwise(F.lit("DEACTIVATE"))
    )


def replace_keys(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Keyed overwrite: fresh rows replace every existing row of the same key."""
    return existing.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def upsert_annotations(existing: DataFrame, incoming: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Latest row per key; a stored final result stays unless forced.

    A max over one struct per key, so the two sides combine before the shuffle.
    """
    both = existing.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    final = (F.col("_in") == 0) & F.col("status").isin(lx.FINAL_STATUSES) & F.lit(not force)
    rest = [c for c in existing.columns if c not in keys]
    rank = F.struct(final.cast("int").alias("f"), F.col("_in"), F.col("processed_at"), F.col("annotation_id"))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest, "_in"), rank).alias("r")).select(
        *keys, *[F.col(f"r.{c}").alias(c) for c in rest], F.when(F.col("r._in") == 1, F.lit("WRITTEN")).otherwise(F.lit("KEPT")).alias("outcome")
    )


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, primary: str, member: str) -> DataFrame:
    """Per key: DELETED, PRIMARY_CHANGED, MEMBERS_CHANGED, ADDED or UNCHANGED.

    Members are compared by count and an order-free hash sum, never gathered into a list.
    """

    def digest(df: DataFrame, p: str) -> DataFrame:
        h = F.sum(F.xxhash64(member).cast("decimal(38,0)"))
        return df.groupBy(key).agg(F.min(primary).alias(f"{p}_primary"), F.count(F.lit(1)).alias(f"{p}_n"), h.alias(f"{p}_h"))

    j = digest(before, "b").join(digest(after, "a"), key, "full_outer")
    return j.select(
        key,
        F.when(F.col("a_n").isNull(), F.lit("DELETED")).when(F.col("b_n").isNull(), F.lit("ADDED"))
        .when(~F.col("b_primary").eqNullSafe(F.col("a_primary")), F.lit("PRIMARY_CHANGED"))
        .when((F.col("b_n") != F.col("a_n")) | (F.col("b_h") != F.col("a_h")), F.lit("MEMBERS_CHANGED"))
        .otherwise(F.lit("UNCHANGED")).alias("change"),
    )


def remaining(todo: DataFrame, processed: DataFrame, key: str = "id") -> DataFrame:
    """Resume point: rows whose key is not in the processed table."""
    return todo.join(processed.select(key).distinct(), key, "left_anti")


def freeze_map(rows: DataFrame, day: str, symbol: str, fields: list[str]) -> DataFrame:
    """symbol -> struct map per day. One entry per instrument, so the map is bounded by the basket."""
    last = rows.groupBy(day, symbol).agg(F.max(F.struct(*fields)).alias("v"))
    return last.groupBy(day).agg(F.map_from_entries(F.collect_list(F.struct(symbol, "v"))).alias("snapshot"))


def contract_gaps(df: DataFrame, table: str, required: dict[str, str]) -> DataFrame:
    """Expected columns with presence, type agreement and null count, in one pass over the table."""
    actual = dict(df.dtypes)
    checks = [
        F.struct(
            F.lit(table).alias("table"), F.lit(c).alias("column"), F.lit(c in actual).alias("present"),
            F.lit(actual.get(c) == typ).alias("type_ok"),
            (F.count_if(F.col(c).isNull()) if c in actual else F.lit(None).cast("bigint")).alias("nulls"),
        )
        for c, typ in required.items()
    ]
    return df.agg(F.array(*checks).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def write_snapshot(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """A small metrics frame as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
