"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmart.session import cut_lineage


def _digest(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, m): every vertex with the smallest of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _roots(low: DataFrame) -> DataFrame:
    """(u, m): every vertex with the end of its chain of smallest neighbours. Chains halve per pass over the vertices."""
    moved = True
    while moved:
        up = low.select(F.col("u").alias("m"), F.col("m").alias("next"))
        step = cut_lineage(low.join(up, "m").select("u", "m", "next"))
        moved = not step.where("m <> next").isEmpty()
        low = step.select("u", F.col("next").alias("m"))
    return low


def _contracted(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges between what the ends are drawn into; those inside one vertex go."""
    ends = edges.join(low.select("u", F.col("m").alias("a")), "u").join(low.select(F.col("u").alias("v"), F.col("m").alias("b")), "v")
    return ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges (u, v) -> (id, label): label is the smallest id of the component.

    First every vertex is drawn along its smallest neighbours into one that has no smaller, as long as that leaves at most half of
    the edges, so a dense graph costs few passes over all its edges. What is left is settled by stars, and labels are handed back level by level.
    """
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut_lineage(e)
    levels, n, shrinks = [], e.count(), True
    while n and shrinks:
        levels.append(_roots(cut_lineage(_lowest(e))))
        e = cut_lineage(_contracted(e, levels[-1]))
        left = e.count()
        n, shrinks = left, 2 * left <= n
    labels = _stars(e, max_rounds)
    for low in reversed(levels):
        labels = low.join(labels.withColumnRenamed("id", "m"), "m", "left").select(F.col("u").alias("id"), F.coalesce("label", "m").alias("label"))
    return cut_lineage(labels.where("id <> label"))


def _stars(e: DataFrame, max_rounds: int) -> DataFrame:
    """(id, label) of every vertex that is not the smallest of its component; edges are distinct, the smaller end is ``v``.

    Alternates the large-star and small-star steps (Kiveris et al., 2014). Each step is a
    min per vertex, combined before the shuffle, and a join back, so a vertex with very many
    neighbours is one aggregate row and its edge list is never gathered. Chains halve per
    round. Every round is checkpointed, which keeps plans short and survives lost executors.
    """
    before = _digest(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(e), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut_lineage(moved.unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        after = _digest(e)
        if after == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("label"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
