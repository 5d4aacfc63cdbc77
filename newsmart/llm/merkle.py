"""Merkle manifest of a dataset: one digest that commits to every row, and a proof of membership for any row.

Rows are leaves. The leaves of a source, in order, are the lowest level of its tree; every ``FAN`` neighbours are digested
into one node until one is left, the source's subroot. Subroots, in order of their sources, are the leaves of a tree of the
same kind that ends in the root. All inner nodes are records digest -> children, stored by content: equal subtrees are one
record. Proofs descend from the root. The digits of a leaf's rank, most significant first, say which child to take at each
level; the other children are collected. Requests below one node descend as one row until their digits part, so a level has
no more rows than nodes asked for, and the lowest level is joined with the leaves once. The segments are collected from the
root down and reversed for folding a leaf up to the root.

Scale: ranks come from a range partitioning on (source, order) and row counts per partition and source, so a source that
holds a third of all rows is spread over tasks like any other. A group to be digested has at most ``FAN`` rows.

Defined results: null fields are marked as such, so null and empty differ; rows with a null id come first in their source;
ties of ids go by leaf digest, and repeated rows are leaves of their own, in any order as they are equal; a null source is
one source; an empty table has no root and gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmart.llm.base import stored

FAN, BITS = 16, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*columns: Column) -> Column:
    """The digest of a row: of each value its length in UTF-8 bytes and itself, or a mark for null."""
    parts = []
    for c in columns:
        c = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return digest(F.concat(*parts))


@dataclass
class Tree:
    """Trees over groups of nodes. ``leaves``: the input with ``rank`` in its group. ``records[k]``: (digest, children) of
    the nodes k + 1 levels above the leaves. ``tops``: group, n, height, digest of its topmost node."""

    leaves: DataFrame
    tops: DataFrame
    records: list[DataFrame] = field(default_factory=list)


def ranked(nodes: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes with ``rank`` from 0 in their group, (group, n)). No group is gathered; ties are kept apart over partitions."""
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, group, *order, "_tie")
    # ids ascend within a partition by one, so a row's id less the least of its partition and group is its rank there
    dealt = stored(dealt.sortWithinPartitions(group, *order, "_tie").drop("_tie").withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    blocks = dealt.groupBy(group, part.alias("_part")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition at most
    blocks = stored(blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))))
    placed = dealt.withColumn("_part", part).join(blocks, [group, "_part"]).withColumn("rank", F.col("_id") - F.col("_first") + F.col("_before"))
    return placed.drop("_part", "_id", "_first", "_n", "_before"), blocks.groupBy(group).agg(F.sum("_n").alias("n"))


def _height(n: Column) -> Column:
    """Levels above n leaves, i.e. the base-FAN digits of the greatest rank; none above a single leaf."""
    return F.when(n > 1, F.ceil(F.length(F.bin(n - 1)) / BITS)).otherwise(0).cast("int")


def build(nodes: DataFrame, group: str, order: list[str]) -> Tree:
    """Trees over ``nodes`` (group, digest and the columns of the order), one per group."""
    leaves, sizes = ranked(nodes, group, order)
    leaves = stored(leaves)
    sizes = stored(sizes.withColumn("height", _height(F.col("n"))))
    tree = Tree(leaves, sizes)
    level = leaves.select(group, "rank", "digest")
    tops = level.join(sizes.where("height = 0").select(group), group)
    tallest = sizes.agg(F.max("height")).first()[0] or 0
    for k in range(tallest):
        below = level.join(sizes.where(F.col("height") > k).select(group), group, "left_semi")
        up = below.groupBy(group, F.shiftright("rank", BITS).alias("rank")).agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("c"))
        up = up.select(group, "rank", F.transform("c", lambda x: x["digest"]).alias("children"))
        level = stored(up.withColumn("digest", digest(F.array_join("children", ""))))
        tree.records.append(level.select("digest", "children"))
        tops = tops.unionByName(level.join(sizes.where(F.col("height") == k + 1).select(group), group).select(group, "rank", "digest"))
        level = level.select(group, "rank", "digest")
    tree.tops = stored(sizes.join(tops.select(group, "digest"), group))
    return tree


def descend(tree: Tree, group: str, starts: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``asked`` (group, rank and anything else) with the columns of ``starts`` (group, path and anything else) and
    with ``path`` grown by one segment (left, right: the other children's digests joined) per level, from the top down."""
    wanted = {1: asked.select(group, F.shiftright("rank", BITS).alias("node")).distinct()}  # nodes on the way, by level
    for k in range(2, len(tree.records) + 1):
        wanted[k] = wanted[k - 1].select(group, F.shiftright("node", BITS).alias("node")).distinct()
    begin = starts.join(tree.tops.select(group, "height", "digest"), group).withColumn("node", F.lit(0).cast("long"))
    carried = [c for c in starts.columns if c not in (group, "path")]
    here = begin.where(F.col("height") == len(tree.records))
    for k in range(len(tree.records), 0, -1):
        open_ = here.join(tree.records[k - 1].dropDuplicates(["digest"]), "digest").withColumnRenamed("node", "_above").drop("digest")
        next_ = wanted[k - 1].withColumn("_above", F.shiftright("node", BITS)) if k > 1 else asked.withColumn("_above", F.shiftright("rank", BITS))
        digit = (F.col("node" if k > 1 else "rank").bitwiseAND(FAN - 1) + 1).cast("int")
        picked = next_.join(open_, [group, "_above"]).withColumn("path", F.concat("path", F.array(_segment(F.col("children"), digit))))
        if k == 1:
            lone = asked.join(begin.where("height = 0").select(group, "path", *carried), group)
            keep = [*asked.columns, "path", *carried]
            return picked.select(*keep).unionByName(lone.select(*keep))
        down = picked.select(group, "node", "path", *carried, F.element_at("children", digit).alias("digest"))
        here = stored(down.unionByName(begin.where(F.col("height") == k - 1).select(*down.columns)))
    return asked.join(begin.select(group, "path", *carried), group)


def _segment(children: Column, digit: Column) -> Column:
    join = lambda a: F.array_join(a, "")
    return F.struct(join(F.slice(children, F.lit(1), digit - 1)).alias("left"), join(F.slice(children, digit + 1, F.lit(FAN))).alias("right"))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on the way from the leaf to the root."""
    return digest(F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["left"], s["right"])), ""))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(F.reverse(path), start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


@dataclass
class Manifest:
    """``sources``: the trees of rows, by ``src``; ``dataset``: the tree of subroots, one group."""

    sources: Tree
    dataset: Tree


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest(docs: DataFrame, also: dict[str, Column] | None = None) -> Manifest:
    """The manifest of documents. ``also``: further values of each row to keep with its leaf."""
    src = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null first, then by bytes
    more = [c.alias(name) for name, c in (also or {}).items()]
    leaves = docs.select(src.alias("src"), F.col("doc_id"), leaf(*map(F.col, FIELDS)).alias("digest"), *more)
    sources = build(leaves, "src", ["doc_id", "digest"])
    subroots = sources.tops.select(F.lit("").alias("all"), F.col("src").alias("name"), "digest")
    return Manifest(sources, build(subroots, "all", ["name"]))


def prove(m: Manifest, asked: DataFrame) -> DataFrame:
    """``asked``: any rows of m.sources.leaves (src, rank, ...). Adds subroot, root and path (segments from the root down)."""
    top = m.dataset.tops.select("all", F.col("digest").alias("root"), F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("path"))
    some = asked.select(F.col("src").alias("name")).distinct()
    subroots = m.dataset.leaves.join(some, "name", "left_semi").select("all", "rank", F.col("name").alias("src"), F.col("digest").alias("subroot"))
    starts = descend(m.dataset, "all", top, subroots)
    return descend(m.sources, "src", starts.select("src", "subroot", "root", "path"), asked)


def audit(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and whether its row folds to the root.

    ``changed`` marks rows whose text is lower-cased (A-Z) after the manifest was made; rows left alone fold to the root.
    """
    changed = F.coalesce(changed, F.lit(False)) if changed is not None else F.lit(False)
    lowered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    m = manifest(docs, {"tampered": F.when(changed, leaf(*lowered))})
    found = prove(m, m.sources.leaves).withColumn("folded_root", fold(F.coalesce("tampered", "digest"), F.col("path")))
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
