"""Exact top-k inner products by norm buckets.

Candidates are grouped by length and packed into blocks of bounded size. Each query's k-th best score in the longest
block is a first bar. In any other block the bar, divided by the query's length and the block's greatest length, is a
local cosine threshold: above 1 the whole block is skipped for that query; when it is high, candidates are cut by their
own length and by the part of the product that the query's leading coordinates leave open (Cauchy-Schwarz on the rest);
what survives is multiplied out exactly. Only k rows per query and block leave a task.

Components become floor(256 * x) as integers; products are exact. Missing trailing components count as 0. A vector that
is null, or holds null or non-finite components, takes no part, nor does a row with a null id. A query never meets rows
with its own id. An empty table, or none to query, gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsmart.llm.base import stored

BLOCK = "block long, top double, ids array<long>, norms array<double>, vecs array<double>"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of whole doubles), norm; rows that take no part are gone."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _packed(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, norms = table.column("vec_id").to_numpy(), table.column("norm").to_numpy()
    out = np.zeros((len(ids), dim))
    flat = table.column("v").combine_chunks()
    size = np.diff(flat.offsets.to_numpy())
    row = np.repeat(np.arange(len(ids)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat.flatten().to_numpy()
    return ids, norms, out


def blocks(rows: DataFrame, group, dim: int) -> DataFrame:
    """One row per group; ``group`` must bound the size of its groups."""

    def pack(table: pa.Table) -> pa.Table:
        ids, norms, vecs = _packed(table, dim)
        order = np.lexsort((ids, -norms))
        one = lambda x, t: pa.array([x], pa.list_(t))
        return pa.table([pa.array([table.column("block")[0].as_py()], pa.int64()), pa.array([float(norms.max())]), one(ids[order], pa.int64()), one(norms[order], pa.float64()), one(vecs[order].ravel(), pa.float64())], ["block", "top", "ids", "norms", "vecs"])

    return rows.withColumn("block", group).groupBy("block").applyInArrow(pack, BLOCK)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_block(q_ids, q_norms, q, bars, ids, norms, vecs, k: int, lead: int):
    """(query, id, score) triples: at most k per query, a superset of the block's part of the answer."""
    out = []
    if not len(ids):
        return out
    top = norms[0]
    rest = np.sqrt(np.maximum((vecs[:, lead:] ** 2).sum(1), 0))
    q_rest = np.sqrt((q[:, lead:] ** 2).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_norms * top > 0, bars / (q_norms * top), np.where(bars > 0, np.inf, -np.inf))
    live = np.flatnonzero(local <= 1 + 1e-9)
    dense = live[local[live] < 0.5]  # a low threshold prunes nothing: multiply out
    if len(dense):
        scores = q[dense] @ vecs.T
    for n, i in enumerate(dense):
        s = scores[n]
        ok = np.flatnonzero((ids != q_ids[i]) & (s >= bars[i]))
        if len(ok) > 4 * k:
            cut = np.partition(s[ok], len(ok) - k)[len(ok) - k]
            ok = ok[s[ok] >= cut]
        for j in ok[_best(s[ok], ids[ok], k)]:
            out.append((q_ids[i], ids[j], int(s[j])))
    for i in live[local[live] >= 0.5]:
        n = int(np.searchsorted(-norms, -(bars[i] / q_norms[i]) * (1 - 1e-12), "right")) if bars[i] > 0 else len(ids)
        part = vecs[:n, :lead] @ q[i, :lead]
        may = np.flatnonzero((part + rest[:n] * q_rest[i] >= bars[i] - 1e-6) & (ids[:n] != q_ids[i]))
        s = part[may] + vecs[may, lead:] @ q[i, lead:]
        ok = np.flatnonzero(s >= bars[i])
        for j in ok[_best(s[ok], ids[may][ok], k)]:
            out.append((q_ids[i], ids[may][j], int(s[j])))
    return out


FOUND = "query_id long, vec_id long, score long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk(vectors: DataFrame, queries, k: int = 5, block_rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score for the rows that meet the condition ``queries``."""
    rows = stored(integers(vectors))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.count(F.when(queries, 1)).alias("q")).first()
    if not stats["n"] or not stats["q"]:
        return rows.sparkSession.createDataFrame([], FOUND + ", rank int")
    dim = int(stats["dim"])
    lead = max(1, dim // 4)
    groups = -(-stats["n"] // block_rows)
    steps = min(groups, 256)
    cuts = rows.approxQuantile("norm", [i / steps for i in range(1, steps)], 0.001) if steps > 1 else []
    bucket = F.lit(0)
    for c in sorted(set(cuts)):
        bucket = bucket + F.when(F.col("norm") >= c, 1).otherwise(0)
    # equal lengths stay in one bucket, so a bucket is dealt out over as many blocks as its rows need
    sized = {r["b"]: -(-r["n"] // block_rows) for r in rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    deal = F.element_at(F.create_map(*[F.lit(v) for b, n in sized.items() for v in (b, n)]), bucket)
    packed = stored(blocks(rows, (bucket.cast("long") * (1 << 40)) + F.pmod(F.xxhash64("vec_id"), deal.cast("long")), dim))
    asked = rows.where(queries)
    q_groups = -(-stats["q"] // query_rows)
    asking = stored(blocks(asked, F.pmod(F.xxhash64("vec_id"), F.lit(q_groups)), dim).withColumnsRenamed({"block": "qb", "ids": "q_ids", "norms": "q_norms", "vecs": "q"}).drop("top"))

    def run(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c)[0].values.to_numpy(zero_copy_only=False)
        q_ids, ids = get("q_ids"), get("ids")
        bars = get("bars") if "bars" in table.schema.names else np.full(len(q_ids), -np.inf)
        out = search_block(q_ids, get("q_norms"), get("q").reshape(len(q_ids), dim), bars, ids, get("norms"), get("vecs").reshape(len(ids), dim), k, lead)
        a = np.array(out, np.int64).reshape(-1, 3)
        return pa.table([pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(a[:, 2])], ["query_id", "vec_id", "score"])

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        """Query blocks against candidate blocks: the stated query set against all rows, in blocks."""
        return left.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_groups - 1).cast("long")))).join(right, "qb")

    first = packed.orderBy(F.desc("top"), "block").limit(1)
    start = _ranked(pairs(first, asking).groupBy("block", "qb").applyInArrow(run, FOUND), k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bar"))
    barred = asking.select("qb", F.posexplode("q_ids").alias("pos", "query_id")).join(start, "query_id", "left").groupBy("qb").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.col("bar").cast("double"), F.lit(float("-inf"))).alias("bar")))), lambda x: x["bar"]).alias("bars"))
    reach = F.array_max("q_norms").alias("reach")
    open_pairs = pairs(packed.select("block", "top"), asking.join(barred, "qb").select("qb", reach, F.array_min("bars").alias("least"))).where((F.col("least") < 0) | (F.col("top") * F.col("reach") * (1 + 1e-9) >= F.col("least")))
    found = open_pairs.select("block", "qb").join(packed, "block").join(asking.join(barred, "qb"), "qb").groupBy("block", "qb").applyInArrow(run, FOUND)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")

