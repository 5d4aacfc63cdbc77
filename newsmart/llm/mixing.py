"""Mixing sources to target weights.

Words of each source are packed into blocks of a fixed length. Every source owns a number of output slots; the slots of
an output shard are a multinomial draw over the sources, conditioned on the totals being met (a multivariate
hypergeometric draw, made top-down over halves of the shard range, so any task can draw its own shards). Slot j of a
source goes to a block through the source's pseudorandom index permutation, a new one for each pass over the source, and
blocks are then joined by index.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own, last in order;
repeated rows and null ids are rows like any other; an empty table gives an empty mix. Other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsmart.llm.base import WORD, mixed

WEIGHTS = (5.0, 2.0, 1.0)
URN = 900_000_000  # the generator draws from fewer slots than 10^9


def targets_of(sizes: list[int], weights: list[float], share: float = 1.0, most: float = 3.0) -> list[float]:
    """Words wanted of each source: ``share`` of all by weight, none above ``most`` times its size, the excess reshared."""
    wanted, left, open_ = [0.0] * len(sizes), share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                wanted[i] = unit * weights[i]
            break
        for i in over:
            wanted[i] = float(most * sizes[i])
            left -= wanted[i]
        open_ = [i for i in open_ if i not in over]
    return wanted


def _split(quota: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's slots fall into the first ``take`` slots of all."""
    out, left, urns = np.zeros_like(quota), quota.copy(), int(quota.sum()) // URN + 1
    for more in range(urns, 0, -1):  # a draw from a large urn is the sum of draws from its parts
        part = left // more
        n = take * int(part.sum()) // max(int(left.sum()), 1)
        out += rng.multivariate_hypergeometric(part, n, method="marginals")
        left, take = left - part, take - n
    return out


def shard_draw(quota: np.ndarray, shard: int, shards: int, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, number of slots) of every source in one shard; the same in every task and rerun."""
    lo, hi, first, total = 0, shards, np.zeros_like(quota), int(quota.sum())
    while hi - lo > 1:
        mid = (lo + hi) // 2
        take = min(total, mid * length) - lo * length
        left = _split(quota, take, np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            quota, hi = left, mid
        else:
            first, quota, lo = first + left, quota - left, mid
    return first, quota


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1: four Feistel rounds, walking on until the image is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mixed(np.arange(1, 5, dtype=np.uint64) + np.uint64(key % 2**63))

    def once(x):
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while (out >= n).any():
        far = out >= n
        out[far] = once(out[far])
    return out.astype(np.int64)


@dataclass
class Mix:
    layout: DataFrame  # a row per document: s, part, row, copy (together its number), off (first word in its source), size, doc_id, source, source_size, target
    slots: DataFrame  # shard, slot, s, block: the drawn mix
    block_words: int

    def spans(self) -> DataFrame:
        """A row per document and block that it touches (none for empty documents: one row with a null block)."""
        n = self.block_words
        last = F.expr(f"(off + size - 1) div {n}")
        cut = self.layout.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"off div {n}"), last))))
        start = F.greatest(F.col("off"), F.col("block") * n)
        return cut.withColumn("first_word", start - F.col("off")).withColumn("n_words", F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * n) - start)

    # slots come from a few shard numbers, so their size is not known to the planner: joins with them are by sorting
    def manifest(self) -> DataFrame:
        """The mixed corpus: which words of which document fill each slot of each shard."""
        return self.slots.hint("merge").join(self.spans(), ["s", "block"]).select("shard", "slot", "source", "doc_id", "first_word", "n_words")

    def taken(self) -> DataFrame:
        """Words taken of every document, repeats counted."""
        times = self.slots.groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"))
        words = F.coalesce(F.sum(F.col("n_words") * F.col("times")), F.lit(0)).alias("taken")
        return self.spans().join(times.hint("merge"), ["s", "block"], "left").groupBy("s", "part", "row", "copy", "off", "doc_id", "source", "size", "source_size", "target").agg(words)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: float = 3.0, block_words: int = 64, shard_slots: int = 4096, seed: int = 7, part_rows: int = 20_000) -> Mix:
    """Plan a mix of ``docs`` (doc_id, text, source). Sources by code point, null last, take ``weights`` in turn."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"))
    per = {r["source"]: (r["n"], r["words"]) for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).collect()}  # one row per source
    names = sorted((s for s in per if s is not None)) + [s for s in per if s is None]
    sizes = [int(per[s][1]) for s in names]
    wanted = targets_of(sizes, [weights[i % len(weights)] for i in range(len(names))], share, most)
    blocks = [math.ceil(n / block_words) for n in sizes]
    quota = np.array([min(round(t * b / n), math.floor(most * b)) if n else 0 for t, b, n in zip(wanted, blocks, sizes)], np.int64)
    sources = spark.createDataFrame([(i, s, n, t) for i, (s, n, t) in enumerate(zip(names, sizes, wanted))], "s int, _source string, source_size long, target double")
    named = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")  # one row per source

    # running word count per source: within a bounded part by a window, over parts by their sums; equal rows are one until then
    parts = max(1, math.ceil(sum(n for n, _ in per.values()) / part_rows))
    alike = ["s", "doc_id", "size"]
    named = named.groupBy(*alike, "source", "source_size", "target").agg(F.count(F.lit(1)).alias("copies"))
    named = named.withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(parts)))
    ahead = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("copies")
    shift = named.groupBy("s", "part").agg(F.sum(words).alias("_n")).select("s", "part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_shift"))
    own = Window.partitionBy("s", "part").orderBy("doc_id", "size")
    before = F.coalesce(F.sum(words).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = named.join(shift, ["s", "part"]).withColumn("row", F.row_number().over(own)).withColumn("off", F.col("_shift") + before).drop("_shift")
    layout = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("off", F.col("off") + F.col("copy") * F.col("size")).drop("copies")

    total = int(quota.sum())
    shards = math.ceil(total / shard_slots)

    def drawn(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, count = shard_draw(quota, shard, shards, shard_slots, seed)
                s = np.repeat(np.arange(len(count)), count)
                index = np.concatenate([np.arange(f, f + c) for f, c in zip(first, count)] or [np.zeros(0, np.int64)])
                block = np.zeros(len(index), np.int64)
                for i in np.flatnonzero(count):
                    own = s == i
                    turn = index[own] // blocks[i]
                    for t in np.unique(turn):
                        at = np.flatnonzero(own)[turn == t]
                        block[at] = permuted(index[at] % blocks[i], blocks[i], hash((seed, int(i), int(t))))
                slot = np.random.default_rng([seed, shard, shards, 1]).permutation(len(index))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), shard, np.int64)), pa.array(slot.astype(np.int64)), pa.array(s.astype(np.int32)), pa.array(block)], ["shard", "slot", "s", "block"])

    slots = spark.range(shards).mapInArrow(drawn, "shard long, slot long, s int, block long")
    return Mix(layout, slots, block_words)
