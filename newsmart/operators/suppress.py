"""Near-duplicate suppression: the titles of an edition that are similar, and what a pass in order keeps."""

from __future__ import annotations

import functools
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmart.session import cut_lineage

TILE = 1024  # titles of an edition are compared in tiles of about this many
FOLDED = 64  # characters are counted in so many cells; folding only loosens the bound
LONG = 200  # the alignment starts no block at a frequent character of a second text of this length or more
GRAM, GRAM_CELLS, CHAR_CELLS = 4, 2048, 256


def common_subsequence(masks: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel; ``masks`` are the places of each character in a text of length n."""
    full = (1 << n) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _masks(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _grams(titles: list[str]) -> list[Counter]:
    return [Counter(zip(t, t[1:])) for t in titles]


def _codes(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le"), np.uint32)


def _seeds(t: str) -> Counter:
    """Characters at which the alignment starts a block if ``t`` is the second text: all but those of more than 1 % of it."""
    return Counter({c: n for c, n in Counter(t).items() if n <= len(t) // 100 + 1})


def _runs(t: str) -> Counter:
    return Counter(t[i : i + GRAM] for i in range(len(t) - GRAM + 1))


def _block_bound(a: list[str], b: list[str], pairs: np.ndarray) -> np.ndarray:
    """At least as many characters as the alignment matches, for pairs whose second text is ``LONG`` or more.

    Each block but one at the start of both texts holds a seed, so blocks are at most the common seeds and one; and a block
    has at most ``GRAM - 1`` characters more than runs of ``GRAM`` characters, which are common. Folding only loosens the bound.
    """
    kind = np.uint16 if max(map(len, [*a, *b])) < 1 << 16 else np.uint32
    mix = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)

    def runs(t):
        c = _codes(t)
        n = max(0, len(c) - GRAM + 1)
        h = sum((c[k : k + n] * mix[k] for k in range(1, GRAM)), c[:n] * mix[0])
        return np.bincount((h >> np.uint32(16)) % GRAM_CELLS, minlength=GRAM_CELLS)

    def seeds(t):
        c, n = np.unique(_codes(t), return_counts=True)
        few = n <= len(t) // 100 + 1
        return np.bincount(c[few] % CHAR_CELLS, n[few], CHAR_CELLS)

    def cells(titles, own, count, width):
        out = np.zeros((len(titles), width), kind)
        for i in np.unique(own):
            out[i] = count(titles[i])
        return out

    one, two = pairs[:, 0], pairs[:, 1]
    run_a, run_b = cells(a, one, runs, GRAM_CELLS), cells(b, two, runs, GRAM_CELLS)
    char_a, seed_b = cells(a, one, lambda t: np.bincount(_codes(t) % CHAR_CELLS, minlength=CHAR_CELLS), CHAR_CELLS), cells(b, two, seeds, CHAR_CELLS)
    out = np.empty(len(pairs), np.int64)
    for k in range(0, len(pairs), 1024):
        i, j = one[k : k + 1024], two[k : k + 1024]
        common = np.minimum(run_a[i], run_b[j]).sum(1, dtype=np.int64)
        out[k : k + 1024] = common + (GRAM - 1) * (np.minimum(char_a[i], seed_b[j]).sum(1, dtype=np.int64) + 1)
    return out


def _count_bound(a: list[str], b: list[str]) -> np.ndarray:
    """Characters that two titles have in common, at least as many as any alignment matches."""

    def cells(titles):
        out = np.zeros((len(titles), FOLDED), np.int32)
        for i, t in enumerate(titles):
            out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % FOLDED, minlength=FOLDED)
        return out

    x, y = cells(a), cells(b)
    common = np.zeros((len(a), len(b)), np.int32)
    for c in range(FOLDED):
        common += np.minimum(x[:, c, None], y[None, :, c])
    return common


def _jaccard(a: list[str], b: list[str]) -> np.ndarray:
    """Jaccard similarity of the token sets, by a product of incidence matrices."""
    index: dict[str, int] = {}
    sets = [[{index.setdefault(w, len(index)) for w in t.split()} for t in side] for side in (a, b)]

    def incidence(side):
        out = np.zeros((len(side), len(index)), np.float32)
        for i, s in enumerate(side):
            out[i, list(s)] = 1
        return out

    x, y = map(incidence, sets)
    common = (x @ y.T).astype(np.float64)
    union = np.array([len(s) for s in sets[0]], np.float64)[:, None] + np.array([len(s) for s in sets[1]], np.float64)[None, :] - common
    return common / np.maximum(union, 1)


def similar_pairs(a: list[str], b: list[str], threshold: float) -> tuple[np.ndarray, int]:
    """(rows (i, j) such that a[i] is similar to b[j], pairs that had to be aligned). Titles hold tokens and are lower case.

    The matching-blocks ratio is at most twice the common subsequence over both lengths, and that at most the common
    characters. A pair is aligned only if all bounds reach the threshold: the common characters; the common pairs of
    neighbours (every matched block has one less than its length, and there is at most one block more than unmatched
    characters); for a long second title the runs of characters and the seeds (``_block_bound``), first folded, then exactly; and
    the longest common subsequence.
    """
    by_tokens = _jaccard(a, b) >= threshold
    total = np.array([len(t) for t in a])[:, None] + np.array([len(t) for t in b])[None, :]
    ratio = lambda matched, n: 2.0 * matched / n  # as the alignment computes it
    open_ = np.argwhere(~by_tokens & (ratio(_count_bound(a, b), total) >= threshold))
    long = np.array([len(t) for t in b])[open_[:, 1]] >= LONG
    if long.any():
        fits = ~long
        fits[long] = ratio(_block_bound(a, b, open_[long]), total[tuple(open_[long].T)]) >= threshold
        open_ = open_[fits]
    grams_a, grams_b, masks, aligned = _grams(a), _grams(b), {}, 0
    runs, chars, seeds = (functools.cache(f) for f in (_runs, Counter, _seeds))
    found = [np.argwhere(by_tokens)]
    for i, j in open_.tolist():
        n = len(a[i]) + len(b[j])
        if len(b[j]) >= LONG:
            matched = (runs(a[i]) & runs(b[j])).total() + (GRAM - 1) * ((chars(a[i]) & seeds(b[j])).total() + 1)
            if ratio(matched, n) < threshold:
                continue
        neighbours = (grams_a[i] & grams_b[j]).total()
        if ratio((neighbours + n + 1) // 3, n) < threshold:
            continue
        if i not in masks:
            masks[i] = _masks(a[i])
        if ratio(common_subsequence(masks[i], len(a[i]), b[j]), n) < threshold:
            continue
        aligned += 1
        if SequenceMatcher(None, a[i], b[j]).ratio() >= threshold:
            found.append(np.array([[i, j]]))
    return np.concatenate(found).reshape(-1, 2), aligned


def similar_titles(titles: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """titles (edition_date, tid, t) -> (edition_date, a, b): title a is similar to title b, which came first.

    An edition's titles are cut into tiles by hash and every two tiles meet in one task, so no task sees more than two.
    """
    n = titles.groupBy("edition_date").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("t"), F.col("tiles")).cast("int")
    met = titles.join(n, "edition_date").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("edition_date", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "own", "tid", "t")

    def work(table: pa.Table) -> pa.Table:
        side, tid, text = np.array(table.column("own")), np.array(table.column("tid")), table.column("t").to_pylist()
        t1, t2 = table.column("t1")[0].as_py(), table.column("t2")[0].as_py()
        one, two = np.flatnonzero(side == t1), np.flatnonzero(side == t2)
        out = []
        for x, y in [(one, two)] if t1 == t2 else [(one, two), (two, one)]:  # the ratio depends on which title is which
            at, _ = similar_pairs([text[i] for i in x], [text[i] for i in y], threshold)
            out.append(np.stack([tid[x[at[:, 0]]], tid[y[at[:, 1]]]], 1))
        pairs = np.concatenate(out)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        day = table.column("edition_date")[0].as_py()
        return pa.table([pa.array([day] * len(pairs), pa.date32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["edition_date", "a", "b"])

    by = ["edition_date", "t1", "t2"]  # few bytes and much work: as many tasks as there are partitions
    met = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    return met.groupBy(*by).applyInArrow(work, "edition_date date, a long, b long")


def kept(rows: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """rows (edition_date, ord, id, t, url), in order of ``ord`` -> (edition_date, id) of what a sequential pass keeps.

    Each round keeps the rows that no undecided earlier row can still push out, then drops what the kept ones push out.
    Rows of one URL or one title compare by the least of their group, so groups never become pairs; only the table of
    similar titles holds pairs. Rounds follow the longest chain of rows each similar to an earlier one, not the rows.
    """
    ed = "edition_date"
    same = [ed, "t", "url"]
    first = rows.groupBy(*same).agg(F.min(F.struct("ord", "id")).alias("f")).select(*same, "f.ord", "f.id")
    first = cut_lineage(first)
    titles = first.where(F.col("t").rlike(r"(?U)[^\x1C-\x1F\s]")).groupBy(ed, "t").agg(F.min("id").alias("tid"))  # titles without tokens are like none
    similar = cut_lineage(similar_titles(titles, threshold, tile))
    todo = cut_lineage(first.join(titles, [ed, "t"], "left").select(ed, "ord", "id", "url", "tid"))
    taken = None
    while True:
        by_url = todo.groupBy(ed, "url").agg(F.min("ord").alias("u"))
        by_title = todo.where("tid is not null").groupBy(ed, "tid").agg(F.min("ord").alias("o"))
        ahead = similar.join(by_title.select(ed, F.col("tid").alias("b"), "o"), [ed, "b"]).groupBy(ed, F.col("a").alias("tid")).agg(F.min("o").alias("s"))
        x = todo.join(by_url, [ed, "url"]).join(by_title, [ed, "tid"], "left").join(ahead, [ed, "tid"], "left")
        free = (F.col("ord") == F.col("u")) & (F.col("o").isNull() | (F.col("ord") == F.col("o"))) & (F.col("s").isNull() | (F.col("s") > F.col("ord")))
        new = cut_lineage(x.where(free).select(ed, "ord", "id", "url", "tid"))
        taken = new.select(ed, "id") if taken is None else taken.unionByName(new.select(ed, "id"))
        pushed = new.where("tid is not null").select(ed, "tid", F.col("ord").alias("k"))
        near = similar.join(pushed.withColumnRenamed("tid", "b"), [ed, "b"]).select(ed, F.col("a").alias("tid"), "k").unionByName(pushed)
        near = near.groupBy(ed, "tid").agg(F.min("k").alias("k"))
        rest = todo.join(new.select(ed, "url"), [ed, "url"], "left_anti").join(near, [ed, "tid"], "left")
        todo = cut_lineage(rest.where("k is null or k > ord").select(ed, "ord", "id", "url", "tid"))
        if todo.isEmpty():
            return taken
