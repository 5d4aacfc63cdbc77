"""Benchmark decontamination by spaced seeds.

A mask names the token positions of a window that count; the others may differ. Windows of benchmark items and of
documents are hashed under every mask and joined on the hash. A hit fixes a diagonal (document position minus item
position), along which the two token sequences are compared one to one. A token of the item agrees if the document has
it on that diagonal, or, beside a token that agrees likewise, on one at most ``GAP`` away: words put in or left out shift
the rest. Of all stretches of the item with a share of ``similarity`` of agreeing tokens the one with most of them
counts. It is a leak if those are that share of the whole item, or at least ``RUN``: a document that holds a part of an
item leaks it too.

Items of at most ``SMALL`` tokens also get seeds of four tokens in a row, or of three where four can be missed, so that
no copy of the whole item within ``similarity``, with other words in places, is without a hit. Longer items rely on the
masks, which may miss a copy that differs in nearly every fifth word.

Seeds of a benchmark of at most ``BROADCAST_SEEDS`` windows are broadcast; a larger one is joined by hash. Hits collapse
to distinct (document, item, diagonal) before anything else, so a passage held by very many documents costs a few rows
per document.

Defined results: tokens are runs of letters and digits, lower-cased. Null or empty texts on either side match nothing.
An item shorter than a mask is compared whole: as one seed over all its tokens, for which every document window of that
length stands. Ties and repeated rows give one row per (doc_id, item_id). Null ids are ids. DataFrame functions only.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmart.llm.base import stored

BROADCAST_SEEDS = 1_000_000
#: 1: the position counts.
MASKS = ["1101011", "1110010111"]
#: Agreeing tokens that make a part of an item a leak, and diagonals to either side that count with a hit.
RUN, GAP = 13, 4
#: Items up to so many tokens have seeds of a few tokens in a row.
SMALL = 20


WORDY = r"[\p{L}\p{N}]"


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def _seeds(t: Column, offsets: list[int], tag: int) -> Column:
    """Hash at every window start, in order; an empty array if the text is too short."""
    span = max(offsets) + 1
    at = lambda i: F.xxhash64(F.lit(tag), *[F.get(t, i + o) for o in offsets])
    return F.when(F.size(t) >= span, F.transform(F.sequence(F.lit(0), F.size(t) - span), at)).otherwise(F.expr("cast(array() as array<bigint>)"))


def _windows(df: DataFrame, keep: list[str], masks: list[list[int]], spans: list[int]) -> DataFrame:
    """A row per (mask, window start): ``keep``, seed, pos. ``df`` has column t."""
    arrays = [_seeds(F.col("t"), m, k) for k, m in enumerate(masks)] + [_seeds(F.col("t"), list(range(s)), 100 + s) for s in spans]
    pos = F.concat(*[F.transform(a, lambda s, i: F.struct(s.alias("seed"), i.alias("pos"))) for a in arrays])
    return df.select(*keep, F.explode(pos).alias("w")).select(*keep, "w.seed", "w.pos")


def row_seed(n: int, share: Fraction) -> int:
    """Tokens that surely agree in a row in a copy of n tokens of which ``share`` agree, the rest being replaced."""
    same = math.ceil(share * n)
    return -(-same // (n - same + 1))


def best_stretch(agrees: Column, share: Fraction) -> Column:
    """struct(matched, first): most agreeing places in any stretch with ``share`` of them, and where it begins.

    A place adds to or takes from a balance, which is never lower at the end of such a stretch than at its begin; for every
    end the first begin holds most. ``low`` has the first place at which the balance was down to -k.
    """
    up, down = share.denominator - share.numerator, share.numerator
    place = lambda i, a: F.struct(i.alias("i"), a.alias("a"))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("a"), F.lit(0).alias("p"), F.array(place(F.lit(0), F.lit(0))).alias("low"), F.lit(0).alias("matched"), F.lit(0).alias("first"))

    def balance(s, x):
        return F.struct((s["i"] + 1).alias("i"), (s["a"] + x.cast("int")).alias("a"), (s["p"] + F.when(x, up).otherwise(-down)).alias("p"), s["low"].alias("low"), s["matched"].alias("matched"), s["first"].alias("first"))

    def step(s, x):
        n = balance(s, x)
        new = -n["p"] - F.size(s["low"]) + 1
        low = F.when(new > 0, F.concat(s["low"], F.array_repeat(place(n["i"], n["a"]), new))).otherwise(s["low"])
        begin = F.get(s["low"], F.greatest(-n["p"], F.lit(0)))  # none at a new low: nothing ends there
        more = F.coalesce(n["a"] - begin["a"] > s["matched"], F.lit(False))
        return F.struct(n["i"].alias("i"), n["a"].alias("a"), n["p"].alias("p"), low.alias("low"), F.when(more, n["a"] - begin["a"]).otherwise(s["matched"]).alias("matched"), F.when(more, begin["i"]).otherwise(s["first"]).alias("first"))

    return F.aggregate(agrees, zero, step, lambda s: F.struct(s["matched"].alias("matched"), s["first"].alias("first")))


def leaks(docs: DataFrame, benchmark: DataFrame, masks: list[str] = MASKS, similarity: float = 0.8, run: int = RUN) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, item_id, matched, item_tokens, start (token in the doc)."""
    share = Fraction(similarity).limit_denominator(100)
    offsets = [[i for i, c in enumerate(m) if c == "1"] for m in masks]
    shortest = min(len(m) for m in masks)
    items = benchmark.where(F.col("text").rlike(WORDY)).select("item_id", tokens(F.col("text")).alias("t")).distinct()
    short = [r["n"] for r in items.where(F.size("t") < shortest).select(F.size("t").alias("n")).distinct().collect()]  # fewer values than the mask has places
    known = _windows(items.where(F.size("t") >= shortest), ["item_id"], offsets, [])
    if short:
        whole = items.where(F.size("t") < shortest)
        for n in sorted(short):
            known = known.unionByName(_windows(whole.where(F.size("t") == n), ["item_id"], [], [n]))
    small_sizes = [r["n"] for r in items.where(F.size("t").between(shortest, SMALL)).select(F.size("t").alias("n")).distinct().collect()]  # at most SMALL values
    rows = {n: min(4, row_seed(n, share)) for n in small_sizes}
    for k in sorted(set(rows.values())):
        known = known.unionByName(_windows(items.where(F.size("t").isin([n for n in rows if rows[n] == k])), ["item_id"], [], [k]))
    spans = sorted({*short, *rows.values()})
    known = known.select("item_id", "seed", F.col("pos").alias("item_pos"))
    few = known.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    small = F.broadcast if few else (lambda df: df)

    texts = docs.where(F.col("text").rlike(WORDY)).select("doc_id", tokens(F.col("text")).alias("t"))
    tried = _windows(texts, ["doc_id"], offsets, spans)
    hits = tried.join(small(known), "seed").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    per = hits.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "shift")).alias("hits")).withColumnRenamed("doc_id", "_id")
    per = stored(per)  # so the planner knows how few documents have hits

    # compare along each diagonal
    found = texts.join(per, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "t", F.explode("hits").alias("hit")).select("doc_id", "t", "hit.item_id", "hit.shift")
    sides = found.join(small(items.select(F.col("item_id").alias("_item"), F.col("t").alias("u"))), F.col("item_id").eqNullSafe(F.col("_item")))

    def same(i, d):
        return F.coalesce(F.get("u", i) == F.get("t", i + F.col("shift") + d), F.lit(False))

    def agrees(v, i):
        out = same(i, 0)
        for d in [x for k in range(1, GAP + 1) for x in (k, -k)]:
            out = out | (same(i, d) & (same(i - 1, d) | same(i + 1, d)))
        return out

    best = sides.withColumn("ok", F.transform("u", agrees)).withColumn("b", best_stretch(F.col("ok"), share))
    matched, n, first = F.col("b.matched"), F.size("u"), F.col("b.first")
    whole = matched >= similarity * n
    begin = F.when(whole, F.lit(0)).otherwise(first + F.array_position(F.slice("ok", first + 1, n), True).cast("int") - 1)
    scored = best.where(whole | (matched >= run)).select("doc_id", "item_id", matched.alias("matched"), n.alias("item_tokens"), F.greatest(F.col("shift") + begin, F.lit(0)).alias("start"))
    best = F.max(F.struct("matched", (-F.col("start")).alias("start"), "item_tokens")).alias("b")
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.matched").alias("matched"), F.col("b.item_tokens").alias("item_tokens"), (-F.col("b.start")).alias("start"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    bad = stored(leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_leaked")).distinct())
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_leaked")), "left_anti").select(docs.columns)
