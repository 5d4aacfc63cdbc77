"""Article comparison: features once per article, then scores for pairs worth scoring."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions import text
from newsmart.functions.numbers import clamp, round_half_up
from newsmart.functions.scoring import whole_words
from newsmart.functions.text import contains_any
from newsmart.operators.annotations import pick_annotation
from newsmart.operators.graph import connected_components
from newsmart.operators.joins import is_small, with_source
from newsmart.session import cut_lineage

WINDOW_US = 48 * 3600 * 1_000_000
HOUR_US = 3600 * 1_000_000
BIT_WORDS = 8  # of 64 bits of token hashes
FEATURE_ROWS = 10_000  # feature sets broadcast to the scoring tasks, which pass through the driver; above it they are joined by shuffle


def _has_word(low: Column, terms) -> Column:
    return low.rlike(whole_words(terms))


def features(articles: DataFrame, sources: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """id, at_us, pub_us, source_id and the comparison struct ``f``, once per article."""
    rows = with_source(articles.select("id", "source_id", "title", "published_at", "collected_at", "primary_category"), sources, ["category"])
    names = None
    if annotations is not None:
        n = pick_annotation(annotations, "first_relevant").select(
            F.col("article_id").alias("id"), F.transform("entities", lambda e: e["name"]).alias("names")
        )
        rows = rows.join(n, "id", "left")
        names = F.col("names")
    title = F.col("title")
    low = F.lower(F.coalesce(title, F.lit("")))
    f = F.struct(
        F.sort_array(text.title_tokens(title)).alias("tokens"), F.sort_array(text.key_entities(title, names)).alias("entities"),
        F.sort_array(text.numeric_markers(title)).alias("numbers"), _has_word(low, lx.HOLD_WORDS).alias("hold"),
        _has_word(low, lx.CUT_WORDS).alias("cut"), _has_word(low, lx.HIKE_WORDS).alias("hike"),
        contains_any(low, lx.EARNINGS_TERMS).alias("earnings"), contains_any(low, lx.LAUNCH_TERMS).alias("launch"),
        F.lower(F.coalesce("primary_category", "source_category", F.lit(""))).alias("cat"),
    )
    return rows.select(
        "id", "source_id", F.unix_micros(F.coalesce("published_at", "collected_at")).alias("at_us"),
        F.unix_micros("published_at").alias("pub_us"), f.alias("f"), F.lit("").alias("part"),
    )


def by_part(feats: DataFrame, parts: DataFrame, part: str) -> DataFrame:
    """Repeat features for every part an article belongs to (an edition, say). Parts never link to
    each other; the working id is the struct (part, id)."""
    return parts.select("id", part).join(feats.drop("part"), "id").select(
        F.struct(F.col(part).alias("part"), "id").alias("id"), "source_id", "at_us", "pub_us", "f", F.col(part).cast("string").alias("part")
    )


def title_similarity(a: Column, b: Column) -> Column:
    """Mean of Jaccard and overlap coefficient on two token sets."""
    both, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return F.when(least > 0, (both / F.size(F.array_union(a, b)) + both / least) / F.lit(2.0)).otherwise(F.lit(0.0))


def entity_overlap(a: Column, b: Column) -> Column:
    """Ratio and number of common entities: equal, or one inside the other when both exceed three letters."""

    def same(x, y):
        inside = (F.length(x) > 3) & (F.length(y) > 3) & (x.contains(y) | y.contains(x))
        return (x == y) | inside

    common = F.size(
        F.array_distinct(F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: same(x, y)), lambda y: F.least(x, y)))))
    )
    union = F.size(F.array_union(a, b))
    return F.struct(F.when(union > 0, common / union).otherwise(F.lit(0.0)).alias("ratio"), common.alias("matches"))


def compatible(a: Column, b: Column) -> Column:
    """Categories that may describe one event: equal, missing or broad."""
    broad = lx.BROAD_CATEGORIES
    return (a == "") | (b == "") | (a == b) | a.isin(broad) | b.isin(broad)


def static_score(a: Column, b: Column) -> Column:
    """Everything about a pair except time."""
    e = entity_overlap(a["entities"], b["entities"])
    action = (
        (a["hold"] & (b["cut"] | b["hike"])) | (b["hold"] & (a["cut"] | a["hike"])) | (a["cut"] & b["hike"]) | (b["cut"] & a["hike"])
        | (a["earnings"] & b["launch"] & ~b["earnings"]) | (b["earnings"] & a["launch"] & ~a["earnings"])
    )
    marked = (F.size(a["numbers"]) > 0) & (F.size(b["numbers"]) > 0)
    shared = F.arrays_overlap(a["numbers"], b["numbers"])
    return F.struct(
        title_similarity(a["tokens"], b["tokens"]).alias("title"), e.alias("e"),
        F.when((a["cat"] != "") & (a["cat"] == b["cat"]), F.lit(1.0)).otherwise(F.lit(0.5)).alias("cat"), action.alias("action"),
        (marked & shared & ~action).alias("num_match"), ((marked & ~shared) | action).alias("num_conflict"),
    )


def final_score(s: Column, temp: Column) -> Column:
    t, e, m, c = s["title"], s["e"]["ratio"], s["e"]["matches"], s["cat"]
    L = F.lit
    base = (
        F.when(m >= 2, t * L(0.35) + e * L(0.45) + c * L(0.10) + temp * L(0.10))
        .when(m == 1, t * L(0.45) + e * L(0.30) + c * L(0.15) + temp * L(0.10))
        .otherwise(t * L(0.65) + c * L(0.20) + temp * L(0.15))
    )
    shifted = F.when(s["num_match"], base + L(0.15)).when(s["num_conflict"], base - L(0.35)).otherwise(base)
    return round_half_up(clamp(shifted, 0.0, 1.0), 2)


def band(s: Column, score: Column) -> Column:
    need = F.when((s["e"]["matches"] >= 2) & s["num_match"] & ~s["action"], F.lit(0.55)).otherwise(F.lit(0.68))
    return (
        F.when((score >= need) & ~s["action"], F.lit("HIGH_CONFIDENCE")).when(score >= 0.45, F.lit("AMBIGUOUS")).otherwise(F.lit("LOW_CONFIDENCE"))
    )


def is_edge(s: Column, temp: Column, threshold: float) -> Column:
    score = final_score(s, temp)
    return (band(s, score) == "HIGH_CONFIDENCE") | (score >= threshold)


def proximity(pub_a: Column, pub_b: Column) -> Column:
    """1 at no distance, 0 at 48 hours; 1 when either publication time is missing."""
    gap = F.abs(pub_a - pub_b) / F.lit(3600000000.0)
    near = F.greatest(F.lit(0.0), F.lit(1.0) - gap / F.lit(48.0))
    return F.when(gap.isNull(), F.lit(1.0)).otherwise(near)  # greatest() itself skips nulls


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later expressions read instead of repeating (a one-row generate is not inlined)."""
    return df.withColumn(name, F.explode(F.array(value)))


def score_pairs(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """pairs (a, b) -> score, band and parts."""
    side = lambda p: feats.select(F.col("id").alias(p), F.col("pub_us").alias(f"{p}_pub"), F.col("f").alias(f"{p}_f"))
    j = once(pairs.join(side("a"), "a").join(side("b"), "b"), "s", static_score(F.col("a_f"), F.col("b_f")))
    j = j.withColumn("temp", proximity(F.col("a_pub"), F.col("b_pub"))).withColumn("score", final_score(F.col("s"), F.col("temp")))
    return j.withColumn("band", band(F.col("s"), F.col("score"))).drop("a_f", "b_f", "a_pub", "b_pub")


def partner_counts(feats: DataFrame) -> DataFrame:
    """How many candidate partners each article has: within 48 hours and of a compatible category.

    Counted, not paired. Articles first collapse to one count per category and instant. What lies in the window of an instant is
    what has begun by its end less what had begun before its start: a running total by the hour plus a count inside one hour,
    so that no frame slides over two days of rows.
    """
    broad = F.col("cat").isin(["", *lx.BROAD_CATEGORIES])
    points = feats.select("id", "at_us", F.col("f.cat").alias("cat"))
    per = points.where(F.col("at_us").isNotNull()).groupBy("cat", "at_us").agg(F.count(F.lit(1)).alias("n"))
    everyone = per.groupBy("at_us").agg(F.sum("n").alias("n")).withColumn("lane", F.lit("*"))
    wide = per.where(broad).groupBy("at_us").agg(F.sum("n").alias("n")).withColumn("lane", F.lit("broad"))
    own = per.where(~broad).select("at_us", "n", F.concat(F.lit("c:"), "cat").alias("lane"))
    lanes = everyone.unionByName(wide).unionByName(own)
    # queries: a broad article asks about everyone; another asks its own category and the broad ones
    lane = F.explode(F.when(broad, F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("c:"), "cat"), F.lit("broad")))).alias("lane")
    # at one instant the start of a window comes before the articles and its end after them
    place = lambda us, turn, sign: F.struct((F.col("at_us") + us).alias("pos"), F.lit(turn).alias("turn"), F.lit(sign).alias("sign"))
    ends = F.explode(F.array(place(-WINDOW_US, 0, -1), place(WINDOW_US, 2, 1))).alias("end")
    asks = per.select("cat", "at_us", lane).select("lane", "cat", "at_us", ends).select("lane", "end.*", F.lit(0).cast("bigint").alias("n"), "cat", "at_us")
    data = lanes.select("lane", F.col("at_us").alias("pos"), F.lit(1).alias("turn"), F.lit(0).alias("sign"), "n", F.lit(None).cast("string").alias("cat"), F.lit(None).cast("bigint").alias("at_us"))
    line = data.unionByName(asks).withColumn("hour", F.floor(F.col("pos") / HOUR_US))
    hours = line.groupBy("lane", "hour").agg(F.sum("n").alias("n"))  # one row per lane and hour
    before = Window.partitionBy("lane").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("lane", "hour", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("prior"))
    inside = Window.partitionBy("lane", "hour").orderBy("pos", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = line.withColumn("c", F.sum("n").over(inside)).where("turn <> 1").join(hours, ["lane", "hour"])
    total = seen.groupBy("cat", "at_us").agg((F.sum(F.col("sign") * (F.col("c") + F.col("prior"))) - 1).alias("partners"))
    return points.join(total, ["cat", "at_us"], "left").select("id", F.coalesce("partners", F.lit(0)).alias("partners"))


def bounds(threshold: float) -> tuple[float, float, float]:
    """What any pair linked without a shared number must reach.

    Least title similarity on its own; below it, the least entity ratio; and the least title
    similarity of two titles whose only entity is the same one.
    """
    r = min(threshold, 0.68) - 0.005 - 1e-9
    title = (r - 0.35) / 0.65
    entity = min((r - 0.25 - 0.45 * title) / 0.30, (r - 0.20 - 0.35 * title) / 0.45)
    if entity <= 0.5:
        raise ValueError("the candidate keys assume a linking threshold above 0.6")
    return title, entity, (r - 0.25 - 0.30) / 0.45


def _rare_first(sets: DataFrame, column: str) -> DataFrame:
    """(sig, item, size, rn): set items numbered from the rarest; those of one set only are numbered too, but left out."""
    items = sets.select("sig", "part", F.size(column).alias("size"), F.explode(column).alias("item"))
    df = items.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    return items.join(df, "item").withColumn("rn", F.row_number().over(Window.partitionBy("sig").orderBy("df", "item"))).where("df > 1")


def least_common(similarity: float) -> float:
    """Share of the smaller of two sets that is common if the mean of Jaccard and overlap coefficient is ``similarity``: least
    for sets of one size, where x / (2 - x) + x = 2 * similarity."""
    b = 3 + 2 * similarity
    return (b - math.sqrt(b * b - 16 * similarity)) / 2 - 1e-9


def _must_hit(need: float) -> Column:
    """Among this many rarest items one is shared when the overlap is ``need`` of the size."""
    return F.col("rn") <= F.col("size") - F.ceil(F.col("size") * F.lit(need) - F.lit(1e-9)) + 1


def candidate_keys(sets: DataFrame, threshold: float) -> DataFrame:
    """(sig, key, kind, size, probe, rn, need): every linkable pair has a key that one side probes and both hold.

    rn: the item's place among the set's items, rarest first; need: the share of the smaller set that must be common (0: one
    common item is enough). ``within_reach`` tells from both sides' places whether so much can still be common.

    - titles: similarity t needs a share of the smaller set to be common (``least_common``), so one of the
      smaller title's rarest tokens is in the other (prefix filtering, Chaudhuri et al., 2006);
    - one equal entity each: that entity together with such a token at the lower title bound;
    - several equal entities: the same on the entity ratio, of which 2e / (1 + e) of the smaller set follow;
    - entities inside one another: the rarest four-letter piece of the shorter is in the longer;
    - shared numbers: the number itself.
    """
    t, e, t1 = bounds(threshold)
    t, t1, e = least_common(t), least_common(t1), 2 * e / (1 + e) - 1e-9
    tokens = _rare_first(sets, "tokens")
    titles = tokens.select("sig", F.concat("part", F.lit("t:"), "item").alias("key"), F.lit("t").alias("kind"), "size", _must_hit(t).alias("probe"), "rn", F.lit(t).alias("need"))
    only = sets.where(F.size("entities") == 1).select("sig", F.get("entities", 0).alias("name"))
    single = tokens.join(only, "sig").select(
        "sig", F.concat("part", F.lit("o:"), "name", F.lit("|"), "item").alias("key"), F.lit("o").alias("kind"), "size", _must_hit(t1).alias("probe"), "rn", F.lit(t1).alias("need")
    )
    names = _rare_first(sets.where(F.size("entities") > 1), "entities").select(
        "sig", F.concat("part", F.lit("e:"), "item").alias("key"), F.lit("e").alias("kind"), "size", _must_hit(e).alias("probe"), "rn", F.lit(e).alias("need")
    )
    flat, free = F.lit(0).alias("size"), [F.lit(0).alias("rn"), F.lit(0.0).alias("need")]
    numbers = sets.select("sig", "part", F.explode("numbers").alias("n")).select("sig", F.concat("part", F.lit("n:"), "n").alias("key"), F.lit("n").alias("kind"), flat, F.lit(True).alias("probe"), *free)
    long = sets.select("sig", "part", F.explode("entities").alias("name")).where(F.length("name") > 3)
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - 3), lambda i: F.substr("name", i, F.lit(4))))
    grams = long.select("sig", "part", "name", F.explode(pieces).alias("item"))
    df = grams.groupBy("item").agg(F.count_distinct("sig").alias("df"))
    best = F.row_number().over(Window.partitionBy("sig", "name").orderBy("df", "item"))
    inside = grams.join(df, "item").withColumn("probe", best == 1).where("df > 1").groupBy("sig", "part", "item").agg(F.bool_or("probe").alias("probe")).select(
        "sig", F.concat("part", F.lit("g:"), "item").alias("key"), F.lit("g").alias("kind"), flat, "probe", *free
    )
    return titles.unionByName(single).unionByName(names).unionByName(numbers).unionByName(inside)


def within_reach(size_a: Column, rn_a: Column, size_b: Column, rn_b: Column, need: Column) -> Column:
    """Whether the smaller set a can have enough in common with b, if this item is the first they share.

    It is the first on one of their keys, and the bound falls from key to key, so no pair that reaches it is lost.
    """
    return F.lit(1) + F.least(size_a - rn_a, size_b - rn_b) >= F.ceil(size_a * need - F.lit(1e-9))


LARGE_BLOCK = 32  # members from which a block is compared with its leader first, and its largest component is not compared with itself
SPAN = 4  # 48-hour slots that share a block in the second pass
SUB_BLOCK = 2000  # rows of one side of a block from which it is cut, so that no group of the join holds a whole hot block
LOT_ROWS = 2_000_000  # keys of feature sets whose blocks are paired in one go; their shuffle files go before the next lot
MOST_SUBS = 8  # parts of a side at most: a row is written once for each part of the other side, so rows grow with the input only


def sub_blocks(rows: Column) -> Column:
    """How many parts a side of so many rows is cut into."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST_SUBS), F.ceil(rows / SUB_BLOCK))).cast("int")


def in_sub_blocks(rows: DataFrame, own: str, other: str, parts: Column, other_parts: Column, by: list[str]) -> DataFrame:
    """Rows of one side of a block dealt into ``parts`` (column ``own``), once for each part of the other side (column ``other``)."""
    return rows.withColumn(own, F.pmod(F.xxhash64(*by), parts).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), other_parts - 1)))


def nodes(feats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Collapse articles with equal comparison features inside one 48-hour slot.

    Two such articles are always linked (their score only falls to the linking level with a
    category mismatch, which equal features exclude) unless the title conflicts with itself, so a
    group of copies, however large, costs one node per slot. Returns (rows, nodes, sets): feature sets are
    numbered (``sig``), so that keys and pairs carry a number and not a digest.
    """
    f = F.col("f")
    conflict = (f["hold"] & (f["cut"] | f["hike"])) | (f["cut"] & f["hike"])
    alone = conflict | (F.size(f["tokens"]) == 0)
    same = F.sha2(F.to_json(F.struct(f, "part", F.when(alone, F.col("id")).alias("only"))), 256)
    keyed = cut_lineage(feats.select("id", "at_us", "pub_us", "f", "part", same.alias("same"), F.floor(F.col("at_us") / WINDOW_US).alias("slot")))
    # numbered after the checkpoint, so every reader sees the same numbers
    sets = cut_lineage(keyed.groupBy("same").agg(F.any_value("f").alias("f"), F.any_value("part").alias("part"))).withColumn("sig", F.monotonically_increasing_id())
    rows = cut_lineage(keyed.drop("f", "part").join(sets.select("same", "sig"), "same").drop("same"))
    undated = F.when(F.col("pub_us").isNull(), F.col("at_us"))
    n = rows.groupBy("sig", "slot").agg(
        F.min("id").alias("node"), F.min("at_us").alias("lo"), F.max("at_us").alias("hi"), F.min(undated).alias("u_lo"), F.max(undated).alias("u_hi")
    )
    return rows, n, sets.drop("same")


def _marks() -> list[Column]:
    """Numbers of tokens and entities, the category, whether it fits any other, and 64 bits of each entity's pieces."""
    c = F.col
    # an entity inside another has all its four-letter pieces there; one of up to three letters equals another or none
    pieces = "transform(sequence(1, greatest(length(x) - 3, 1)), i -> cast(pmod(xxhash64(substr(x, i, 4)), 64) as int))"
    names = F.expr(f"transform(f.entities, x -> aggregate({pieces}, 0L, (m, p) -> m | shiftleft(1L, p)))").alias("names")
    free = c("f.cat").isin(["", *lx.BROAD_CATEGORIES])
    # a short number for a category: equal ones of different categories only let more pairs through
    cat = F.when(c("f.cat") != "", F.pmod(F.xxhash64("f.cat"), F.lit(65_521)).cast("int"))
    return [F.size("f.tokens").alias("nt"), F.size("f.entities").alias("ne"), cat.alias("cat"), free.alias("free"), names]


def glances(sets: DataFrame) -> DataFrame:
    """(sig, g): what of a feature set tells most unlinkable pairs apart inside the join: ``_marks``, bits of token hashes and
    whether one entity holds another."""
    bits = [F.expr(f"aggregate(filter(at, p -> p div 64 = {w}), 0L, (m, p) -> m | shiftleft(1L, cast(p % 64 as int)))").alias(f"b{w}") for w in range(BIT_WORDS)]
    held = F.exists("f.entities", lambda x: F.exists("f.entities", lambda y: (x != y) & (F.length(x) > 3) & y.contains(x)))
    rows = once(sets, "at", F.transform("f.tokens", lambda w: F.pmod(F.xxhash64(w), F.lit(64 * BIT_WORDS))))
    return rows.select("sig", F.struct(*_marks(), *bits, held.alias("held")).alias("g"))


def outlines(sets: DataFrame) -> DataFrame:
    """(sig, o): ``_marks`` and a number for every token and numeric marker, in place of their texts."""
    ints = lambda c: F.array_distinct(F.transform(c, lambda w: F.hash(w)))
    return sets.select("sig", F.struct(*_marks(), ints("f.tokens").alias("tokens"), ints("f.numbers").alias("numbers")).alias("o"))


def outlines_link(pair: DataFrame, outline: DataFrame, threshold: float) -> DataFrame:
    """Pairs (sa, sb) without those whose outlines no times could link; more common tokens than there are may be counted, never fewer."""
    side = lambda p: outline.select(F.col("sig").alias(f"s{p}"), F.col("o").alias(f"g{p}"))
    both = pair.join(side("a"), "sa").join(side("b"), "sb").where(one_category(F.col("ga"), F.col("gb")))
    a, b = F.col("ga"), F.col("gb")
    equal = a["nt"] - F.size(a["tokens"])  # tokens of one number
    both = once(both, "c_most", F.least(a["nt"], b["nt"], F.size(F.array_intersect(a["tokens"], b["tokens"])) + equal))
    both = once(both, "t_most", title_bound(a, b, F.col("c_most")))
    return _entities_link(both, a, b, F.arrays_overlap(a["numbers"], b["numbers"]), threshold).select("sa", "sb")


def could_link(a: Column, b: Column, kind: Column, threshold: float, any_category: bool = False, t: Column | None = None) -> Column:
    """Whether two sets that meet on a key of a kind may link; false only if no times and entities could link them, or if the
    pair meets on a key of another kind as well.

    Tokens in one set only set different bits, which bounds the common ones. Entities: on ``o`` keys both sets hold one, the
    same; on ``e`` keys equal ones alone count; on ``g`` keys the sets differ, and if no entity of a set is inside another of
    that set, the greatest that is in one set only is nobody's smaller partner, so it does not count as common. A single common
    entity of several needs the title bound, which is on ``t`` keys. ``any_category``: pairs of categories that are not compatible count too.
    ``t``: the title bound, if it is there already.
    """
    r = min(threshold, 0.68) - 0.005 - 1e-9
    t = title_bound(a, b, common_bound(a, b)) if t is None else t
    cat = F.when(F.coalesce(a["cat"] == b["cat"], F.lit(False)), 1.0).otherwise(0.5)
    named = (a["ne"] > 0) & (b["ne"] > 0)
    none = t * 0.65 + cat * 0.20 + 0.15 >= r
    one = named & (t * 0.45 + F.when((a["ne"] == 1) & (b["ne"] == 1), 0.30).otherwise(0.15) + cat * 0.15 + 0.10 >= r)
    many = lambda e: named & (t * 0.35 + e * 0.45 + cat * 0.10 + 0.10 + 1e-9 >= r)
    nested = F.when(a["held"] | b["held"], 1.0).otherwise(1.0 - 1.0 / (a["ne"] + b["ne"]))
    fits = (
        F.when(kind == "t", (t >= bounds(threshold)[0]) & (none | one | many(F.lit(1.0)))).when(kind == "o", one)
        .when(kind == "e", many(F.least(a["ne"], b["ne"]) / F.greatest(a["ne"], b["ne"]))).when(kind == "g", many(nested)).otherwise(F.lit(True))
    )
    return fits if any_category else one_category(a, b) & fits


def one_category(a: Column, b: Column) -> Column:
    return a["free"] | b["free"] | F.coalesce(a["cat"] == b["cat"], F.lit(False))


def common_bound(a: Column, b: Column) -> Column:
    """The most tokens that can be common."""
    differ = sum((F.bit_count(a[f"b{w}"].bitwiseXOR(b[f"b{w}"])) for w in range(1, BIT_WORDS)), F.bit_count(a["b0"].bitwiseXOR(b["b0"])))
    return F.least(a["nt"], b["nt"], F.floor((a["nt"] + b["nt"] - differ) / 2))


def title_bound(a: Column, b: Column, common: Column) -> Column:
    """The most that the title similarity can be."""
    small, both = F.least(a["nt"], b["nt"]), a["nt"] + b["nt"]
    return F.when(small > 0, (common / (both - common) + common / small) / 2).otherwise(F.lit(0.0)) + F.lit(1e-9)


def may_link(met: DataFrame, threshold: float, any_category: bool = False) -> DataFrame:
    """Pairs that met on a key (``kind``, glances ``g1`` and ``g2``), without those that no times could link.

    After the glance entities are compared one by one: one that has a partner in the other set shares all pieces of the shorter of
    both, and the common ones are no more than those with a partner. Costly values are columns of their own, so that no
    condition repeats them.
    """
    a, b, t, kind = F.col("g1"), F.col("g2"), F.col("t_most"), F.col("kind")
    met = met if any_category else met.where(one_category(a, b))
    met = once(once(met, "c_most", common_bound(a, b)), "t_most", title_bound(a, b, F.col("c_most"))).where(could_link(a, b, kind, threshold, True, t))
    return _entities_link(met, a, b, kind == "n", threshold).drop("c_most", "t_most")


def _entities_link(met: DataFrame, a: Column, b: Column, sure: Column, threshold: float) -> DataFrame:
    """The part of ``may_link`` that compares entities one by one; ``t_most`` bounds the title similarity, ``sure`` pairs stay."""
    t, r = F.col("t_most"), min(threshold, 0.68) - 0.005 - 1e-9
    inside = lambda x, y: (x.bitwiseAND(y) == x) | (x.bitwiseAND(y) == y)
    partners = lambda p, q: F.size(F.filter(p["names"], lambda x: F.exists(q["names"], lambda y: inside(x, y))))
    met = once(met, "m_most", partners(a, b) + partners(b, a))
    m, cat = F.col("m_most"), F.when(F.coalesce(a["cat"] == b["cat"], F.lit(False)), 1.0).otherwise(0.5)
    none = t * 0.65 + cat * 0.20 + 0.15 >= r
    one = (m > 1) & (t * 0.45 + F.when((a["ne"] == 1) & (b["ne"] == 1), 0.30).otherwise(0.15) + cat * 0.15 + 0.10 >= r)
    many = (m > 1) & (t * 0.35 + m / (a["ne"] + b["ne"]) * 0.45 + cat * 0.10 + 0.10 + 1e-9 >= r)
    return met.where(sure | none | one | many).drop("m_most")


def node_components(rows: DataFrame, n: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, label) over all linked nodes, without pairing up whole blocks.

    Pass one compares a large block's members with one leader, which is linear in the block and
    already joins near copies. Pass two only pairs members still in different components, and
    of a block's largest component only with the others. Pairs inside one component cannot
    change the result, so none is lost. Large blocks are cut into sub-blocks on either side; places in the sets and a glance at
    tokens, entities and categories rule pairs out inside the join, so only pairs that may link are written, and what pass one
    has compared is not compared again. Pass two takes its blocks in lots, so that what it shuffles at a time does not grow with
    the archive. Probes look into the neighbouring slots; members are kept once, and a
    few slots share a block, so that a probe is repeated for few of them.
    """
    glance, outline = cut_lineage(glances(sets)), outlines(sets)
    keys = candidate_keys(sets.select("sig", "part", "f.*"), threshold)
    # equal hashes of different keys only make a block larger
    members = cut_lineage(
        keys.join(n.select("sig", "slot"), "sig").select(F.xxhash64("key").alias("key"), "kind", "sig", F.col("slot").alias("at"), "size", "probe", "rn", "need")
    )
    block = ["key", "at"]
    around = F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)).alias("at")
    lead = members.groupBy(*block).agg(F.min(F.when(F.col("probe"), F.col("sig"))).alias("l"), F.count(F.lit(1)).alias("n")).where(F.col("l").isNotNull() & (F.col("n") >= LARGE_BLOCK)).select("key", around, F.col("l").alias("s1"), F.col("at").alias("k1"))
    first = members.join(lead, block).where((F.col("sig") != F.col("s1"))).select("kind", "s1", "k1", F.col("sig").alias("s2"), F.col("at").alias("k2")).distinct()
    seen_by = lambda p: glance.select(F.col("sig").alias(f"s{p}"), F.col("g").alias(f"g{p}"))
    first = may_link(first.join(seen_by(1), "s1").join(seen_by(2), "s2"), threshold)
    seen = cut_lineage(_canonical(first))
    edges, apart = _verified(seen, rows, n, sets, outline, threshold)
    links = cut_lineage(edges.unionByName(_same_feature_links(n)).distinct())
    comp = connected_components(links)

    named = n.select("sig", F.col("slot").alias("at"), "node").join(comp.withColumnRenamed("id", "node"), "node", "left").select("sig", "at", F.coalesce("label", "node").alias("comp"))
    labelled = cut_lineage(members.join(named, ["sig", "at"]))
    lots = max(1, math.ceil(members.count() / LOT_ROWS))
    found = [cut_lineage(_second_pass(labelled.where(F.pmod("key", F.lit(lots)) == i), seen_by, threshold)) for i in range(lots)]
    second = functools.reduce(DataFrame.unionByName, found).distinct()
    second = second.join(seen, ["sa", "sb", "ka", "kb"], "left_anti").join(apart, ["sa", "sb"], "left_anti")
    more = cut_lineage(_verified(cut_lineage(second), rows, n, sets, outline, threshold)[0])
    return connected_components(links.unionByName(more)).select(F.col("id").alias("node"), "label")


def _second_pass(labelled: DataFrame, seen_by, threshold: float) -> DataFrame:
    """Distinct pairs (sa, sb, ka, kb) of whole blocks that may link: probes and members of different components."""
    span = lambda at: F.floor(at / SPAN)
    reach = F.explode(F.array_distinct(F.array(span(F.col("at") - 1), span(F.col("at") + 1)))).alias("span")
    probes = labelled.where("probe").select("key", reach, F.col("sig").alias("sig1"), F.col("at").alias("slot1"), F.col("size").alias("size1"), F.col("rn").alias("rn1"), F.col("comp").alias("comp1"), "kind", "need")
    block = ["key", "span"]
    others = labelled.select("key", span(F.col("at")).alias("span"), F.col("sig").alias("sig2"), F.col("at").alias("slot2"), F.col("size").alias("size2"), F.col("rn").alias("rn2"), F.col("comp").alias("comp2"))
    # the component with most members of a block, and whether any other takes part
    each = others.groupBy(*block, F.col("comp2").alias("comp")).agg(F.count(F.lit(1)).alias("m"), F.lit(0).cast("bigint").alias("p")).unionByName(
        probes.groupBy(*block, F.col("comp1").alias("comp")).agg(F.lit(0).cast("bigint").alias("m"), F.count(F.lit(1)).alias("p"))
    ).groupBy(*block, "comp").agg(F.sum("m").alias("m"), F.sum("p").alias("p"))
    top = each.groupBy(*block).agg(
        F.max_by("comp", F.struct(F.col("m") + F.col("p"), F.col("comp"))).alias("top"), F.count(F.lit(1)).alias("k"), F.sum("m").alias("m"), F.sum("p").alias("p"),
    ).where("k > 1 AND m > 0 AND p > 0").select(*block, "top", sub_blocks(F.col("p")).alias("parts1"), sub_blocks(F.col("m")).alias("parts2"), (F.greatest("m", "p") >= LARGE_BLOCK).alias("large"))
    top = cut_lineage(top)
    # of a large block, members of the largest component (lot 0) meet only probes of the others
    lots = {1: F.when(F.col("large") & (F.col("comp1") != F.col("top")), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))),
            2: F.array(F.when(F.col("large") & (F.col("comp2") == F.col("top")), F.lit(0)).otherwise(F.lit(1)))}
    deal = lambda side, d, e, own, other: in_sub_blocks(
        side.join(top, block).withColumn("lot", F.explode(lots[d])).drop("top", "large").join(seen_by(d).withColumnRenamed(f"s{d}", f"sig{d}"), f"sig{d}"),
        own, other, F.col(f"parts{d}"), F.col(f"parts{e}"), [f"sig{d}", f"slot{d}"],
    ).drop("parts1", "parts2")
    left, right = deal(probes, 1, 2, "i", "j"), deal(others, 2, 1, "j", "i")
    fits = (F.abs(F.col("slot1") - F.col("slot2")) <= 1) & (F.col("comp1") != F.col("comp2")) & (F.col("sig1") != F.col("sig2")) & (F.col("size1") <= F.col("size2")) & within_reach(F.col("size1"), F.col("rn1"), F.col("size2"), F.col("rn2"), F.col("need"))
    both = may_link(left.join(right, [*block, "i", "j", "lot"]).where(fits), threshold)
    return _canonical(both.select(F.col("sig1").alias("s1"), F.col("slot1").alias("k1"), F.col("sig2").alias("s2"), F.col("slot2").alias("k2")))


def _canonical(found: DataFrame) -> DataFrame:
    """Distinct pairs of feature sets and slots, the smaller set first."""
    swap = F.col("s1") < F.col("s2")
    return found.select(
        F.least("s1", "s2").alias("sa"), F.greatest("s1", "s2").alias("sb"), F.when(swap, F.col("k1")).otherwise(F.col("k2")).alias("ka"),
        F.when(swap, F.col("k2")).otherwise(F.col("k1")).alias("kb"),
    ).distinct()


def _verified(pair: DataFrame, rows: DataFrame, n: DataFrame, sets: DataFrame, outline: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(edges (u, v) between nodes that hold at least one linked pair of articles, pairs (sa, sb) that no time can link)."""
    # score each pair of feature sets once, whatever the number of slots it meets in
    uniq = pair.select("sa", "sb").distinct()
    small = is_small(sets, rows=FEATURE_ROWS)
    likely = uniq if small else outlines_link(uniq, outline, threshold)  # features travel with few pairs

    def fs(p):
        side = sets.select(F.col("sig").alias(f"s{p}"), F.col("f").alias(f"f{p}"))
        return F.broadcast(side) if small else side

    both = likely.join(fs("a"), "sa").join(fs("b"), "sb").where(compatible(F.col("fa.cat"), F.col("fb.cat")))
    # titles and numbers rule most pairs out before entities are compared
    title, _, t1 = bounds(threshold)
    least = min(t1, (min(threshold, 0.68) - 0.005 - 1e-9 - 0.65) / 0.35)
    numbers = F.arrays_overlap("fa.numbers", "fb.numbers")
    named = (F.size("fa.entities") > 0) & (F.size("fb.entities") > 0)
    both = once(both, "t", title_similarity(F.col("fa.tokens"), F.col("fb.tokens")))
    both = both.where(numbers | (F.col("t") >= title - 1e-9) | (named & (F.col("t") >= least - 1e-9))).drop("t")
    scored = once(both, "s", static_score(F.col("fa"), F.col("fb"))).select("sa", "sb", "s").where(is_edge(F.col("s"), F.lit(1.0), threshold))
    scored = cut_lineage(scored.select("sa", "sb", "s", is_edge(F.col("s"), F.lit(0.0), threshold).alias("always")))
    apart = uniq.join(scored, ["sa", "sb"], "left_anti")
    side = lambda p: n.select(F.col("sig").alias(f"s{p}"), F.col("slot").alias(f"k{p}"), *[F.col(c).alias(f"{c}_{p}") for c in ("node", "lo", "hi", "u_lo", "u_hi")])
    met = pair.join(scored, ["sa", "sb"]).join(side("a"), ["sa", "ka"]).join(side("b"), ["sb", "kb"])

    def near(lo_a, hi_a, lo_b, hi_b):
        """Some instant of one range is within the window of the other, for ranges inside their slots."""
        c = F.col
        return F.coalesce(
            F.when(c("ka") == c("kb"), c(lo_a).isNotNull() & c(lo_b).isNotNull())
            .when(c("ka") < c("kb"), c(lo_b) - c(hi_a) <= WINDOW_US)
            .otherwise(c(lo_a) - c(hi_b) <= WINDOW_US),
            F.lit(False),
        )

    touching = near("lo_a", "hi_a", "lo_b", "hi_b")
    untimed = near("u_lo_a", "u_hi_a", "lo_b", "hi_b") | near("lo_a", "hi_a", "u_lo_b", "u_hi_b")
    met = cut_lineage(met.where(touching).withColumn("sure", F.col("always") | untimed))
    direct = met.where("sure").select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))
    return direct.unionByName(_timed_links(rows, met.where(~F.col("sure")), threshold)).distinct(), apart


def _same_feature_links(n: DataFrame) -> DataFrame:
    """A node and the next slot's node of the same features, when their nearest articles are within 48 hours."""
    nxt = n.select("sig", (F.col("slot") - 1).alias("slot"), F.col("node").alias("v"), F.col("lo").alias("lo2"))
    return n.join(nxt, ["sig", "slot"]).where(F.col("lo2") - F.col("hi") <= WINDOW_US).select(F.col("node").alias("u"), "v")


def _timed_links(rows: DataFrame, met: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes whose link depends on the time gap: the smallest gap decides.

    The instants of both nodes are merged in time order and each looks back at the other side.
    """
    dated = rows.where(F.col("pub_us").isNotNull()).select("sig", "slot", "at_us").distinct()
    pick = lambda p, side: met.join(
        dated.select(F.col("sig").alias(f"s{p}"), F.col("slot").alias(f"k{p}"), "at_us"), [f"s{p}", f"k{p}"]
    ).select("node_a", "node_b", "s", "at_us", F.lit(side).alias("side"))
    line = Window.partitionBy("node_a", "node_b").orderBy("at_us", "side").rowsBetween(Window.unboundedPreceding, -1)
    both = pick("a", 0).unionByName(pick("b", 1))
    last = lambda side: F.last(F.when(F.col("side") == side, F.col("at_us")), ignorenulls=True).over(line)
    gap = F.col("at_us") - F.when(F.col("side") == 0, last(1)).otherwise(last(0))
    best = both.withColumn("gap", gap).groupBy("node_a", "node_b").agg(F.min("gap").alias("gap"), F.any_value("s").alias("s"))
    temp = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("gap") / F.lit(3600000000.0) / F.lit(48.0))
    ok = (F.col("gap") <= WINDOW_US) & is_edge(F.col("s"), temp, threshold)
    return best.where(ok).select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))


# --- fixed values: words that mark one running story ---
EVENT_MARKERS = ["fed", "ecb", "oil", "china"]


def near_neighbours(ranked: DataFrame, reach: int = 40, shared: int = 3) -> DataFrame:
    """Candidate duplicates among time neighbours: fewer than ``reach`` places apart, within 48 hours,
    with enough shared words or one shared marker. Blocks of ``reach`` ranks meet themselves and the next."""
    low = F.lower("title")
    rows = ranked.select(
        "id", "pub_us", "rank", F.floor(F.col("rank") / reach).alias("block"), F.array_distinct(text.words(low)).alias("w"),
        F.array_compact(F.array(*[F.when(low.contains(m), F.lit(m)) for m in EVENT_MARKERS])).alias("m"),
    )
    left = rows.select(*[F.col(c).alias(f"x_{c}") for c in rows.columns], F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"))
    j = left.join(rows, "block").where((F.col("rank") > F.col("x_rank")) & (F.col("rank") < F.col("x_rank") + reach))
    near = F.coalesce(F.abs(F.col("x_pub_us") - F.col("pub_us")) <= WINDOW_US, F.lit(True))
    common = F.size(F.array_intersect("x_w", "w"))
    return j.where(near & ((common >= shared) | F.arrays_overlap("x_m", "m"))).select(F.col("x_id").alias("a"), F.col("id").alias("b"), common.alias("common"))
