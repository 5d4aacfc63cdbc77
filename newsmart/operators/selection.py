"""Constrained selection: eligibility, ordered folds with caps, roles and readiness."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmart.functions import dates, scoring
from newsmart.operators import clusters, pairs
from newsmart.operators.annotations import out_of_scope, pick_annotation
from newsmart.operators.joins import with_source
from newsmart.session import cut_lineage

CHUNK = 512  # rows of a group folded at a time; further rows follow in the next round


def eligible(articles: DataFrame, sources: DataFrame, annotations: DataFrame, as_of: Column) -> DataFrame:
    """Titled, linked, not future, from an active or unknown source, relevant and in scope."""
    rows = articles.where((F.col("title") != "") & (F.col("canonical_url") != "") & (F.coalesce("published_at", "collected_at") <= as_of))
    rows = with_source(rows, sources, ["active"]).where(F.coalesce("source_active", F.lit(True))).drop("source_active")
    good = annotations.where((F.col("status") == "success") & F.col("is_relevant")).select(F.col("article_id").alias("id")).distinct()
    bad = out_of_scope(annotations).withColumnRenamed("article_id", "id")
    return rows.join(good, "id", "left_semi").join(bad, "id", "left_anti")


def edition_windows(articles: DataFrame, part: str = "edition_date") -> DataFrame:
    """(edition, id): each article in every edition whose 48-hour window holds it."""
    at = F.coalesce("published_at", "collected_at")
    day = F.explode(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.date_add(dates.local_date(at), k)))
    rows = articles.withColumn(part, day)
    lo, hi = dates.window_48h(F.col(part))
    return rows.where((at >= lo) & (at <= hi))


@dataclass(frozen=True)
class Cap:
    """At most ``most`` rows with one value of ``field`` are taken per group. A null value is never capped."""

    reason: str
    field: str
    most: int


def capped_selection(
    rows: DataFrame, group: str, order: Column, item: Column, limit: int, caps: list[Cap], unfit: list[tuple[str, Callable[[Column], Column]]] = (),
    alike: tuple[str, Callable[[Column, Column], Column]] | None = None, chunk: int = CHUNK,
) -> DataFrame:
    """Greedy pass in ``order`` within every group until ``limit`` rows are taken: (group, ord, outcome, item).

    A row is refused if it is ``unfit``, if a value of it has reached its cap, or if it is ``alike`` a taken row; the first
    that holds at its turn is its outcome. What refuses a row never goes away, so rows are refused ahead of their turn:
    each round folds the first ``chunk`` open rows of every group, then closes, in one pass over all rows wherever they are,
    those of values that became full and those like a row just taken. The first open row is always taken, so there
    are at most ``limit`` rounds, however many rows a group has. The outcome of a refused row follows in one last pass from
    the places at which values became full. No group is gathered; state is at most ``limit`` rows of each group.
    """
    base = cut_lineage(rows.select(group, order.alias("ord"), item.alias("item")))
    x = F.col("item")
    bad = [(reason, F.coalesce(test(x), F.lit(False))) for reason, test in unfit]
    open_ = base.where(~functools.reduce(lambda a, b: a | b, [c for _, c in bad], F.lit(False)))
    state, picked = None, None
    while True:
        done = cut_lineage(_fold(open_, state, group, limit, caps, alike[1] if alike else None, chunk))
        new = done.select(group, F.explode("fresh").alias("r")).select(group, "r.*")
        picked = new if picked is None else picked.unionByName(new)
        state = done.where((F.col("n") == chunk) & (F.size("taken") < limit)).drop("n")
        if state.isEmpty():
            break
        full = [count_same(F.col("taken"), c.field, x[c.field]) >= c.most for c in caps]
        like = [F.exists("fresh", lambda t: alike[1](x, t["item"]))] if alike else []
        refused = functools.reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in full + like], F.lit(False))
        open_ = cut_lineage(open_.join(state, group).where((F.col("ord") > F.col("last")) & ~refused).select(group, "ord", "item"))
        if open_.isEmpty():
            break
    return _outcomes(base, cut_lineage(picked), group, limit, caps, bad, alike[0] if alike else None)


def _fold(open_: DataFrame, state: DataFrame | None, group: str, limit: int, caps: list[Cap], alike, chunk: int) -> DataFrame:
    """group, n, last, taken (items so far), fresh (ord and item of what this round took) of the first open rows."""
    kind, key = open_.schema["item"].dataType.simpleString(), open_.schema["ord"].dataType.simpleString()
    head = open_.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy("ord"))).where(F.col("rn") <= chunk)
    g = head.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("ord", "item"))).alias("rows"))
    g = g.withColumn("taken", F.array().cast(f"array<{kind}>")) if state is None else g.join(state.select(group, "taken"), group)

    def step(acc, r):
        no = functools.reduce(lambda a, b: a | b, [count_same(acc["taken"], c.field, r["item"][c.field]) >= c.most for c in caps], F.size(acc["taken"]) >= limit)
        if alike:
            no = no | F.exists(acc["fresh"], lambda t: alike(r["item"], t["item"]))
        no = F.coalesce(no, F.lit(False))
        return F.when(no, acc).otherwise(F.struct(F.concat(acc["taken"], F.array(r["item"])).alias("taken"), F.concat(acc["fresh"], F.array(r)).alias("fresh")))

    start = F.struct(F.col("taken"), F.array().cast(f"array<struct<ord:{key},item:{kind}>>").alias("fresh"))
    folded = g.select(group, F.size("rows").alias("n"), F.element_at("rows", -1)["ord"].alias("last"), F.aggregate("rows", start, step).alias("acc"))
    return folded.select(group, "n", "last", "acc.taken", "acc.fresh")


def _outcomes(base: DataFrame, picked: DataFrame, group: str, limit: int, caps: list[Cap], bad: list[tuple[str, Column]], like: str | None) -> DataFrame:
    """Every row up to the one that fills its group, with SELECTED or what refused it."""
    nth = lambda *keys: F.row_number().over(Window.partitionBy(group, *keys).orderBy("ord"))
    end = picked.withColumn("_k", nth()).where(F.col("_k") == limit).select(group, F.col("ord").alias("_end"))
    out = base.join(end, group, "left").where(F.col("_end").isNull() | (F.col("ord") <= F.col("_end")))
    out = out.join(picked.select(group, "ord", F.lit(True).alias("_taken")), [group, "ord"], "left")
    why = F.when(F.col("_taken"), F.lit("SELECTED"))
    for reason, test in bad:
        why = why.when(test, F.lit(reason))
    for i, c in enumerate(caps):
        value, at = f"_value{i}", f"_full{i}"
        full = picked.withColumn(value, F.col("item")[c.field]).withColumn("_k", nth(value)).where(F.col("_k") == c.most)
        out = out.withColumn(value, F.col("item")[c.field]).join(full.where(F.col(value).isNotNull()).select(group, value, F.col("ord").alias(at)), [group, value], "left")
        why = why.when(F.col(at) < F.col("ord"), F.lit(c.reason))
    return out.select(group, "ord", (why.otherwise(F.lit(like)) if like else why).alias("outcome"), "item")


def count_same(taken: Column, field: str, value: Column) -> Column:
    return F.size(F.filter(taken, lambda t: t[field] == value))


def edition_clusters(articles: DataFrame, sources: DataFrame, annotations: DataFrame, as_of: Column, threshold: float = 0.68) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) of every edition's eligible articles, all editions in one run."""
    ok = eligible(articles, sources, annotations, as_of)
    placed = cut_lineage(edition_windows(ok).select("id", "edition_date"))
    feats = pairs.by_part(pairs.features(ok, sources, annotations), placed, "edition_date")
    labels = clusters.assign(feats, threshold)
    members = cut_lineage(labels.select(F.col("id.part").alias("edition_date"), F.col("id.id").alias("id"), F.col("label.id").alias("label")))
    keys = ["edition_date", "label"]
    scored = clusters.scored_members(articles, members, sources, annotations, as_of, keys)
    c = clusters.summarise(scored, keys).join(clusters.fingerprint(members, keys), keys)
    return c.withColumn("section", scoring.event_section(F.col("category"))), members


def select_events(
    cl: DataFrame, plain: DataFrame, min_quality: float = 50.0, size: int = 20, per_source: int = 2, section_share: float = 0.30,
    duplicate: float = 0.55,
) -> DataFrame:
    """Every visited cluster of each edition with SELECTED or the first cap it hit.

    ``plain`` are features without annotation entities, for the duplicate safety check.
    """
    section_cap = max(1, int(size * section_share))
    f = plain.select(F.col("id").alias("primary_id"), "pub_us", "f")
    imp = F.when(F.coalesce("primary_importance", F.lit(0)) == 0, F.lit(50)).otherwise(F.col("primary_importance"))
    order = F.struct((-F.col("cluster_score")).alias("s"), (-imp).alias("i"), (-F.unix_micros("latest_at")).alias("t"), F.col("primary_id").alias("p"))
    item = F.struct(
        F.col("cluster_id"), F.col("primary_id"), F.col("primary_source_id").alias("source"), "section", F.col("cluster_score").alias("score"),
        F.col("article_count").alias("n"), "distinct_source_count", "primary_source_type", "primary_importance", "pub_us", "f",
    )

    def alike(x, t):
        return pairs.final_score(pairs.static_score(x["f"], t["f"]), pairs.proximity(x["pub_us"], t["pub_us"])) >= duplicate

    return capped_selection(
        cl.join(f, "primary_id"), "edition_date", order, item, size,
        caps=[Cap("SOURCE_CAP", "source", per_source), Cap("SECTION_CAP", "section", section_cap)],
        unfit=[("QUALITY_THRESHOLD", lambda x: x["score"] < min_quality)],
        alike=("DUPLICATE_SAFETY", lambda x, t: (x["n"] == 1) & alike(x, t)),
    )


def with_roles(decisions: DataFrame, lead_quality: float = 70.0) -> DataFrame:
    """Selected events with position and role; at most the edition size per edition, so its window is small."""
    sel = decisions.where(F.col("outcome") == "SELECTED").select("edition_date", "ord", "item.*").drop("f", "pub_us")
    ed = Window.partitionBy("edition_date")
    sig = scoring.lead_significance(
        F.col("score"), F.col("distinct_source_count"), F.col("section"), F.col("primary_source_type"), F.col("primary_importance")
    )
    x = sel.withColumn("position", F.row_number().over(ed.orderBy("ord"))).withColumn("significance", sig)
    good = F.when(F.col("score") >= lead_quality, F.struct(F.col("significance"), (-F.col("position")).alias("first")))
    x = x.withColumn("lead", -F.max(good).over(ed)["first"])
    idx, has = F.col("position") - 1, F.col("lead").isNotNull()
    role = F.when(F.col("position") == F.col("lead"), F.lit("LEAD")).when((has & (idx < 4)) | (~has & (idx < 5)), F.lit("TOP")).otherwise(F.lit("SECTION"))
    return x.withColumn("role", role).drop("lead", "ord")


def audit(decisions: DataFrame, cl: DataFrame, members: DataFrame, min_size: int = 10) -> DataFrame:
    """Candidate, selection and rejection counts and readiness per edition."""
    a = members.groupBy("edition_date").agg(F.count(F.lit(1)).alias("candidate_articles"))
    c = cl.groupBy("edition_date").agg(F.count(F.lit(1)).alias("candidate_events"))
    n = lambda s: F.count_if(F.col("outcome") == s)
    d = decisions.groupBy("edition_date").agg(
        n("SELECTED").alias("selected"), n("QUALITY_THRESHOLD").alias("below_quality"), n("SOURCE_CAP").alias("source_cap"),
        n("SECTION_CAP").alias("section_cap"), n("DUPLICATE_SAFETY").alias("duplicate_safety"),
    )
    return a.join(c, "edition_date").join(d, "edition_date").withColumn(
        "readiness", F.when(F.col("selected") >= min_size, F.lit("READY")).otherwise(F.lit("PREPARING"))
    )
