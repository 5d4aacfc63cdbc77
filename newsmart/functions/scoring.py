"""Scores, sections, states and reasons as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions.numbers import clamp, fixed, round_half_up
from newsmart.functions.text import WORD, contains_any, str_map, strip


def as_text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def resolve_category(annotated: Column, own: Column, title: Column, source: Column) -> Column:
    """Annotation, article, title keywords (substring), source, General."""
    low = F.lower(as_text(title))
    keyword = F.lit(None).cast("string")
    for name, terms in reversed(lx.TITLE_CATEGORY_TERMS):
        keyword = F.when(contains_any(low, terms), F.lit(name)).otherwise(keyword)
    return F.coalesce(
        F.when(annotated != "", strip(annotated)), F.when(own != "", strip(own)), keyword,
        F.when(source != "", strip(source)), F.lit("General"),
    )


def event_section(category: Column) -> Column:
    return F.coalesce(F.element_at(str_map(lx.EVENT_SECTIONS), F.lower(strip(category))), F.lit("WORLD"))


def edition_section(category: Column) -> Column:
    return F.coalesce(F.element_at(str_map(lx.EDITION_SECTIONS), F.lower(category)), F.lit("World Watch"))


def feed_sections(category: Column) -> Column:
    """Matching feed sections in order: the exact one, else every whole-word match."""
    c = F.lower(as_text(category))
    exact = F.element_at(str_map(dict(lx.FEED_SECTIONS)), c)
    matches = F.array_compact(
        F.array(*[F.when(c.rlike(rf"(^|[^{WORD}]){k}($|[^{WORD}])"), F.lit(s)) for k, s in lx.FEED_SECTIONS])
    )
    return F.when(exact.isNotNull(), F.array(exact)).otherwise(F.array_distinct(matches))


def editorial_score(
    importance: Column, source_type: Column, trust: Column, hours_old: Column, category: Column, n_sources: Column
) -> Column:
    """0-100 article score with its five parts."""
    imp = round_half_up(F.coalesce(importance.cast("double"), F.lit(70.0)) / F.lit(100.0) * F.lit(35.0), 1)
    stype, tier = F.coalesce(source_type, F.lit("rss")), F.coalesce(trust, F.lit("useful"))
    src = (
        F.when(stype.isin(lx.OFFICIAL_SOURCE_TYPES), F.lit(15.0))
        .when((tier == "core") | (stype == "INSTITUTIONAL_RESEARCH"), F.lit(12.0))
        .when(tier == "useful", F.lit(9.0))
        .otherwise(F.lit(6.0))
    )
    aged = F.lit(15.0) - F.greatest(F.lit(0.0), hours_old) * F.lit(0.5)
    rec = F.coalesce(round_half_up(F.when(hours_old.isNotNull(), F.greatest(F.lit(0.0), aged)), 1), F.lit(5.05))
    strat = F.when(contains_any(F.lower(as_text(category)), lx.STRATEGIC_TERMS), F.lit(20.0)).otherwise(F.lit(12.0))
    cor = corroboration_bonus(n_sources)
    total = round_half_up(F.least(F.lit(100.0), imp + src + rec + strat + cor), 1)
    return F.struct(
        imp.alias("importance_pts"), src.alias("source_pts"), rec.alias("recency_pts"),
        strat.alias("strategic_pts"), cor.alias("corroboration_pts"), total.alias("total"),
    )


def corroboration_bonus(n_sources: Column) -> Column:
    return F.least(F.lit(15.0), F.greatest(F.lit(0), n_sources - 1) * F.lit(5.0))


def edition_score(
    relevance: Column, importance: Column, age_hours: Column, trust: Column, source_count: Column, country_count: Column
) -> Column:
    """Weighted edition score and its parts; counts are those already selected."""
    w = lx.EDITION_WEIGHTS
    rel = clamp(F.coalesce(relevance.cast("double"), F.lit(70.0)) / F.lit(100.0), 0.0, 1.0)
    imp = clamp(F.coalesce(importance.cast("double"), F.lit(50.0)) / F.lit(100.0), 0.0, 1.0)
    rec = F.greatest(F.lit(0.0), F.lit(1.0) - F.greatest(F.lit(0.0), age_hours) / F.lit(36.0))
    tier = F.lower(F.coalesce(trust, F.lit("useful")))
    tru = F.coalesce(F.element_at(str_map(lx.EDITION_TRUST), tier), F.lit(0.5))
    div = F.when(source_count == 0, F.lit(1.0)).when(source_count == 1, F.lit(0.5)).otherwise(F.lit(0.0))
    geo = F.when(country_count == 0, F.lit(1.0)).when(country_count == 1, F.lit(0.5)).otherwise(F.lit(0.2))
    total = (
        F.lit(w["relevance"]) * rel + F.lit(w["importance"]) * imp + F.lit(w["recency"]) * rec
        + F.lit(w["trust"]) * tru + F.lit(w["source"]) * div + F.lit(w["geo"]) * geo
    ) * F.lit(100.0)
    return F.struct(
        round_half_up(total, 2).alias("score"),
        round_half_up(rec, 3).alias("recency_comp"),
        tru.alias("trust_comp"),
        F.coalesce(relevance, F.lit(70)).cast("int").alias("raw_relevance"),
        F.coalesce(importance, F.lit(50)).cast("int").alias("raw_importance"),
        round_half_up(F.greatest(F.lit(0.0), age_hours), 1).alias("age_hours"),
        tier.alias("trust_tier"),
    )


def selection_reason(s: Column) -> Column:
    """Readable reason from the parts of ``edition_score``."""
    rel, imp, age, tier = s["raw_relevance"], s["raw_importance"], s["age_hours"], s["trust_tier"]
    parts = F.array_compact(
        F.array(
            F.when(rel >= 85, F.format_string("High relevance (%d)", rel)).when(rel >= 70, F.format_string("Relevant (%d)", rel)),
            F.when(imp >= 80, F.format_string("High importance (%d)", imp)).when(
                imp >= 65, F.format_string("Notable importance (%d)", imp)
            ),
            F.when(tier.isin("institutional", "primary"), F.lit("Institutional source")).when(
                tier.isin("useful", "specialist"), F.lit("Specialist source")
            ),
            F.when(age <= 6, F.concat(F.lit("Recent ("), fixed(age, 1), F.lit("h ago)"))).when(age <= 18, F.lit("Fresh story")),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(F.concat(F.lit("Score "), fixed(round_half_up(s["score"], 1), 1)))


def whole_words(patterns) -> str:
    """Case-insensitive whole-word test for any pattern, with Unicode word edges."""
    return rf"(?i)(?:^|[^{WORD}])(?:{'|'.join(patterns)})(?:$|[^{WORD}])"


def _matched(text: Column, patterns, n: int) -> Column:
    """Labels of the first n matching patterns; one alternation guards the detailed tests."""
    hits = F.array_compact(
        F.array(*[F.when(text.rlike(whole_words([p])), F.lit(p.replace("(?:s)?", ""))) for p in patterns])
    )
    return F.when(text.rlike(whole_words(patterns)), F.slice(hits, 1, n)).otherwise(F.array().cast("array<string>"))


def queue_priority(
    trust: Column, family: Column, category: Column, title: Column, summary: Column, waiting_hours: Column,
    reasons: bool = True,
) -> Column:
    """Queue score, ageing bonus and tier; ``reasons`` adds the explanation list."""
    text = F.concat(as_text(title), F.lit(" "), as_text(summary))
    tier, fam = F.lower(F.coalesce(trust, F.lit("useful"))), F.lower(F.coalesce(family, F.lit("news")))
    t_pts = F.coalesce(F.element_at(str_map(lx.PRIORITY_TRUST), tier), F.lit(5))
    f_pts = F.coalesce(F.element_at(str_map(lx.PRIORITY_FAMILY), fam), F.lit(5))
    c_pts = F.when(category.isNull(), F.lit(0)).otherwise(
        F.coalesce(F.element_at(str_map(lx.PRIORITY_CATEGORY), category), F.lit(5))
    )
    low, crit = text.rlike(whole_words(lx.LOW_KEYWORDS)), text.rlike(whole_words(lx.CRITICAL_KEYWORDS))
    high, norm = text.rlike(whole_words(lx.HIGH_KEYWORDS)), text.rlike(whole_words(lx.NORMAL_KEYWORDS))
    k_pts = F.when(low, F.lit(-30)).otherwise(F.lit(0)) + (
        F.when(crit, F.lit(25)).when(high, F.lit(15)).when(norm, F.lit(8)).otherwise(F.lit(0))
    )
    base = F.greatest(F.lit(0), F.least(F.lit(100), t_pts + f_pts + c_pts + k_pts)).cast("int")
    wait = F.greatest(F.lit(0.0), waiting_hours)
    bonus = F.least(F.lit(50.0), wait * F.lit(2.0))
    eff = F.least(F.lit(100.0), base + bonus)
    level = (
        F.when(eff >= 80, F.lit("P0_CRITICAL")).when(eff >= 60, F.lit("P1_HIGH"))
        .when(eff >= 35, F.lit("P2_NORMAL")).otherwise(F.lit("P3_LOW"))
    )
    fields = [
        base.alias("base_score"), round_half_up(bonus, 2).alias("aging_bonus"),
        round_half_up(eff, 2).alias("effective_score"), level.alias("priority_tier"),
    ]
    if reasons:
        def keyword_reason(flag, patterns, n, label, pts):
            return F.when(flag, F.concat(F.lit(label), F.array_join(_matched(text, patterns, n), ", "), F.lit(f" ({pts})")))

        fields.append(
            F.array_compact(
                F.array(
                    F.concat(F.lit("Trust tier '"), tier, F.lit("' (+"), t_pts.cast("string"), F.lit(")")),
                    F.concat(F.lit("Source family '"), fam, F.lit("' (+"), f_pts.cast("string"), F.lit(")")),
                    F.concat(F.lit("Category '"), category, F.lit("' (+"), c_pts.cast("string"), F.lit(")")),
                    keyword_reason(low, lx.LOW_KEYWORDS, 2, "Low priority material match: ", "-30"),
                    keyword_reason(crit, lx.CRITICAL_KEYWORDS, 3, "Critical keyword match: ", "+25"),
                    keyword_reason(high & ~crit, lx.HIGH_KEYWORDS, 3, "High strategic keyword match: ", "+15"),
                    keyword_reason(norm & ~crit & ~high, lx.NORMAL_KEYWORDS, 3, "Strategic keyword match: ", "+8"),
                    F.when(
                        bonus > 0.5,
                        F.concat(F.lit("Aging bonus: "), fixed(round_half_up(wait, 1), 1), F.lit("h in queue (+"),
                                 fixed(round_half_up(bonus, 1), 1), F.lit(" pts)")),
                    ),
                )
            ).alias("reasons")
        )
    return F.struct(*fields)


def lead_significance(score: Column, n_sources: Column, section: Column, source_type: Column, importance: Column) -> Column:
    domain = F.when(section.isin("ECONOMY", "WORLD", "ENERGY", "TRADE"), F.lit(10.0)).when(
        source_type.isin("CENTRAL_BANK", "GOVERNMENT"), F.lit(15.0)
    ).otherwise(F.lit(0.0))
    imp = F.when(importance.isNull() | (importance == 0), F.lit(50)).otherwise(importance)
    return round_half_up(
        score + F.when(n_sources >= 2, F.lit(10.0)).otherwise(F.lit(0.0)) + domain
        + F.when(imp >= 80, F.lit(5.0)).otherwise(F.lit(0.0)),
        1,
    )


def source_status(
    active: Column, source_type: Column, feed_url: Column, collection: Column, items: Column, newest: Column,
    as_of: Column, stale_days: int = 7,
) -> Column:
    feed = F.lower(F.coalesce(source_type, F.lit("rss"))).isin(lx.FEED_SOURCE_TYPES)
    return (
        F.when(~active, F.lit("DISABLED"))
        .when(~feed | F.coalesce(feed_url, F.lit("")).eqNullSafe(F.lit("")), F.lit("FAILED"))
        .when(collection.isin("FAILED", "UNKNOWN_TYPE"), F.lit("FAILED"))
        .when((collection == "EMPTY") | (items == 0), F.lit("EMPTY"))
        .when(newest < as_of - F.expr(f"INTERVAL {stale_days} DAYS"), F.lit("STALE"))
        .otherwise(F.lit("HEALTHY"))
    )


def density_band(n: Column) -> Column:
    return (
        F.when(n >= 20, F.lit("20+")).when(n >= 10, F.lit("10-19")).when(n >= 5, F.lit("5-9"))
        .when(n >= 1, F.lit("1-4")).otherwise(F.lit("0"))
    )


def annotation_issues(is_relevant: Column, category: Column, importance: Column, relevance: Column) -> Column:
    """Validation errors of one structured annotation; empty means valid."""
    known = F.lower(strip(as_text(category))).isin([c.lower() for c in lx.CATEGORIES])

    def bad_range(c: Column, name: str) -> Column:
        return F.when((c < 0) | (c > 100), F.lit(f"{name} out of range"))

    return F.array_compact(
        F.array(
            F.when(is_relevant.isNull(), F.lit("is_relevant missing")),
            bad_range(importance, "importance_score"),
            bad_range(relevance, "relevance_score"),
            F.when(is_relevant & (strip(as_text(category)) == ""), F.lit("primary_category required")),
            F.when(is_relevant & (strip(as_text(category)) != "") & ~known, F.lit("primary_category unknown")),
        )
    )


def canonical_category(is_relevant: Column, category: Column) -> Column:
    """The listed spelling of a relevant annotation's category; null out of scope or when unknown."""
    known = str_map({c.lower(): c for c in lx.CATEGORIES})
    return F.when(is_relevant, F.try_element_at(known, F.lower(strip(as_text(category)))))


def rejection_text(is_relevant: Column, reason: Column) -> Column:
    """The given reason of an annotation out of scope, else the standard one; null when relevant."""
    given = strip(as_text(reason))
    return F.when(~is_relevant, F.when(given != "", given).otherwise(F.lit(lx.OUT_OF_SCOPE)))


def job_state(status: Column, processed: Column, as_of: Column, cooldown_s: int = 300, stale_s: int = 900) -> Column:
    """What one annotation row means for a retry decision at ``as_of``."""
    old = lambda s: processed < as_of - F.expr(f"INTERVAL {s} SECONDS")
    return (
        F.when(status.isin(lx.FINAL_STATUSES), F.lit("COMPLETED"))
        .when(status == "invalid_json", F.lit("NON_RETRYABLE"))
        .when(status == "processing", F.when(old(stale_s), F.lit("STALE")).otherwise(F.lit("PROCESSING")))
        .when(status.isin(lx.RETRYABLE_STATUSES), F.when(old(cooldown_s), F.lit("RETRYABLE")).otherwise(F.lit("COOLDOWN")))
        .otherwise(F.lit("OTHER"))
    )
