"""Feeds, summaries, pages, archive counts and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions import dates
from newsmart.functions.numbers import round_half_up
from newsmart.operators import annotations as ann
from newsmart.operators import archive, feeds, queue, saved
from newsmart.operators.joins import with_source
from newsmart.operators.windows import global_rank, nearest_rank
from newsmart.plans import sqltext as s
from newsmart.plans.registry import query
from newsmart.plans.scalars import AS_OF, PRIORITY_SQL, TIER_SQL, joined, prioritised, stamp

NOW = f"TIMESTAMP '{AS_OF}'"
DAY = "DATE '2024-01-28'"
LO, HI = s.to_utc(f"CAST({DAY} AS TIMESTAMP)"), s.to_utc(f"CAST({DAY} + 1 AS TIMESTAMP)")


def as_of():
    return dates.ts(AS_OF)


_pubtoday = f"published_at >= {LO} AND published_at < {HI} AND published_at <= {NOW}"


@query("E1 C2", f"""
SELECT (SELECT count(*) FROM article) AS total_archive, (SELECT count(*) FROM article WHERE {_pubtoday}) AS today_articles,
  (SELECT count(*) FROM source_dim WHERE active) AS active_sources""")
def archive_counters(t):
    return archive.counters(t.articles(), t.sources(), as_of())


@query("E2", """
SELECT category, row_number() OVER (ORDER BY CASE category WHEN 'AI' THEN 0 WHEN 'Markets' THEN 1 WHEN 'Geopolitics' THEN 2 ELSE 3 END, category) AS position
FROM (SELECT DISTINCT category FROM source_dim WHERE active AND category IS NOT NULL)""")
def category_list(t):
    return feeds.categories_in_order(t.sources())


_oos = "(SELECT article_id FROM latest_any WHERE is_relevant = false)"
_div = """
 q AS (SELECT *, row_number() OVER (PARTITION BY {part} coalesce(source_id, 0) ORDER BY ord) > 2 AS over FROM k),
 z AS (SELECT *, row_number() OVER ({bypart} ORDER BY over, ord) AS position FROM q)"""


@query("E3 W2 D1 C3", f"""
WITH a AS (SELECT a.*, s.category AS cat FROM article a JOIN source_dim s ON s.id = a.source_id
  WHERE s.category IS NOT NULL AND (published_at IS NULL OR published_at <= {NOW})),
 c AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY eff_at DESC, id DESC) AS ord FROM a),
 k AS (SELECT * FROM c WHERE ord <= 12 AND id NOT IN {_oos}), {_div.format(part='cat,', bypart='PARTITION BY cat')},
 l AS (SELECT category, row_number() OVER (ORDER BY CASE category WHEN 'Geopolitics' THEN 2 ELSE 3 END, category) AS position
   FROM (SELECT DISTINCT category FROM source_dim WHERE active AND category IS NOT NULL))
SELECT l.position, category, (SELECT count(*) FROM a WHERE cat = category) AS articles,
  coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY position) FROM z WHERE cat = category AND z.position <= 3), '') AS sample_ids FROM l""")
def category_summaries(t):
    return feeds.category_summary(t.articles(), t.annotations(), t.sources(), as_of())


@query("E4 D22 C3", """
SELECT s.id, s.name, s.source_type, s.trust_tier, s.active, (SELECT count(*) FROM article WHERE source_id = s.id) AS article_count
FROM source_dim s""")
def source_summaries(t):
    return feeds.source_summary(t.articles(), t.sources()).select("id", "name", "source_type", "trust_tier", "active", "article_count")


@query("C3 E4", """
SELECT s.name, (SELECT count(*) FROM article WHERE source_id = s.id) AS article_count FROM source_dim s
WHERE lower(source_family) = 'central_bank' OR lower(category) = 'energy'""")
def filtered_source_summaries(t):
    a = t.articles()
    both = feeds.source_summary(a, t.sources(), family="Central_Bank").unionByName(feeds.source_summary(a, t.sources(), category="ENERGY"))
    return both.select("name", "article_count").distinct()


_pairs = """(SELECT DISTINCT id, code FROM (SELECT id, country_code AS code FROM {rows} JOIN article_country ON article_id = id
  UNION ALL SELECT a.id, s.country_code FROM {rows} a JOIN source_dim s ON s.id = a.source_id WHERE s.country_code IS NOT NULL))"""


@query("E5 D3", f"""
WITH today AS (SELECT * FROM article WHERE {_pubtoday}) SELECT code AS country_code, count(*) AS articles FROM {_pairs.format(rows='today')} GROUP BY 1""")
def country_counts_today(t):
    rows = archive.published_on(t.articles(), dates.local_date(as_of()), as_of())
    return archive.country_pairs(rows, t.article_countries(), t.sources()).groupBy("country_code").agg(F.count(F.lit(1)).alias("articles"))


_state = f"""CASE WHEN status IS NULL THEN 'awaiting' WHEN status = 'success' AND is_relevant IS NOT DISTINCT FROM false THEN 'out_of_scope'
  WHEN status = 'success' THEN 'relevant' WHEN status = 'out_of_scope' THEN 'out_of_scope' WHEN status IN {s.inlist(lx.FAILED_STATUSES)} THEN 'failed' ELSE 'awaiting' END"""
_popn = f"""SELECT a.id, a.published_at, a.collected_at, n.topics, n.countries, {_state} AS state FROM article a LEFT JOIN latest_any n ON n.article_id = a.id
  WHERE (a.collected_at >= {LO} AND a.collected_at < {HI}) OR (a.published_at >= {LO} AND a.published_at < {HI})"""


@query("E6 C2", f"""
WITH p AS ({_popn}), c AS (SELECT count(*) FILTER (WHERE collected_at >= {LO} AND collected_at < {HI}) AS collected_today,
  count(*) FILTER (WHERE published_at >= {LO} AND published_at < {HI}) AS published_today, count(*) FILTER (WHERE state = 'relevant') AS relevant,
  count(*) FILTER (WHERE state = 'out_of_scope') AS out_of_scope, count(*) FILTER (WHERE state = 'failed') AS failed,
  count(*) FILTER (WHERE state = 'awaiting') AS awaiting FROM p)
SELECT *, floor((relevant + out_of_scope) / (relevant + out_of_scope + failed + awaiting) * 1000.0e0 + 0.5e0) / 10.0e0 AS coverage_pct FROM c""")
def today_context(t):
    return archive.context_stats(t.articles(), t.annotations(), as_of())


_tc = "regexp_replace(regexp_replace(tp, '^\\s+|\\s+$', '', 'g'), '^#+', '')"
_names = {v.lower(): k for k, v in lx.COUNTRY_NAMES.items()} | lx.COUNTRY_NAME_ALIASES


@query("E7 B26 B51", f"""
WITH p AS ({_popn}), r AS (SELECT * FROM p WHERE state = 'relevant' AND topics IS NOT NULL),
 tp AS (SELECT name, count(*) AS n FROM (SELECT CASE WHEN x = lower(x) THEN upper(substr(x, 1, 1)) || lower(substr(x, 2)) ELSE x END AS name FROM
   (SELECT {_tc} AS x FROM (SELECT unnest(topics) AS tp FROM r))) GROUP BY 1),
 co AS (SELECT c AS name, count(*) AS n FROM (SELECT unnest(countries) AS c FROM r) GROUP BY 1),
 g AS (SELECT lens AS name, CAST(sum(n) AS BIGINT) AS n FROM co JOIN ({' UNION ALL '.join(f"SELECT {s.q(v[0])} AS lens, {s.arr(v[1])} AS codes" for v in lx.LENSES.values())})
   ON list_contains(codes, {s.case_map('lower(name)', _names)}) GROUP BY 1)
SELECT 'topic' AS kind, name, n FROM (FROM tp ORDER BY n DESC, name LIMIT 6) UNION ALL
SELECT 'country', name, n FROM (FROM co ORDER BY n DESC, name LIMIT 5) UNION ALL SELECT 'group', name, n FROM (FROM g ORDER BY n DESC, name LIMIT 2)""")
def today_focus(t):
    return archive.focus(t.articles(), t.annotations(), as_of())


_cand = f"""c AS (SELECT *, row_number() OVER (ORDER BY eff_at DESC, id DESC) AS ord FROM article WHERE published_at IS NULL OR published_at <= {NOW})"""


def _feed_sql(mode):
    extra = {"balanced": "", "ai_curated": " AND id IN (SELECT article_id FROM annotation WHERE status = 'success' AND is_relevant)"}[mode]
    return f"WITH {_cand}, k AS (SELECT * FROM c WHERE ord <= 200 AND id NOT IN {_oos}{extra}), {_div.format(part='', bypart='')} SELECT position, id FROM z WHERE position <= 50"


@query("W1 W3 C1 C11", _feed_sql("balanced"))
def balanced_feed(t):
    return feeds.recent_feed(t.articles(), t.annotations(), t.sources(), as_of(), "balanced").select(F.col("position").cast("bigint"), "id")


@query("W1 W3 C11 D7", _feed_sql("ai_curated"))
def curated_feed(t):
    return feeds.recent_feed(t.articles(), t.annotations(), t.sources(), as_of(), "ai_curated").select(F.col("position").cast("bigint"), "id")


@query("W1 C1 C3", f"""
WITH c AS (SELECT a.*, row_number() OVER (ORDER BY eff_at DESC, a.id DESC) AS ord FROM article a JOIN source_dim s ON s.id = a.source_id
  WHERE lower(s.category) = 'energy' AND (published_at IS NULL OR published_at <= {NOW})) SELECT ord AS position, id FROM c WHERE ord <= 50""")
def chronological_category_feed(t):
    return feeds.recent_feed(t.articles(), t.annotations(), t.sources(), as_of(), "chronological", category="ENERGY").select(
        F.col("position").cast("bigint"), "id"
    )


@query("W8", f"""
WITH {_cand} SELECT c.id, title FROM c LEFT JOIN {_oos} o ON o.article_id = c.id WHERE ord <= 20 ORDER BY o.article_id IS NOT NULL, ord LIMIT 1""")
def top_story(t):
    return feeds.top_story(t.articles(), t.annotations(), as_of()).select("id", "title")


@query("W9 B19", f"""
WITH {_cand}, k AS (SELECT * FROM c WHERE ord <= 480 AND id NOT IN {_oos}), {_div.format(part='', bypart='')},
 f AS (SELECT z.id, z.source_id, position, {s.case_map("lower(coalesce(CASE WHEN n.is_relevant THEN n.primary_category END, s.category))", dict(lx.FEED_SECTIONS))} AS sec
   FROM z LEFT JOIN source_dim s ON s.id = z.source_id LEFT JOIN latest_any n ON n.article_id = z.id WHERE position <= 120),
 g AS (SELECT *, row_number() OVER (PARTITION BY sec ORDER BY position) AS r FROM f WHERE position > 1),
 h AS (SELECT *, CASE WHEN sec IS NOT NULL AND r <= 6 THEN sec ELSE 'Latest Updates' END AS section FROM g),
 i AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY position) AS r2 FROM h),
 j AS (SELECT section, id, source_id, position AS ord FROM i WHERE section <> 'Latest Updates' OR r2 <= 8),
 u AS (SELECT *, row_number() OVER (PARTITION BY section, coalesce(source_id, 0) ORDER BY ord) > 2 AS over FROM j),
 v AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY over, ord) AS pos FROM u)
SELECT section, CAST(pos AS INT) AS position, id FROM v WHERE pos <= 6 UNION ALL SELECT 'Top Story', 1, id FROM f WHERE position = 1""")
def section_feed(t):
    return feeds.section_feed(t.articles(), t.annotations(), t.sources(), as_of())


def _page_sql(where, page, size):
    return f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY eff_at DESC, id DESC) AS rn, count(*) OVER () AS total FROM article WHERE {where}),
 p AS (SELECT *, CAST(greatest(1, ceil(total / {size}.0)) AS INT) AS total_pages FROM r), z AS (SELECT *, least({page}, total_pages) AS page FROM p)
SELECT id, page, total, total_pages, page > 1 AS has_prev, page < total_pages AS has_next FROM z WHERE rn > (page - 1) * {size} AND rn <= page * {size}"""


PAGE_COLS = ["id", "page", "total", "total_pages", "has_prev", "has_next"]


@query("W4", _page_sql(f"published_at IS NULL OR published_at <= {NOW}", 3, 25))
def archive_page(t):
    rows = t.articles().where(dates.not_future(F.col("published_at"), as_of())).select("id", "published_at", "collected_at")
    return feeds.paginate(rows, feeds.newest_first(), 3, 25).select(*PAGE_COLS)


@query("W4", _page_sql(f"source_id = 4 AND (published_at IS NULL OR published_at <= {NOW})", 99999, 20))
def source_page(t):
    rows = t.articles().where((F.col("source_id") == 4) & dates.not_future(F.col("published_at"), as_of())).select("id", "published_at", "collected_at")
    return feeds.paginate(rows, feeds.newest_first(), 99999, 20).select(*PAGE_COLS)


@query("W4 C8 B6", _page_sql(f"published_at >= {s.to_utc('''TIMESTAMP '2024-01-12' ''')} AND published_at < {s.to_utc('''TIMESTAMP '2024-01-13' ''')} AND published_at <= {NOW}", 1, 25))
def day_page(t):
    rows = archive.published_on(t.articles(), F.lit("2024-01-12").cast("date"), as_of()).select("id", "published_at", "collected_at")
    return feeds.paginate(rows, feeds.newest_first(), 1, 25).select(*PAGE_COLS)


@query("C8", f"""
SELECT id FROM article WHERE eff_at >= {s.to_utc('''TIMESTAMP '2024-01-05' ''')} AND eff_at < {s.to_utc('''TIMESTAMP '2024-01-09' ''')}""")
def local_date_range(t):
    e = feeds.effective()
    lo, hi = F.lit("2024-01-05").cast("date"), F.lit("2024-01-08").cast("date")
    return t.articles().where((e >= dates.day_start(lo)) & (e <= dates.day_end_inclusive(hi))).select("id")


@query("C4 D4", f"""
SELECT a.id FROM article a LEFT JOIN source_dim s ON s.id = a.source_id WHERE lower(a.primary_category) IN ('energy', 'research')
 OR lower(s.category) IN ('energy', 'research') OR EXISTS (SELECT 1 FROM annotation n WHERE n.article_id = a.id AND lower(n.primary_category) IN ('energy', 'research'))""")
def category_facet(t):
    from newsmart.operators import search

    return search.category_facet(t.articles(), t.annotations(), t.sources(), ["Energy", " research"]).select("id")


@query("C5 D4", f"""
SELECT a.id FROM article a LEFT JOIN source_dim s ON s.id = a.source_id WHERE s.country_code IN ('JP', 'SE')
 OR EXISTS (SELECT 1 FROM article_country c WHERE c.article_id = a.id AND c.country_code IN ('JP', 'SE'))""")
def country_facet(t):
    from newsmart.operators import search

    return search.country_facet(t.articles(), t.article_countries(), t.sources(), ["jp", "SE "]).select("id")


@query("C6", "SELECT a.id FROM article a LEFT JOIN source_dim s ON s.id = a.source_id WHERE a.source_id IN (3) OR lower(s.name) IN ('src11')")
def source_facet(t):
    from newsmart.operators import search

    return search.source_facet(t.articles(), t.sources(), ["3", "SRC11"]).select("id")


@query("C7 D4", """
SELECT id FROM article a WHERE EXISTS (SELECT 1 FROM annotation n WHERE n.article_id = a.id AND is_relevant)
 AND EXISTS (SELECT 1 FROM annotation n WHERE n.article_id = a.id AND importance_score >= 60)
 AND EXISTS (SELECT 1 FROM annotation n WHERE n.article_id = a.id AND relevance_score >= 70)""")
def score_facet(t):
    from newsmart.operators import search

    return search.score_facet(t.articles(), t.annotations(), True, 60, 70).select("id")


@query("C15 O4", f"""
WITH today AS (SELECT a.* FROM article a JOIN source_dim s ON s.id = a.source_id WHERE {_pubtoday} AND lower(s.category) IN ('energy', 'world', 'business')),
 x AS (SELECT * FROM {_pairs.format(rows='today')}) SELECT DISTINCT id FROM today WHERE id IN (SELECT id FROM x WHERE code IN {s.inlist(lx.LENSES['brics'][1])})
 AND id IN (SELECT id FROM x WHERE code = 'CN')""")
def lens_feed(t):
    from functools import reduce

    parts = [
        archive.lens_articles(t.articles(), t.article_countries(), t.sources(), as_of(), "brics", "cn", c).select("id")
        for c in ("Energy", "World", "Business")
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


@query("C17 E15", f"""
SELECT count(*) AS articles, count(*) FILTER (WHERE title IS NULL OR title = '') AS missing_title, count(*) FILTER (WHERE canonical_url IS NULL OR canonical_url = '') AS missing_url,
 count(*) FILTER (WHERE published_at IS NULL) AS missing_date, count(*) FILTER (WHERE raw_summary IS NULL OR raw_summary = '') AS missing_summary,
 count(*) FILTER (WHERE published_at > {NOW}) AS future_dated FROM article""")
def missing_field_counts(t):
    return archive.missing_fields(t.articles(), as_of())


@query("C17", f"SELECT id, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM article WHERE published_at > {NOW}")
def future_dated(t):
    return t.articles().where(F.col("published_at") > as_of()).select("id", stamp(F.col("published_at")).alias("published_at"))


_complete = "n.summary <> '' AND len(n.topics) > 0 AND len(n.entities) > 0 AND title <> '' AND raw_summary <> ''"


@query("C19", f"""
SELECT a.id, coalesce(title <> '', false) AS has_title, coalesce(raw_summary <> '', false) AS has_summary, coalesce(n.summary <> '', false) AS has_annotation_summary,
 coalesce(len(n.topics), 0) > 0 AS has_topics, coalesce(len(n.entities), 0) > 0 AS has_entities, source_id IS NOT NULL AS has_source,
 coalesce(n.is_relevant, false) AS relevant, coalesce(n.is_relevant, false) AND (coalesce(title <> '', false) OR coalesce(raw_summary <> '', false)) AS searchable,
 coalesce({_complete}, false) AS complete
FROM article a LEFT JOIN latest_any n ON n.article_id = a.id""")
def searchability_flags(t):
    return archive.searchability(t.articles(), t.annotations(), t.sources())


@query("D2", """
SELECT a.id, s.name AS source_name, coalesce(n.k, 0) AS annotations, coalesce(c.codes, '') AS countries
FROM article a LEFT JOIN source_dim s ON s.id = a.source_id LEFT JOIN (SELECT article_id, count(*) AS k FROM annotation GROUP BY 1) n ON n.article_id = a.id
LEFT JOIN (SELECT article_id, string_agg(country_code, '|' ORDER BY country_code) AS codes FROM article_country GROUP BY 1) c ON c.article_id = a.id""")
def article_details(t):
    n = t.annotations().groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("annotations"))
    c = t.article_countries().groupBy(F.col("article_id").alias("id")).agg(joined(F.collect_set("country_code")).alias("countries"))
    a = with_source(t.articles().select("id", "source_id"), t.sources(), ["name"])
    return a.join(n, "id", "left").join(c, "id", "left").select(
        "id", "source_name", F.coalesce("annotations", F.lit(0)).alias("annotations"), F.coalesce("countries", F.lit("")).alias("countries")
    )


@query("D6 D5", """
SELECT a.id, a.source_id FROM article a WHERE NOT EXISTS (SELECT 1 FROM annotation n WHERE n.article_id = a.id)""")
def articles_without_annotation(t):
    done = t.annotations().select(F.col("article_id").alias("id"))
    return t.articles().select("id", "source_id").join(done, "id", "left_anti")


_pol = {"latest": "latest_any", "latest_success": "latest_success", "first_relevant": "first_relevant", "first": "first_any"}


@query("D7", " UNION ALL ".join(f"SELECT '{p}' AS policy, article_id, annotation_id, status FROM {c}" for p, c in _pol.items()))
def annotation_policies(t):
    from functools import reduce

    a = t.annotations().select("article_id", "annotation_id", "status", "is_relevant", "created_at")
    parts = [ann.pick_annotation(a, p).select(F.lit(p).alias("policy"), "article_id", "annotation_id", "status") for p in ann.POLICIES]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query("D18", f"""
SELECT CAST(d AS VARCHAR) AS day, CAST(lag(d) OVER (ORDER BY d) AS VARCHAR) AS previous, CAST(lead(d) OVER (ORDER BY d) AS VARCHAR) AS next
FROM (SELECT DISTINCT {s.local_date('eff_at')} AS d FROM article)""")
def edition_neighbours(t):
    from newsmart.operators.editions import neighbours

    d = t.articles().select(dates.local_date(feeds.effective()).alias("edition_date"))
    return neighbours(d.distinct()).select(
        F.col("edition_date").cast("string").alias("day"), F.col("previous").cast("string").alias("previous"), F.col("next").cast("string").alias("next")
    )


# --- queue ---------------------------------------------------------------------
Q_OF = "2024-01-15 09:00:00"
QNOW = f"TIMESTAMP '{Q_OF}'"
_v1 = "prompt_version = 'v2'"
JOB_SQL = f"""CASE WHEN status IN ('success', 'out_of_scope') THEN 'COMPLETED' WHEN status = 'invalid_json' THEN 'NON_RETRYABLE'
  WHEN status = 'processing' THEN CASE WHEN processed_at < {QNOW} - INTERVAL 900 SECOND THEN 'STALE' ELSE 'PROCESSING' END
  WHEN status IN {s.inlist(lx.RETRYABLE_STATUSES)} THEN CASE WHEN processed_at < {QNOW} - INTERVAL 300 SECOND THEN 'RETRYABLE' ELSE 'COOLDOWN' END ELSE 'OTHER' END"""


def q_of():
    return dates.ts(Q_OF)


@query("C20", f"SELECT annotation_id, article_id, {JOB_SQL} AS state FROM annotation")
def annotation_states(t):
    return queue.states(t.annotations(), q_of()).select("annotation_id", "article_id", "state")


@query("C20 D5", f"""
SELECT id FROM article WHERE id NOT IN (SELECT article_id FROM annotation WHERE {JOB_SQL} IN ('COMPLETED', 'NON_RETRYABLE', 'PROCESSING', 'COOLDOWN'))""")
def eligible_for_annotation(t):
    return queue.eligible(t.articles(), t.annotations(), q_of()).select("id")


@query("E8 C20", f"""
WITH n AS (SELECT *, {JOB_SQL} AS state FROM annotation),
 o AS (SELECT count(*) FILTER (WHERE state = 'PROCESSING') AS processing, count(*) FILTER (WHERE state = 'STALE') AS stale_processing,
  count(*) FILTER (WHERE status = 'success' AND is_relevant IS DISTINCT FROM false) AS completed_relevant,
  count(*) FILTER (WHERE status = 'out_of_scope' OR (status = 'success' AND is_relevant = false)) AS completed_out_of_scope,
  count(*) FILTER (WHERE status IN {s.inlist(lx.FAILED_STATUSES)}) AS failed, count(*) FILTER (WHERE state = 'NON_RETRYABLE') AS non_retryable,
  count(*) FILTER (WHERE state IN ('STALE', 'RETRYABLE')) AS retryable, {s.fmt_ts("max(processed_at) FILTER (WHERE status <> 'processing')")} AS newest_processed FROM n),
 a AS (SELECT count(*) AS total_articles, count(*) FILTER (WHERE u) AS unprocessed, min(collected_at) FILTER (WHERE u) AS old
  FROM (SELECT *, id NOT IN (SELECT article_id FROM annotation) AS u FROM article))
SELECT a.* EXCLUDE (old), {s.fmt_ts('old')} AS oldest_unprocessed, o.*, completed_relevant + completed_out_of_scope AS completed_total, unprocessed + retryable AS eligible,
 {s.rnd(f'greatest(0.0e0, (epoch_us({QNOW}) - epoch_us(old)) / 3600000000.0e0)', 2)} AS queue_age_hours,
 {s.rnd('(completed_relevant + completed_out_of_scope) / total_articles * 100.0e0', 2)} AS coverage_pct FROM a, o""")
def queue_status(t):
    x = queue.status(t.articles(), t.annotations(), q_of())
    return x.withColumn("newest_processed", stamp(F.col("newest_processed"))).withColumn("oldest_unprocessed", stamp(F.col("oldest_unprocessed")))


@query("E9 B45", f"SELECT {TIER_SQL} AS tier, count(*) AS n FROM {PRIORITY_SQL} WHERE id NOT IN (SELECT article_id FROM annotation) GROUP BY 1")
def queue_tiers(t):
    return queue.tier_counts(prioritised(t, False), t.annotations())


_now2 = f"TIMESTAMP '{AS_OF}'"


@query("W19", f"""
WITH st AS (SELECT article_id, {JOB_SQL.replace(QNOW, _now2)} AS state FROM annotation),
 e AS (SELECT id, collected_at AS ca, collected_at >= {_now2} - INTERVAL 2 HOUR AS fresh, base_score, {s.rnd('eff', 2)} AS eff FROM {PRIORITY_SQL}
  WHERE id NOT IN (SELECT article_id FROM st WHERE state IN ('COMPLETED', 'NON_RETRYABLE', 'PROCESSING', 'COOLDOWN'))),
 r AS (SELECT *, row_number() OVER (PARTITION BY fresh ORDER BY CASE WHEN fresh THEN CAST(base_score AS DOUBLE) ELSE eff END DESC, ca, id) AS rn FROM e),
 q AS (SELECT count(*) FILTER (WHERE fresh) AS f, count(*) FILTER (WHERE NOT fresh) AS b FROM e),
 w AS (SELECT least(20 - least(14, f), b) AS bq, f FROM q), v AS (SELECT bq, least(20 - bq, f) AS fq FROM w)
SELECT CAST(row_number() OVER (ORDER BY fresh DESC, rn) AS INT) AS position, id, CASE WHEN fresh THEN 'fresh' ELSE 'backlog' END AS lane
FROM r, v WHERE rn <= CASE WHEN fresh THEN fq ELSE bq END""")
def dual_lane_batch(t):
    return queue.batch(prioritised(t, False), t.annotations(), as_of(), 20)


@query("W20 D5", "SELECT id FROM article WHERE id NOT IN (SELECT article_id FROM annotation) ORDER BY collected_at, id LIMIT 50")
def fifo_batch(t):
    return queue.fifo(t.articles(), t.annotations(), 50).select("id")


_min = lambda x: s.rnd(f"(epoch_us({_now2}) - epoch_us({x})) / 60000000.0e0", 1)


@query("E10", f"""
WITH d AS (SELECT DISTINCT article_id FROM annotation WHERE status IN ('success', 'out_of_scope', 'invalid_json')),
 x AS (SELECT max(collected_at) AS li, count(*) FILTER (WHERE w AND nw) AS fresh_queue, count(*) FILTER (WHERE w AND NOT nw) AS backlog_queue, min(collected_at) FILTER (WHERE w AND nw) AS ofr
  FROM (SELECT *, id NOT IN (SELECT article_id FROM d) AS w, collected_at >= {_now2} - INTERVAL 2 HOUR AS nw FROM article)),
 y AS (SELECT max(processed_at) AS ld FROM annotation WHERE status IN ('success', 'out_of_scope')),
 z AS (SELECT {_min('li')} AS minutes_since_item, {_min('ld')} AS minutes_since_annotation, fresh_queue, backlog_queue, greatest(0.0e0, {_min('ofr')}) AS oldest_fresh_minutes FROM x, y)
SELECT *, CASE WHEN minutes_since_item <= 45 THEN 'HEALTHY' ELSE 'STALE' END AS ingest_status, CASE WHEN minutes_since_annotation <= 30 THEN 'HEALTHY' ELSE 'STALE' END AS annotation_status,
 CASE WHEN minutes_since_item <= 45 AND minutes_since_annotation <= 30 THEN 'FRESH' ELSE 'STALE' END AS overall FROM z""")
def freshness_status(t):
    return queue.freshness(t.articles(), t.annotations(), as_of())


# --- sources and histograms ------------------------------------------------------
@query("E11 B47 E12", f"""
WITH g AS (SELECT source_id, count(*) AS n, min(eff_at) AS oldest, max(eff_at) AS newest, arg_max(collected_at, (eff_at, id)) AS lc FROM article GROUP BY 1)
SELECT s.id, s.name, CASE WHEN NOT active THEN 'DISABLED' WHEN lower(source_type) NOT IN {s.inlist(lx.FEED_SOURCE_TYPES)} OR feed_url IS NULL THEN 'FAILED'
  WHEN coalesce(n, 0) = 0 THEN 'EMPTY' WHEN newest < TIMESTAMP '2024-02-06 12:00:00' - INTERVAL 7 DAY THEN 'STALE' ELSE 'HEALTHY' END AS status,
 coalesce(n, 0) AS items, {s.fmt_ts('oldest')} AS oldest, {s.fmt_ts('newest')} AS newest, {s.fmt_ts('lc')} AS last_collected
FROM source_dim s LEFT JOIN g ON g.source_id = s.id""")
def source_health(t):
    from newsmart.operators.health import source_health as health

    h = health(t.articles(), t.sources(), dates.ts("2024-02-06 12:00:00"))
    return h.select("id", "name", "status", "items", stamp(F.col("oldest")).alias("oldest"), stamp(F.col("newest")).alias("newest"), stamp(F.col("last_collected")).alias("last_collected"))


@query("E11", f"""
SELECT status, count(*) AS n FROM (SELECT CASE WHEN NOT active THEN 'DISABLED' WHEN lower(source_type) NOT IN {s.inlist(lx.FEED_SOURCE_TYPES)} OR feed_url IS NULL THEN 'FAILED'
  WHEN (SELECT count(*) FROM article WHERE source_id = s.id) = 0 THEN 'EMPTY'
  WHEN (SELECT max(eff_at) FROM article WHERE source_id = s.id) < TIMESTAMP '2024-02-06 12:00:00' - INTERVAL 7 DAY THEN 'STALE' ELSE 'HEALTHY' END AS status FROM source_dim s) GROUP BY 1""")
def source_health_summary(t):
    from newsmart.operators.health import source_health as health

    return health(t.articles(), t.sources(), dates.ts("2024-02-06 12:00:00")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("E13", "SELECT c_nationkey AS instrument, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 GROUP BY ALL")
def yearly_counts(t):
    return t.prices().where(F.col("instrument") == 7).groupBy("instrument", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("E14", f"""
SELECT 'canonical_url' AS kind, canonical_url AS key, count(*) AS n FROM article GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'title', sha256({s.normalise_title('title')}), count(*) FROM article GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(t):
    from newsmart.functions.text import title_fingerprint

    a = t.articles()
    u = archive.duplicate_keys(a.select(F.col("canonical_url").alias("key")), ["key"]).select(F.lit("canonical_url").alias("kind"), "key", "n")
    f = archive.duplicate_keys(a.select(title_fingerprint(F.col("title")).alias("key")), ["key"]).select(F.lit("title").alias("kind"), "key", "n")
    return u.unionByName(f)


@query("E16", f"""
SELECT CAST({s.local_date('eff_at')} AS VARCHAR) AS day, count(DISTINCT a.id) AS articles, count(n.annotation_id) AS annotations
FROM article a LEFT JOIN annotation n ON n.article_id = a.id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def busiest_days(t):
    per = t.annotations().groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    a = t.articles().select("id", dates.local_date(feeds.effective()).cast("string").alias("day")).join(per, "id", "left")
    return a.groupBy("day").agg(F.count(F.lit(1)).alias("articles"), F.sum(F.coalesce("k", F.lit(0))).alias("annotations")).orderBy(
        F.desc("articles"), "day"
    ).limit(10)


@query("E19", f"""
SELECT {s.rnd('quantile_cont(v, 0.25)', 4)} AS p25, {s.rnd('quantile_cont(v, 0.5)', 4)} AS median, {s.rnd('quantile_cont(v, 0.9)', 4)} AS p90, count(*) AS n,
  (SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS c FROM (SELECT CAST(importance_score AS DOUBLE) AS v FROM annotation WHERE importance_score IS NOT NULL)) WHERE r = CAST(ceil(0.75e0 * c) AS BIGINT)) AS nearest_p75
FROM (SELECT CAST(importance_score AS DOUBLE) AS v FROM annotation WHERE importance_score IS NOT NULL)""")
def score_percentiles(t):
    v = t.annotations().where(F.col("importance_score").isNotNull()).select(F.col("importance_score").cast("double").alias("v"))
    agg = v.agg(
        round_half_up(F.percentile("v", F.lit(0.25)), 4).alias("p25"), round_half_up(F.percentile("v", F.lit(0.5)), 4).alias("median"),
        round_half_up(F.percentile("v", F.lit(0.9)), 4).alias("p90"), F.count(F.lit(1)).alias("n"),
    )
    return archive.one_row(agg, nearest_rank(v, "v", 0.75).withColumnRenamed("v", "nearest_p75"))


@query("E40", """
WITH e AS (SELECT unnest(entities) AS e FROM annotation WHERE status = 'success' AND is_relevant)
SELECT * FROM (SELECT 'name' AS kind, e.name AS key, count(*) AS n FROM e GROUP BY ALL ORDER BY n DESC, key LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'type', e.type, count(*) AS n FROM e GROUP BY ALL)
UNION ALL SELECT * FROM (SELECT 'topic', t, count(*) AS n FROM (SELECT unnest(topics) AS t FROM annotation WHERE status = 'success' AND is_relevant) GROUP BY ALL)""")
def entity_profile(t):
    rel = t.annotations().where((F.col("status") == "success") & F.col("is_relevant"))
    e = rel.select(F.explode("entities").alias("e"))

    def tally(df, kind, key):
        return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "key", "n")

    names = tally(e, "name", F.col("e.name")).orderBy(F.desc("n"), "key").limit(20)
    return names.unionByName(tally(e, "type", F.col("e.type"))).unionByName(tally(rel.select(F.explode("topics").alias("t")), "topic", F.col("t")))


@query("E42", f"""
SELECT count(*) FILTER (WHERE collected_at >= {_now2} - INTERVAL 30 MINUTE AND collected_at <= {_now2}) AS last_30m, count(*) FILTER (WHERE collected_at >= {_now2} - INTERVAL 1 HOUR AND collected_at <= {_now2}) AS last_1h,
 count(*) FILTER (WHERE collected_at >= {_now2} - INTERVAL 2 HOUR AND collected_at <= {_now2}) AS last_2h, count(*) FILTER (WHERE collected_at >= {_now2} - INTERVAL 4 HOUR AND collected_at <= {_now2}) AS last_4h,
 {_min(f"max(collected_at) FILTER (WHERE collected_at <= {_now2})")} AS item_minutes, {_min(f"max(published_at) FILTER (WHERE published_at <= {_now2})")} AS published_minutes,
 (SELECT {_min('max(processed_at)')} FROM annotation WHERE processed_at <= {_now2}) AS annotation_minutes FROM article""")
def recent_arrivals(t):
    from newsmart.operators.health import arrivals

    return arrivals(t.articles(), t.annotations(), as_of())


# --- reading list -----------------------------------------------------------------
_saved = """(SELECT user_id, article_id, min(ts) FILTER (WHERE action IN ('save', 'read')) AS saved_at, coalesce(arg_max(action, (ts, event_id)) FILTER (WHERE action IN ('read', 'unread')) = 'read', false) AS is_read,
  max(ts) FILTER (WHERE action = 'read') AS lr FROM (SELECT l.* FROM action_log l LEFT JOIN (SELECT user_id, article_id, max((ts, event_id)) AS g FROM action_log WHERE action = 'unsave' GROUP BY ALL) u USING (user_id, article_id)
  WHERE g IS NULL OR (ts, event_id) > g) GROUP BY ALL HAVING saved_at IS NOT NULL)"""


@query("W21", f"SELECT user_id, article_id, {s.fmt_ts('saved_at')} AS saved_at, is_read, CASE WHEN is_read THEN {s.fmt_ts('lr')} END AS read_at FROM {_saved}")
def reading_list(t):
    r = saved.fold_actions(t.actions())
    return r.withColumn("saved_at", stamp(F.col("saved_at"))).withColumn("read_at", stamp(F.col("read_at")))


@query("E38", f"""SELECT user_id, count(*) AS "all", count(*) FILTER (WHERE NOT is_read) AS unread, count(*) FILTER (WHERE is_read) AS read FROM {_saved} GROUP BY 1""")
def reading_counts(t):
    return saved.counts(saved.fold_actions(t.actions()))


@query("C16", f"""SELECT user_id, v.article_id FROM {_saved} v JOIN article a ON a.id = v.article_id JOIN source_dim s ON s.id = a.source_id
WHERE NOT is_read AND lower(s.category) = 'geopolitics' AND a.source_id = 2""")
def reading_list_filter(t):
    r = saved.fold_actions(t.actions()).where(~F.col("is_read"))
    a = with_source(t.articles().where(F.col("source_id") == 2).select(F.col("id").alias("article_id"), "source_id"), t.sources(), ["category"], "inner")
    return r.join(a.where(F.lower("source_category") == "geopolitics"), "article_id").select("user_id", "article_id")


# --- set operations ---------------------------------------------------------------
_rel = "SELECT article_id AS id FROM annotation WHERE is_relevant"
_imp = "SELECT article_id AS id FROM annotation WHERE importance_score >= 60"


@query("O1 O2 O3", f"""
SELECT 'both' AS part, id FROM (({_rel}) INTERSECT ({_imp})) UNION ALL SELECT 'relevant_only', id FROM (({_rel}) EXCEPT ({_imp}))
UNION ALL SELECT 'either', id FROM (({_rel}) UNION ({_imp}))""")
def relevance_sets(t):
    a = t.annotations()
    rel, imp = (a.where(c).select(F.col("article_id").alias("id")) for c in (F.col("is_relevant"), F.col("importance_score") >= 60))
    tag = lambda df, n: df.select(F.lit(n).alias("part"), "id")
    return tag(rel.intersect(imp), "both").unionByName(tag(rel.subtract(imp), "relevant_only")).unionByName(tag(rel.union(imp).distinct(), "either"))


# --- order over everything ---------------------------------------------------------
@query("W30", f"""
SELECT CAST((rn - 1) // 50 AS BIGINT) AS batch, count(*) AS n, {s.fmt_ts('min(eff_at) - INTERVAL 48 HOUR')} AS context_from, {s.fmt_ts('max(eff_at) + INTERVAL 48 HOUR')} AS context_to
FROM (SELECT eff_at, row_number() OVER (ORDER BY eff_at, id) AS rn FROM article WHERE id NOT IN (SELECT article_id FROM annotation)) GROUP BY 1""")
def chronological_batches(t):
    done = t.annotations().select(F.col("article_id").alias("id"))
    todo = t.articles().select("id", feeds.effective().alias("at")).join(done, "id", "left_anti")
    r = global_rank(todo, ["at", "id"]).groupBy(F.floor((F.col("rank") - 1) / 50).alias("batch"))
    return r.agg(
        F.count(F.lit(1)).alias("n"), stamp(F.min("at") - F.expr("INTERVAL 48 HOURS")).alias("context_from"),
        stamp(F.max("at") + F.expr("INTERVAL 48 HOURS")).alias("context_to"),
    )


@query("W31", "SELECT id FROM article WHERE id NOT IN (SELECT article_id FROM annotation) ORDER BY eff_at, id LIMIT 120")
def first_uncovered(t):
    done = t.annotations().select(F.col("article_id").alias("id"))
    return t.articles().select("id", feeds.effective().alias("at")).join(done, "id", "left_anti").orderBy("at", "id").limit(120).select("id")
