"""Daily editions of events and of articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions import dates, similarity
from newsmart.functions.numbers import round_half_up
from newsmart.operators import daily, editions, evidence, pairs, selection
from newsmart.plans import sqltext as s
from newsmart.plans.clusters import compare_sql, labelled_pairs
from newsmart.plans.registry import query, shared
from newsmart.plans.scalars import AS_OF, CATEGORY_SQL, edition_score_sql, editorial_sql, reason_sql
from newsmart.session import cut_lineage

NOW = f"TIMESTAMP '{AS_OF}'"


def as_of():
    return dates.ts(AS_OF)


s.cte("ok_article", f"""
SELECT a.* FROM article a LEFT JOIN source_dim s ON s.id = a.source_id WHERE a.title <> '' AND a.canonical_url <> '' AND a.eff_at <= {NOW} AND coalesce(s.active, true)
 AND a.id IN (SELECT article_id FROM annotation WHERE status = 'success' AND is_relevant) AND a.id NOT IN (SELECT article_id FROM latest_any WHERE is_relevant = false)""")
_ld = s.local_date("eff_at")
_wend = s.to_utc("CAST(edition_date + 1 AS TIMESTAMP) - INTERVAL 1 SECOND")
s.cte("placed", f"""
SELECT * FROM (SELECT o.*, CAST({_ld} + k AS DATE) AS edition_date FROM ok_article o, (VALUES (0), (1), (2)) AS ks(k))
WHERE eff_at >= {_wend} - INTERVAL 48 HOUR AND eff_at <= {_wend}""")

_pairs = "SELECT x, y FROM feat x JOIN feat y ON x.id < y.id WHERE (x.id, y.id) IN (SELECT DISTINCT p.id, q.id FROM placed p JOIN placed q ON p.edition_date = q.edition_date AND p.id < q.id) " \
    f"AND abs(epoch_us(x.eff_at) - epoch_us(y.eff_at)) <= {pairs.WINDOW_US} AND (x.cat = '' OR y.cat = '' OR x.cat = y.cat OR x.cat IN {s.inlist(lx.BROAD_CATEGORIES)} OR y.cat IN {s.inlist(lx.BROAD_CATEGORIES)})"
EDITION_SQL = f"""edge AS (SELECT a, b FROM {compare_sql(_pairs)} WHERE band = 'HIGH_CONFIDENCE' OR score >= 0.68e0),
 sym AS (SELECT p.edition_date, a, b FROM edge JOIN placed p ON p.id = a JOIN placed q ON q.id = b AND q.edition_date = p.edition_date
   UNION ALL SELECT p.edition_date, b, a FROM edge JOIN placed p ON p.id = a JOIN placed q ON q.id = b AND q.edition_date = p.edition_date),
 walk AS (SELECT edition_date, id, id AS root FROM placed UNION SELECT w.edition_date, sym.b, w.root FROM walk w JOIN sym ON sym.a = w.id AND sym.edition_date = w.edition_date WHERE w.root < sym.b),
 label AS (SELECT edition_date, id, min(root) AS label FROM walk GROUP BY 1, 2),
 mem AS (SELECT l.edition_date, l.label, a.* FROM label l JOIN article a ON a.id = l.id),
 ns AS (SELECT edition_date, label, greatest(1, count(DISTINCT source_id)) AS k FROM mem GROUP BY 1, 2),
 sc0 AS (SELECT a.edition_date, a.label, a.id, a.title, a.raw_summary, a.source_id, a.eff_at, a.published_at, ns.k, s.source_type, n.importance_score, coalesce(n.primary_category, {CATEGORY_SQL}) AS category, {editorial_sql('n.importance_score', 'ns.k', AS_OF)}
  FROM mem a JOIN ns ON ns.label = a.label AND ns.edition_date = a.edition_date LEFT JOIN source_dim s ON s.id = a.source_id LEFT JOIN first_relevant n ON n.article_id = a.id),
 sc AS (SELECT *, {s.rnd('least(100.0e0, importance_pts + source_pts + recency_pts + strategic_pts + corroboration_pts)', 1)} AS editorial FROM sc0),
 pr AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY edition_date, label ORDER BY editorial DESC, coalesce(source_type IN {s.inlist(lx.OFFICIAL_SOURCE_TYPES)}, false) DESC, coalesce(epoch_us(published_at), 0) DESC, id) = 1),
 cl AS (SELECT pr.edition_date, pr.label, 'evt_' || pr.label || '_' || substr(sha256(g.ids), 1, 16) AS cluster_id, pr.title AS canonical_title, pr.id AS primary_id, {s.case_map('lower(pr.category)', lx.EVENT_SECTIONS, "'WORLD'")} AS section,
   CAST(pr.k AS INT) AS distinct_source_count, g.n AS article_count, {s.rnd('least(100.0e0, pr.editorial + least(15.0e0, (pr.k - 1) * 5.0e0))', 1)} AS cluster_score, g.latest_at, pr.source_id AS source, pr.source_type, pr.importance_score AS imp
  FROM pr JOIN (SELECT edition_date, label, count(*) AS n, max(eff_at) AS latest_at, count(*) || '-' || min(id) || '-' || {s.hash_sum('id')} AS ids FROM mem GROUP BY 1, 2) g ON g.label = pr.label AND g.edition_date = pr.edition_date),
 near AS (SELECT a, b FROM {compare_sql("SELECT x, y FROM plain_feat x JOIN plain_feat y ON x.id < y.id WHERE (x.id, y.id) IN (SELECT DISTINCT least(c.primary_id, d.primary_id), greatest(c.primary_id, d.primary_id) FROM cl c JOIN cl d ON c.edition_date = d.edition_date AND c.primary_id <> d.primary_id)")} WHERE score >= 0.55e0),
 dup AS (SELECT a AS id, list(b) AS ids FROM (SELECT a, b FROM near UNION ALL SELECT b, a FROM near) GROUP BY 1),
 cand AS (SELECT cl.*, coalesce(dup.ids, CAST([] AS BIGINT[])) AS dups, row_number() OVER (PARTITION BY edition_date ORDER BY cluster_score DESC, coalesce(nullif(imp, 0), 50) DESC, latest_at DESC, primary_id) AS pos FROM cl LEFT JOIN dup ON dup.id = primary_id),
 step AS (SELECT DISTINCT edition_date, CAST(0 AS BIGINT) AS pos, CAST([] AS STRUCT(id BIGINT, source INT, section VARCHAR)[]) AS taken, '' AS outcome FROM cl
  UNION ALL SELECT edition_date, pos, CASE WHEN outcome = 'SELECTED' THEN list_append(taken, {{'id': primary_id, 'source': source, 'section': section}}) ELSE taken END, outcome FROM (
   SELECT c.edition_date, c.pos, t.taken, c.primary_id, c.source, c.section, CASE WHEN c.cluster_score < 50 THEN 'QUALITY_THRESHOLD'
     WHEN c.source IS NOT NULL AND len(list_filter(t.taken, lambda z: z.source = c.source)) >= 2 THEN 'SOURCE_CAP'
     WHEN len(list_filter(t.taken, lambda z: z.section = c.section)) >= 6 THEN 'SECTION_CAP'
     WHEN c.article_count = 1 AND len(list_intersect(c.dups, list_transform(t.taken, lambda z: z.id))) > 0 THEN 'DUPLICATE_SAFETY' ELSE 'SELECTED' END AS outcome
   FROM step t JOIN cand c ON c.edition_date = t.edition_date AND c.pos = t.pos + 1 WHERE len(t.taken) < 20)),
 dec AS (SELECT c.*, t.outcome FROM step t JOIN cand c ON c.edition_date = t.edition_date AND c.pos = t.pos),
 sel AS (SELECT *, row_number() OVER (PARTITION BY edition_date ORDER BY pos) AS position, {s.rnd('''cluster_score + CASE WHEN distinct_source_count >= 2 THEN 10.0e0 ELSE 0.0e0 END
   + CASE WHEN section IN ('ECONOMY','WORLD','ENERGY','TRADE') THEN 10.0e0 WHEN source_type IN ('CENTRAL_BANK','GOVERNMENT') THEN 15.0e0 ELSE 0.0e0 END + CASE WHEN coalesce(nullif(imp, 0), 50) >= 80 THEN 5.0e0 ELSE 0.0e0 END''', 1)} AS significance FROM dec WHERE outcome = 'SELECTED'),
 led AS (SELECT edition_date, position AS lead FROM sel WHERE cluster_score >= 70 QUALIFY row_number() OVER (PARTITION BY edition_date ORDER BY significance DESC, position) = 1),
 events_sel AS (SELECT sel.*, CASE WHEN position = lead THEN 'LEAD' WHEN (lead IS NOT NULL AND position <= 4) OR (lead IS NULL AND position <= 5) THEN 'TOP' ELSE 'SECTION' END AS role FROM sel LEFT JOIN led USING (edition_date))"""

def built(t):
    """Edition clusters, members and decisions."""

    def make():
        cl, mem = selection.edition_clusters(t.articles(heavy=True), t.sources(), t.annotations(), as_of())
        cl = cut_lineage(cl)
        return cl, mem, cut_lineage(selection.select_events(cl, pairs.features(t.articles(heavy=True), t.sources())))

    return shared(t, "editions", make)


@query("C12 B7", "SELECT CAST(edition_date AS VARCHAR) AS edition, id FROM placed")
def edition_candidates(t):
    ok = selection.eligible(t.articles(heavy=True), t.sources(), t.annotations(), as_of())
    return selection.edition_windows(ok).select(F.col("edition_date").cast("string").alias("edition"), "id")


@query("W12 G5 C18", f"""
WITH RECURSIVE {EDITION_SQL} SELECT CAST(edition_date AS VARCHAR) AS edition, cluster_id, primary_id, section, cluster_score AS score, outcome FROM dec""")
def edition_decisions(t):
    _, _, dec = built(t)
    return dec.select(
        F.col("edition_date").cast("string").alias("edition"), "item.cluster_id", "item.primary_id", "item.section", "item.score", "outcome"
    )


@query("W13 B46", f"""
WITH RECURSIVE {EDITION_SQL} SELECT CAST(edition_date AS VARCHAR) AS edition, CAST(position AS INT) AS position, cluster_id, section, role, cluster_score AS score, significance FROM events_sel""")
def edition_events(t):
    return selection.with_roles(built(t)[2]).select(
        F.col("edition_date").cast("string").alias("edition"), "position", "cluster_id", "section", "role", "score", "significance"
    )


@query("E28 C18 W12", f"""
WITH RECURSIVE {EDITION_SQL} SELECT CAST(c.edition_date AS VARCHAR) AS edition, (SELECT count(*) FROM placed p WHERE p.edition_date = c.edition_date) AS candidate_articles, count(*) AS candidate_events,
 count(*) FILTER (WHERE outcome = 'SELECTED') AS selected, count(*) FILTER (WHERE outcome = 'QUALITY_THRESHOLD') AS below_quality, count(*) FILTER (WHERE outcome = 'SOURCE_CAP') AS source_cap,
 count(*) FILTER (WHERE outcome = 'SECTION_CAP') AS section_cap, count(*) FILTER (WHERE outcome = 'DUPLICATE_SAFETY') AS duplicate_safety,
 CASE WHEN count(*) FILTER (WHERE outcome = 'SELECTED') >= 10 THEN 'READY' ELSE 'PREPARING' END AS readiness
FROM cand c LEFT JOIN step t ON t.edition_date = c.edition_date AND t.pos = c.pos GROUP BY c.edition_date""")
def edition_audit(t):
    cl, mem, dec = built(t)
    return selection.audit(dec, cl, mem).withColumn("edition", F.col("edition_date").cast("string")).drop("edition_date")


# --- evidence and prose -----------------------------------------------------------------
@query("V2 W11 B27 B28", f"""
WITH RECURSIVE {EDITION_SQL},
 sup AS (SELECT e.edition_date, e.cluster_id, e.primary_id, m.id, row_number() OVER (PARTITION BY e.edition_date, e.cluster_id ORDER BY (m.source_id IS NOT NULL AND m.source_id IS DISTINCT FROM e.source) DESC,
   (m.id IN (SELECT article_id FROM annotation)) DESC, coalesce(epoch_us(m.published_at), 0) DESC, m.id) AS r
  FROM events_sel e JOIN mem m ON m.edition_date = e.edition_date AND m.label = e.label AND m.id <> e.primary_id),
 ids AS (SELECT edition_date, cluster_id, primary_id AS id, 0 AS r FROM events_sel UNION ALL SELECT edition_date, cluster_id, id, r FROM sup WHERE r <= 3)
SELECT CAST(i.edition_date AS VARCHAR) AS edition, i.cluster_id, string_agg(CAST(i.id AS VARCHAR), ',' ORDER BY r) AS evidence_ids,
 array_to_string(list_sort(list_distinct(flatten(list(p.ent))))[1:8], '|') AS entities, coalesce(array_to_string(list_sort(list(DISTINCT s.country_code) FILTER (WHERE s.country_code IS NOT NULL)), '|'), '') AS countries
FROM ids i JOIN plain_feat p ON p.id = i.id LEFT JOIN source_dim s ON s.id = p.source_id GROUP BY 1, 2""")
def evidence_packs(t):
    _, mem, dec = built(t)
    p = evidence.packs(selection.with_roles(dec), built(t)[0], mem, t.articles(heavy=True), t.sources(), t.annotations())
    ids = F.transform("evidence_ids", lambda i: i.cast("string"))
    return p.select(
        F.col("edition_date").cast("string").alias("edition"), "cluster_id", F.array_join(ids, ",").alias("evidence_ids"),
        F.array_join("entities", "|").alias("entities"), F.array_join("countries", "|").alias("countries"),
    )


_prose = f"""prose AS (SELECT e.edition_date, e.cluster_id, e.section, e.position, e.primary_id, CASE WHEN e.primary_id % 3 = 0 THEN 'Generated: ' || e.canonical_title END AS gen,
  e.canonical_title, CASE WHEN e.primary_id % 3 = 0 THEN 'SUCCESS' ELSE 'FALLBACK' END AS status FROM events_sel e)"""


@query("V3 B28", f"""
WITH RECURSIVE {EDITION_SQL}, {_prose} SELECT CAST(edition_date AS VARCHAR) AS edition, cluster_id, coalesce(gen, canonical_title) AS headline, p.status,
 sha256(coalesce(CASE WHEN gen IS NOT NULL THEN gen END, nullif(n.summary, ''), CASE WHEN length(a.raw_summary) > 250 THEN substr(a.raw_summary, 1, 250) || '...' ELSE a.raw_summary END, a.title)) AS summary_digest
FROM prose p JOIN article a ON a.id = p.primary_id LEFT JOIN latest_success n ON n.article_id = p.primary_id""")
def event_prose(t):
    return prose(t).select(F.col("edition_date").cast("string").alias("edition"), "cluster_id", "headline", "status", F.sha2("summary", 256).alias("summary_digest"))


def prose(t):
    cl, _, dec = built(t)
    ev = selection.with_roles(dec).join(cl.select("edition_date", "cluster_id", "canonical_title"), ["edition_date", "cluster_id"])
    gen = ev.where(F.col("primary_id") % 3 == 0).select(
        "edition_date", "cluster_id", F.concat(F.lit("Generated: "), "canonical_title").alias("headline"),
        F.concat(F.lit("Generated: "), "canonical_title").alias("summary"),
    )
    return evidence.prose_or_fallback(ev, gen, t.articles(heavy=True), t.annotations())


@query("V4", f"""
WITH RECURSIVE {EDITION_SQL}, k AS (SELECT edition_date, section, count(*) AS n, string_agg(cluster_id, ',' ORDER BY position) AS ids FROM events_sel GROUP BY 1, 2)
SELECT CAST(edition_date AS VARCHAR) AS edition, 'This Daily Edition presents ' || CAST(sum(n) AS BIGINT) || ' key macro developments for ' || edition_date || '. Coverage spans ' || string_agg(section || ': ' || n, ', ' ORDER BY section)
 || '. All featured events have been verified across trusted primary sources.' AS brief, string_agg(upper(substr(section, 1, 1)) || lower(substr(section, 2)) || ' Key Developments=' || ids, ';' ORDER BY section) AS themes
FROM k GROUP BY edition_date""")
def edition_briefs(t):
    b = evidence.fallback_brief(selection.with_roles(built(t)[2]))
    themes = F.transform("themes", lambda x: F.concat(x["title"], F.lit("="), F.array_join(x["cluster_ids"], ",")))
    return b.select(F.col("edition_date").cast("string").alias("edition"), "brief", F.array_join(themes, ";").alias("themes"))


_pub = """st AS (SELECT DISTINCT edition_date, CASE WHEN day(edition_date) % 4 = 0 THEN 'PUBLISHED' ELSE 'GENERATED' END AS status, day(edition_date) % 5 <> 0 AS has_brief FROM cand),
 ev AS (SELECT edition_date, count(*) AS n, count(*) FILTER (WHERE primary_id % 7 = 0) AS bare FROM events_sel GROUP BY 1)"""


def edition_status(t):
    cl, _, dec = built(t)
    d = F.dayofmonth("edition_date")
    ed = cl.select("edition_date").distinct().select(
        "edition_date", F.when(d % 4 == 0, F.lit("PUBLISHED")).otherwise(F.lit("GENERATED")).alias("status"), (d % 5 != 0).alias("has_brief")
    )
    ready = selection.audit(dec, cl, built(t)[1]).select("edition_date", "readiness")
    return ed.join(ready, "edition_date")


@query("A14 C18", f"""
WITH RECURSIVE {EDITION_SQL}, {_pub}
SELECT CAST(edition_date AS VARCHAR) AS edition, CASE WHEN status = 'PUBLISHED' OR len(rs) = 0 THEN 'PUBLISHED' ELSE status END AS new_status, CASE WHEN status = 'PUBLISHED' THEN '' ELSE array_to_string(rs, '; ') END AS reasons FROM (
 SELECT st.*, list_filter([CASE WHEN coalesce(n, 0) < 10 THEN 'not ready' END, CASE WHEN coalesce(n, 0) = 0 THEN 'no events' END, CASE WHEN NOT has_brief THEN 'no brief' END, CASE WHEN bare > 0 THEN 'events without prose' END], lambda x: x IS NOT NULL) AS rs
 FROM st LEFT JOIN ev USING (edition_date))""")
def publish_gate(t):
    ev = selection.with_roles(built(t)[2]).select("edition_date", "cluster_id", "primary_id")
    has_prose = ev.where(F.col("primary_id") % 7 != 0).select("edition_date", "cluster_id")
    g = editions.publish_gate(edition_status(t), ev, has_prose)
    return g.select(F.col("edition_date").cast("string").alias("edition"), "new_status", F.array_join("reasons", "; ").alias("reasons"))


@query("A13", f"""
WITH RECURSIVE {EDITION_SQL}, {_pub}
SELECT CAST(e.edition_date AS VARCHAR) AS edition, cluster_id, CASE WHEN status = 'PUBLISHED' THEN 'REFUSED' ELSE 'WRITTEN' END AS outcome FROM events_sel e JOIN st USING (edition_date)""")
def snapshot_write_plan(t):
    fresh = selection.with_roles(built(t)[2]).select("edition_date", "cluster_id")
    return editions.guarded(fresh, edition_status(t)).select(F.col("edition_date").cast("string").alias("edition"), "cluster_id", "outcome")


@query("D19 D20", f"""
WITH RECURSIVE {EDITION_SQL}, {_prose}, sup AS (SELECT edition_date, label, count(*) - 1 AS k FROM mem GROUP BY 1, 2)
SELECT CAST(e.edition_date AS VARCHAR) AS edition, string_agg(e.cluster_id || ':' || e.role || ':' || sup.k, ',' ORDER BY e.position) AS events, count(*) AS n_events,
 CAST(sum(article_count) AS BIGINT) AS articles, coalesce(max(CASE WHEN e.role = 'LEAD' THEN coalesce(p.gen, p.canonical_title) END), 'Daily Edition') AS lead_headline
FROM events_sel e JOIN prose p ON p.edition_date = e.edition_date AND p.cluster_id = e.cluster_id JOIN sup ON sup.edition_date = e.edition_date AND sup.label = e.label GROUP BY 1""")
def edition_pages(t):
    cl, mem, dec = built(t)
    p = editions.assemble(selection.with_roles(dec), prose(t), cl, mem)
    return p.select(F.col("edition_date").cast("string").alias("edition"), "events", "n_events", "articles", "lead_headline")


@query("E43 B19", f"""
WITH RECURSIVE {EDITION_SQL} SELECT role, section, count(*) AS n, CASE WHEN count(*) FILTER (WHERE cluster_score >= 70) = count(*) THEN 'strong' ELSE 'mixed' END AS quality FROM events_sel GROUP BY ALL""")
def lead_quality(t):
    r = selection.with_roles(built(t)[2])
    return r.groupBy("role", "section").agg(
        F.count(F.lit(1)).alias("n"), F.when(F.count_if(F.col("score") >= 70) == F.count(F.lit(1)), F.lit("strong")).otherwise(F.lit("mixed")).alias("quality")
    )


# --- article editions ----------------------------------------------------------------------
_pool = f"""pool0 AS (SELECT *, {_ld} AS edition_date FROM article WHERE eff_at <= {NOW}),
 pool AS (SELECT * FROM pool0 WHERE published_at IS NOT NULL OR edition_date IN (SELECT edition_date FROM pool0 GROUP BY 1 HAVING count(published_at) < 10)),
 rsn AS (SELECT p.*, s.trust_tier, s.country_code, n.relevance_score, n.importance_score, n.primary_category AS acat, CASE WHEN NOT coalesce(s.active, true) THEN 'inactive_source' WHEN n.article_id IS NULL THEN 'ai_failed'
   WHEN n.is_relevant = false THEN 'out_of_scope' WHEN n.is_relevant IS NULL THEN 'null_relevance' WHEN coalesce(n.primary_category, p.primary_category, s.category) IS NULL THEN 'invalid_category' ELSE 'ELIGIBLE' END AS reason
  FROM pool p LEFT JOIN source_dim s ON s.id = p.source_id LEFT JOIN latest_success n ON n.article_id = p.id)"""


@query("C13 C14", f"WITH {_pool} SELECT CAST(edition_date AS VARCHAR) AS edition, reason, count(*) AS n FROM rsn GROUP BY ALL")
def edition_exclusions(t):
    r = daily.with_reason(daily.pool(t.articles(heavy=True), as_of()), t.annotations(), t.sources())
    return r.groupBy(F.col("edition_date").cast("string").alias("edition"), "reason").agg(F.count(F.lit(1)).alias("n"))


_age = f"((epoch_us({s.to_utc('CAST(edition_date + 1 AS TIMESTAMP) - INTERVAL 1 MICROSECOND')}) - epoch_us(eff_at)) / 3600000000.0e0)"


def _parts(nsrc, ngeo):
    return ", ".join(f"{v} AS {k}" for k, v in edition_score_sql("relevance_score", "importance_score", _age, "coalesce(trust_tier, 'useful')", nsrc, ngeo).items())


ARTICLE_EDITION_SQL = f"""{_pool},
 el AS (SELECT r.*, upper(coalesce(c.cc, country_code)) AS country, coalesce(acat, 'World') AS category, {_parts('0', '0')} FROM rsn r LEFT JOIN (SELECT article_id, min(country_code) AS cc FROM article_country GROUP BY 1) c ON c.article_id = r.id WHERE reason = 'ELIGIBLE'),
 cand AS (SELECT *, coalesce(source_id, 0) AS src, coalesce(country, 'GLOBAL') AS geo, row_number() OVER (PARTITION BY edition_date ORDER BY score DESC, id) AS pos FROM el),
 step AS (SELECT DISTINCT edition_date, CAST(0 AS BIGINT) AS pos, CAST([] AS STRUCT(src INT, cat VARCHAR, geo VARCHAR)[]) AS taken, '' AS outcome FROM el
  UNION ALL SELECT edition_date, pos, CASE WHEN outcome = 'SELECTED' THEN list_append(taken, {{'src': src, 'cat': category, 'geo': geo}}) ELSE taken END, outcome FROM (
   SELECT c.edition_date, c.pos, t.taken, c.src, c.category, c.geo, CASE WHEN len(list_filter(t.taken, lambda z: z.src = c.src)) >= 2 THEN 'source_cap' WHEN len(list_filter(t.taken, lambda z: z.cat = c.category)) >= 8 THEN 'category_cap'
     WHEN c.geo <> 'GLOBAL' AND len(list_filter(t.taken, lambda z: z.geo = c.geo)) >= 7 THEN 'country_cap' ELSE 'SELECTED' END AS outcome FROM step t JOIN cand c ON c.edition_date = t.edition_date AND c.pos = t.pos + 1 WHERE len(t.taken) < 25)),
 dec0 AS (SELECT c.*, t.outcome AS oc, count(*) FILTER (WHERE t.outcome = 'SELECTED') OVER (PARTITION BY c.edition_date) AS nsel, row_number() OVER (PARTITION BY c.edition_date, t.outcome = 'SELECTED' ORDER BY c.pos) AS rr FROM step t JOIN cand c ON c.edition_date = t.edition_date AND c.pos = t.pos),
 dec AS (SELECT * EXCLUDE (oc), CASE WHEN oc <> 'SELECTED' AND rr <= 12 - nsel THEN 'REFILLED' ELSE oc END AS outcome FROM dec0),
 ch AS (SELECT * EXCLUDE (score, recency_comp, trust_comp, raw_relevance, raw_importance, age_hours), count(*) OVER (PARTITION BY edition_date, src) AS k1, CASE WHEN country IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY edition_date, geo) END AS k2 FROM dec WHERE outcome IN ('SELECTED', 'REFILLED')),
 fin0 AS (SELECT * EXCLUDE (trust_tier), {_parts('k1', 'k2')} FROM ch),
 fin1 AS (SELECT *, row_number() OVER (PARTITION BY edition_date ORDER BY score DESC, id) AS rank FROM fin0),
 fin AS (SELECT *, rank = coalesce(min(rank) FILTER (WHERE raw_importance >= 50) OVER (PARTITION BY edition_date), 1) AS is_lead FROM fin1)"""


@query("W14", f"WITH RECURSIVE {ARTICLE_EDITION_SQL} SELECT CAST(edition_date AS VARCHAR) AS edition, id, outcome FROM dec")
def article_caps(t):
    rows = cut_lineage(daily.scored(daily.with_reason(daily.pool(t.articles(heavy=True), as_of()), t.annotations(), t.sources()), t.article_countries()))
    return daily.select_articles(rows).select(F.col("edition_date").cast("string").alias("edition"), "id", "outcome")


def finals(t):
    rows = cut_lineage(daily.scored(daily.with_reason(daily.pool(t.articles(heavy=True), as_of()), t.annotations(), t.sources()), t.article_countries()))
    return daily.rescored(rows, daily.select_articles(rows))


@query("W15 B43", f"WITH RECURSIVE {ARTICLE_EDITION_SQL} SELECT CAST(edition_date AS VARCHAR) AS edition, id, score, CAST(rank AS INT) AS rank, is_lead FROM fin")
def article_rescoring(t):
    return finals(t).select(F.col("edition_date").cast("string").alias("edition"), "id", F.col("s.score").alias("score"), "rank", "is_lead")


_map = s.case_map("lower(coalesce(acat, 'world'))", lx.EDITION_SECTIONS, "'World Watch'")


@query("W16 B44 B19", f"""
WITH RECURSIVE {ARTICLE_EDITION_SQL},
 ord AS (SELECT *, {_map} AS mapped, row_number() OVER (PARTITION BY edition_date ORDER BY rank) AS q FROM fin WHERE NOT is_lead),
 run AS (SELECT edition_date, CAST(0 AS BIGINT) AS q, 1 AS tops, 0 AS briefs, '' AS section FROM fin WHERE is_lead
  UNION ALL SELECT edition_date, q, tops + CASE WHEN section = 'Top Intelligence' THEN 1 ELSE 0 END, briefs + CASE WHEN section = 'Strategic Briefs' THEN 1 ELSE 0 END, section FROM (
   SELECT o.edition_date, o.q, r.tops, r.briefs, CASE WHEN r.tops < 3 AND o.score >= 75 THEN 'Top Intelligence' WHEN r.briefs < 4 AND o.raw_importance >= 70 THEN 'Strategic Briefs' ELSE o.mapped END AS section
   FROM run r JOIN ord o ON o.edition_date = r.edition_date AND o.q = r.q + 1))
SELECT CAST(edition_date AS VARCHAR) AS edition, id, section, CAST(position AS INT) AS position, reason FROM (
 SELECT edition_date, id, 'Top Intelligence' AS section, 1 AS position, {reason_sql()} || ' (Lead Story)' AS reason FROM fin WHERE is_lead
 UNION ALL SELECT o.edition_date, o.id, r.section, o.q + 1, {reason_sql()} FROM ord o JOIN run r ON r.edition_date = o.edition_date AND r.q = o.q)""")
def article_sections(t):
    return daily.with_sections(finals(t)).select(
        F.col("edition_date").cast("string").alias("edition"), "id", "section", "position", F.col("selection_reason").alias("reason")
    )


@query("W17")
def unique_edition_articles(t):
    rows = cut_lineage(daily.scored(daily.with_reason(daily.pool(t.articles(heavy=True), as_of()), t.annotations(), t.sources()), t.article_countries()))
    return daily.suppress_duplicates(rows).select(F.col("edition_date").cast("string").alias("edition"), "id")


@query("W18 W17 W14 W15 W16")
def article_editions(t):
    r = daily.build(t.articles(heavy=True), t.sources(), t.annotations(), t.article_countries(), as_of())
    return r.select(F.col("edition_date").cast("string").alias("edition"), "section", "position", "id", F.col("s.score").alias("score"), F.col("selection_reason").alias("reason"))


@query("E28", f"""
WITH RECURSIVE {ARTICLE_EDITION_SQL}, d AS (SELECT edition_date, 'source' AS kind, coalesce(s.name, 'Unknown Source') AS key FROM fin LEFT JOIN source_dim s ON s.id = fin.source_id
 UNION ALL SELECT edition_date, 'category', category FROM fin UNION ALL SELECT edition_date, 'country', geo FROM fin)
SELECT CAST(edition_date AS VARCHAR) AS edition, kind, key, count(*) AS n FROM d GROUP BY ALL""")
def edition_distributions(t):
    f = finals(t)
    pairs_ = F.array(
        F.struct(F.lit("source").alias("kind"), F.coalesce("source_name", F.lit("Unknown Source")).alias("key")),
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("key")),
        F.struct(F.lit("country").alias("kind"), F.coalesce("country", F.lit("GLOBAL")).alias("key")),
    )
    return f.select(F.col("edition_date").cast("string").alias("edition"), F.explode(pairs_).alias("p")).groupBy("edition", "p.kind", "p.key").agg(F.count(F.lit(1)).alias("n"))


@query("B16")
def headline_similarities(t):
    a = t.articles(heavy=True).select("id", "title")
    p = labelled_pairs(t).join(a.select(F.col("id").alias("a"), F.col("title").alias("ta")), "a").join(a.select(F.col("id").alias("b"), F.col("title").alias("tb")), "b")
    return p.select("kind", "a", "b", round_half_up(similarity.headline_similarity(F.col("ta"), F.col("tb")), 4).alias("similarity"))
