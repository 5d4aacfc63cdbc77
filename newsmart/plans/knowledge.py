"""Mentions, entities, links, timelines, signals and coverage backfill."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions import dates
from newsmart.operators import annotations as ann
from newsmart.operators import audits, backfill, clusters, entities, links, pairs, selection, signals
from newsmart.plans import editions as ed
from newsmart.plans import sqltext as s
from newsmart.plans.clusters import CLUSTERS_SQL, built as archive_clusters, compare_sql
from newsmart.plans.registry import query, shared
from newsmart.plans.scalars import AS_OF, FOLD, name_sql, slug_sql, stamp, type_sql
from newsmart.session import cut_lineage
from newsmart.sources import readers
from newsmart.sources.bind import NATION_CODES

_now = f"TIMESTAMP '{AS_OF}'"

# --- mentions ---------------------------------------------------------------------
s.cte("mention", """
WITH b AS (SELECT * FROM first_relevant), e AS (SELECT article_id, unnest(list_transform(entities, lambda x, i: {'name': trim(x.name), 'raw_type': CASE WHEN article_id % 6 = 0 THEN 'UNKNOWN' ELSE x.type END, 'context': CASE WHEN article_id % 6 = 0 THEN NULL ELSE x.context END, 'ord': i - 1})) AS m, entities, countries FROM b),
 c AS (SELECT article_id, entities, unnest(countries) AS name FROM b),
 c2 AS (SELECT article_id, name, len(entities) AS n FROM c WHERE NOT list_contains(list_transform(entities, lambda x: lower(x.name)), lower(name)))
SELECT article_id, m.name AS name, m.raw_type AS raw_type, m.context AS context, 'entities' AS field, CAST(m.ord AS BIGINT) AS ord FROM e WHERE length(m.name) > 1
UNION ALL SELECT article_id, name, 'Country', NULL, 'countries', n + row_number() OVER (PARTITION BY article_id) - 1 FROM c2""")


def mentions(t):
    j = t.annotation_json()
    first = ann.pick_annotation(t.annotations().select("article_id", "annotation_id", "status", "is_relevant", "created_at"), "first_relevant")
    kept = j.join(first.select("annotation_id"), "annotation_id", "left_semi")
    return entities.raw_mentions(readers.parse_annotations(kept.select("article_id", "output_json")))


@query("V7", "SELECT article_id, name, raw_type, context, field, count(*) AS n FROM mention GROUP BY ALL")
def raw_mentions(t):
    return mentions(t).groupBy("article_id", "name", "raw_type", "context", "field").agg(F.count(F.lit(1)).alias("n"))


def curated(t):
    n = t.countries().select(
        F.coalesce(*[F.when(F.col("code") == c, F.lit(v)) for c, v in lx.COUNTRY_NAMES.items() if c in NATION_CODES]).alias("canonical_name"),
        F.lit("COUNTRY").alias("entity_type"), F.col("code").alias("country_code"), F.array("name", F.concat(F.lit("Republic of "), "name")).alias("aliases"),
    )
    r = t.raw("region").select(
        F.concat(F.upper(F.substring("r_name", 1, 1)), F.lower(F.expr("substring(r_name, 2)"))).alias("canonical_name"), F.lit("REGION").alias("entity_type"), F.lit(None).cast("string").alias("country_code"), F.array("r_name").alias("aliases")
    )
    g = t.raw("part").select("p_brand").distinct().select(F.col("p_brand").alias("canonical_name"), F.lit("COMPANY").alias("entity_type"), F.lit(None).cast("string").alias("country_code"), F.array(F.concat("p_brand", F.lit(" Inc."))).alias("aliases"))
    return n.unionByName(r).unionByName(g)


s.cte("curated", f"""
SELECT {s.case_map('code', {c: lx.COUNTRY_NAMES[c] for c in NATION_CODES})} AS canonical_name, 'COUNTRY' AS entity_type, code AS country_code, [name, 'Republic of ' || name] AS aliases FROM country_dim
UNION ALL SELECT upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)), 'REGION', NULL, [r_name] FROM region UNION ALL SELECT DISTINCT p_brand, 'COMPANY', NULL, [p_brand || ' Inc.'] FROM part""")
s.cte("seed_entity", f"""
SELECT slug, min(canonical_name) AS canonical_name, norm, entity_type, min(country_code) AS country_code FROM (SELECT *, {slug_sql('norm', 'entity_type')} AS slug FROM (SELECT *, {name_sql(FOLD.format('canonical_name'))} AS norm FROM curated)) GROUP BY slug, norm, entity_type""")
s.cte("seed_alias", f"""
SELECT DISTINCT slug, norm_alias FROM (SELECT slug, {name_sql(FOLD.format('alias'))} AS norm_alias FROM (SELECT {slug_sql(name_sql(FOLD.format('canonical_name')), 'entity_type')} AS slug, unnest(list_concat([canonical_name], aliases)) AS alias FROM curated)) WHERE norm_alias <> ''""")


@query("D14 B21 B22", "SELECT e.slug, canonical_name, entity_type, country_code, string_agg(norm_alias, '|' ORDER BY norm_alias) AS aliases FROM seed_entity e JOIN seed_alias a ON a.slug = e.slug GROUP BY ALL")
def curated_entities(t):
    e, a = entities.seed(curated(t))
    g = a.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_set("norm_alias")), "|").alias("aliases"))
    return e.join(g, "slug").select("slug", "canonical_name", "entity_type", "country_code", "aliases")


_generic = f"(lower(name) IN {s.inlist(lx.GENERIC_TERMS)} OR length(name) <= 1)"
s.cte("form", f"""
SELECT f.*, CASE WHEN ccode IS NOT NULL OR rtype = 'COUNTRY' THEN coalesce((SELECT min(slug) FROM seed_entity e WHERE e.entity_type = 'COUNTRY' AND e.country_code = ccode), (SELECT min(slug) FROM seed_entity e WHERE e.entity_type = 'COUNTRY' AND e.norm = f.norm)) END AS s1,
 (SELECT min(slug) FROM seed_entity e WHERE e.norm = f.norm AND e.entity_type = rtype) AS s2, (SELECT min(slug) FROM seed_alias a WHERE a.norm_alias = f.norm) AS s3, (SELECT min(slug) FROM seed_entity e WHERE e.slug = new_slug) AS s4
FROM (SELECT *, {slug_sql('norm', 'rtype')} AS new_slug FROM (SELECT name, raw_type, min((article_id, ord)) AS first, {name_sql(FOLD.format('name'))} AS norm, {type_sql('raw_type')} AS rtype, {s.case_map('lower(name)', lx.COUNTRY_ALIASES)} AS ccode FROM mention WHERE NOT {_generic} GROUP BY name, raw_type) WHERE length(norm) > 1) f""")
s.cte("resolved_form", """
SELECT *, coalesce(s1, s2, s3, s4, new_slug) AS slug, CASE WHEN s1 IS NOT NULL THEN 'COUNTRY_ALIAS' WHEN s2 IS NOT NULL THEN 'EXACT_CANONICAL' WHEN s3 IS NOT NULL THEN 'CURATED_ALIAS' WHEN s4 IS NOT NULL THEN 'EXACT_CANONICAL' ELSE 'NEW_CANDIDATE' END AS method FROM form""")
s.cte("minted", """
SELECT slug, trim(name) AS canonical_name, norm, rtype AS entity_type, ccode AS country_code FROM resolved_form WHERE method = 'NEW_CANDIDATE' QUALIFY row_number() OVER (PARTITION BY slug ORDER BY first, name, raw_type) = 1""")
s.cte("entity", "SELECT slug, canonical_name, entity_type FROM seed_entity UNION ALL SELECT slug, canonical_name, entity_type FROM minted")
s.cte("resolved", """
SELECT m.*, f.slug, f.method, CASE WHEN f.method = 'COUNTRY_ALIAS' THEN 'COUNTRY' ELSE e.entity_type END AS resolved_type FROM mention m JOIN resolved_form f ON f.name = m.name AND f.raw_type = m.raw_type JOIN entity e ON e.slug = f.slug""")
s.cte("kept_mention", "SELECT * FROM resolved QUALIFY row_number() OVER (PARTITION BY article_id, slug ORDER BY ord) = 1")

def resolved(t):
    """(resolved mentions, all entities)."""

    def make():
        e, a = entities.seed(curated(t))
        e, a, m = cut_lineage(e), cut_lineage(a), cut_lineage(mentions(t))
        r, minted = entities.resolve(m, e, a)
        cols = ["slug", "canonical_name", "entity_type"]
        return cut_lineage(r), cut_lineage(e.select(*cols).unionByName(minted.select(*cols)))

    return shared(t, "entities", make)


@query("D13 B23 B35", "SELECT DISTINCT name, raw_type, slug, method, resolved_type FROM resolved")
def entity_resolution(t):
    return resolved(t)[0].select("name", "raw_type", "slug", "method", "resolved_type").distinct()


@query("V8", "SELECT article_id, slug, name, raw_type, resolved_type, method, field FROM kept_mention")
def entity_mentions(t):
    return entities.first_mentions(resolved(t)[0]).select("article_id", "slug", "name", "raw_type", "resolved_type", "method", "field")


@query("E44 V8", """
WITH el AS (SELECT DISTINCT article_id FROM annotation WHERE status = 'success' AND is_relevant), r AS (SELECT article_id, CASE WHEN article_id % 5 = 1 THEN 'ALREADY_PROCESSED' WHEN article_id NOT IN (SELECT article_id FROM mention) THEN 'NO_MENTIONS' ELSE 'PROCESSED' END AS status,
 (SELECT count(*) FROM mention m WHERE m.article_id = el.article_id) AS raw, (SELECT count(*) FROM kept_mention m WHERE m.article_id = el.article_id) AS kept FROM el)
SELECT status, count(*) AS articles, CAST(coalesce(sum(kept) FILTER (WHERE status = 'PROCESSED'), 0) AS BIGINT) AS created, CAST(coalesce(sum(raw - kept) FILTER (WHERE status = 'PROCESSED'), 0) AS BIGINT) AS rejected FROM r GROUP BY 1""")
def entity_batch_metrics(t):
    r, _ = resolved(t)
    el = t.annotations().where((F.col("status") == "success") & F.col("is_relevant")).select("article_id").distinct()
    return entities.batch_metrics(el, el.where(F.col("article_id") % 5 == 1), mentions(t), entities.first_mentions(r))


# --- links ---------------------------------------------------------------------------
LINK_SQL = f"""{CLUSTERS_SQL},
 ev0 AS (SELECT cl.cluster_id, m.slug, m.method, m.article_id, a.source_id, contains(lower(cl.canonical_title), lower(m.name)) OR contains(lower(a.title), lower(m.name)) AS th, m.article_id = cl.primary_id AS ph
  FROM kept_mention m JOIN mem a ON a.id = m.article_id JOIN cl ON cl.label = a.label),
 ev AS (SELECT cluster_id, slug, count(*) AS mentions, count(DISTINCT article_id) AS articles, greatest(1, count(DISTINCT source_id)) AS sources, bool_or(th) AS title_hit, bool_or(ph) AS primary_hit, list(DISTINCT method) AS methods FROM ev0 GROUP BY 1, 2),
 lk0 AS (SELECT ev.*, e.entity_type, e.canonical_name, CASE WHEN title_hit OR primary_hit THEN 'PRIMARY_EXPLICIT' WHEN articles >= 2 OR sources >= 2 THEN 'MULTI_ARTICLE' ELSE 'INCIDENTAL' END AS evidence_class,
  CASE WHEN entity_type = 'CENTRAL_BANK' THEN 'ISSUER' WHEN entity_type IN ('COUNTRY', 'REGION') THEN 'LOCATION' WHEN entity_type IN ('COMMODITY', 'PRODUCT', 'TECHNOLOGY') THEN 'SUBJECT' WHEN entity_type = 'GOVERNMENT_BODY' AND (title_hit OR primary_hit) THEN 'ISSUER'
   WHEN entity_type IN ('COMPANY', 'PERSON') AND (title_hit OR primary_hit) THEN 'ACTOR' ELSE 'MENTIONED' END AS role,
  CASE WHEN title_hit THEN 'TITLE_MATCH' WHEN primary_hit THEN 'PRIMARY_ARTICLE_EXPLICIT' WHEN articles >= 2 THEN 'MULTI_ARTICLE_CORROBORATED' WHEN list_contains(methods, 'CURATED_ALIAS') THEN 'MANUAL_ALIAS_RESOLVED' ELSE 'STRUCTURED_ROLE' END AS link_method FROM ev JOIN entity e ON e.slug = ev.slug),
 lk AS (SELECT *, evidence_class = 'INCIDENTAL' AND NOT title_hit AND NOT primary_hit AND articles < 2 AS rejected FROM lk0)"""


def linked(t):
    """(clusters, members, links)."""

    def make():
        c, m = archive_clusters(t)
        r, e = resolved(t)
        ev = links.evidence(entities.first_mentions(r), m, c, t.articles())
        return c, m, cut_lineage(links.link(ev, e))

    return shared(t, "links", make)


@query("E20 E21 B41 D15 D16", f"""
WITH RECURSIVE {LINK_SQL} SELECT cluster_id, slug, entity_type, mentions, articles, CAST(sources AS BIGINT) AS sources, title_hit, primary_hit, evidence_class, role, link_method, rejected FROM lk""")
def event_entities(t):
    return linked(t)[2].select(
        "cluster_id", "slug", "entity_type", "mentions", "articles", F.col("sources").cast("bigint"), "title_hit", "primary_hit", "evidence_class", "role", "link_method", "rejected"
    )


@query("E21 E20", f"""
WITH RECURSIVE {LINK_SQL} SELECT evidence_class, role, count(*) FILTER (WHERE NOT rejected) AS links_created, count(*) FILTER (WHERE rejected) AS links_rejected FROM lk GROUP BY ALL""")
def link_batch_metrics(t):
    return linked(t)[2].groupBy("evidence_class", "role").agg(F.count_if(~F.col("rejected")).alias("links_created"), F.count_if("rejected").alias("links_rejected"))


@query("E20", f"""
WITH RECURSIVE {CLUSTERS_SQL}, m AS (SELECT cl.cluster_id, k.slug, k.context, row_number() OVER (PARTITION BY cl.cluster_id, k.slug ORDER BY k.article_id) AS rn FROM kept_mention k JOIN mem a ON a.id = k.article_id JOIN cl ON cl.label = a.label WHERE k.context IS NOT NULL)
SELECT cluster_id, slug, string_agg(context, ' / ' ORDER BY rn) AS snippets FROM m WHERE rn <= 3 GROUP BY 1, 2""")
def entity_snippets(t):
    r, _ = resolved(t)
    return links.snippets(entities.first_mentions(r), linked(t)[1]).select("cluster_id", "slug", F.array_join("snippets", " / ").alias("snippets"))


@query("W23 D17", f"""
WITH RECURSIVE {LINK_SQL}, one AS (SELECT slug, cluster_id, min(role) AS role FROM lk WHERE NOT rejected GROUP BY 1, 2),
 r AS (SELECT one.*, cl.canonical_title, cl.cluster_score, cl.earliest_at, row_number() OVER (PARTITION BY slug ORDER BY earliest_at DESC, cluster_score DESC, one.cluster_id DESC) AS position FROM one JOIN cl ON cl.cluster_id = one.cluster_id WHERE CAST(earliest_at AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-27')
SELECT slug, cluster_id, role, {s.fmt_ts('earliest_at')} AS event_at, cluster_score, CAST(position AS INT) AS position FROM r WHERE position <= 50""")
def entity_timelines(t):
    c, _, l = linked(t)
    none = selection.with_roles(ed.built(t)[2]).select("cluster_id", "edition_date")
    r = links.timelines(l.where(~F.col("rejected")), c, none, F.lit("2024-01-03").cast("date"), F.lit("2024-01-27").cast("date"))
    return r.select("slug", "cluster_id", "role", stamp(F.col("event_at")).alias("event_at"), "cluster_score", "position")


# --- signals ---------------------------------------------------------------------------
AS_OFS = ["2024-01-08 12:00:00", "2024-01-15 12:00:00", "2024-01-22 12:00:00", "2024-01-29 12:00:00"]
_obs = " UNION ALL ".join(f"SELECT TIMESTAMP '{x}' AS as_of" for x in AS_OFS)
SIGNAL_SQL = f"""{LINK_SQL}, obs AS ({_obs}), win AS (SELECT obs.as_of, cl.* FROM cl, obs WHERE cl.earliest_at >= as_of - INTERVAL 7 DAY AND cl.earliest_at <= as_of),
 ok AS (SELECT * FROM lk WHERE NOT rejected),
 sm AS (SELECT DISTINCT as_of, 'ENTITY_CONCENTRATION' AS signal_type, slug AS subject_key, 'entity:' || slug AS fk, canonical_name AS name, win.cluster_id, primary_source_id FROM win JOIN ok ON ok.cluster_id = win.cluster_id
  UNION ALL SELECT DISTINCT as_of, 'GEOGRAPHIC_CONCENTRATION', slug, 'geo:' || slug, canonical_name, win.cluster_id, primary_source_id FROM win JOIN ok ON ok.cluster_id = win.cluster_id WHERE entity_type IN ('COUNTRY', 'REGION')
  UNION ALL SELECT DISTINCT as_of, 'POLICY_ACTIVITY', 'policy-domain', 'domain:policy', NULL, win.cluster_id, primary_source_id FROM win WHERE category IN {s.inlist(lx.POLICY_CATEGORIES)} OR cluster_id IN (SELECT cluster_id FROM ok WHERE role IN ('ISSUER', 'LOCATION'))
  UNION ALL SELECT DISTINCT as_of, 'TECHNOLOGY_ACTIVITY', 'ai-technology', 'category:ai-technology', NULL, win.cluster_id, primary_source_id FROM win WHERE category = 'AI & Technology'),
 sg0 AS (SELECT as_of, signal_type, subject_key, fk, min(name) AS name, count(*) AS event_count, greatest(1, count(DISTINCT primary_source_id)) AS source_count, count(*) || ',' || {s.hash_sum('cluster_id')} AS ids FROM sm GROUP BY ALL),
 ecn AS (SELECT sm.as_of, signal_type, subject_key, count(DISTINCT ok.slug) AS k FROM sm JOIN ok ON ok.cluster_id = sm.cluster_id WHERE signal_type IN ('POLICY_ACTIVITY', 'TECHNOLOGY_ACTIVITY') GROUP BY ALL),
 sg AS (SELECT g.*, CASE WHEN signal_type IN ('ENTITY_CONCENTRATION', 'GEOGRAPHIC_CONCENTRATION') THEN 1 ELSE coalesce(k, 0) END AS entity_count, sha256(signal_type || ':' || fk || ':' || strftime(as_of - INTERVAL 7 DAY, '%Y-%m-%dT00:00:00Z') || ':' || strftime(as_of, '%Y-%m-%dT23:59:59Z') || ':' || ids) AS fingerprint,
   CASE signal_type WHEN 'ENTITY_CONCENTRATION' THEN 'Concentrated Event Activity: ' || name WHEN 'GEOGRAPHIC_CONCENTRATION' THEN 'Geographic Event Concentration: ' || name WHEN 'POLICY_ACTIVITY' THEN 'Concentrated Economic & Regulatory Policy Events' ELSE 'High Density AI & Technology Event Activity' END AS title
  FROM sg0 g LEFT JOIN ecn USING (as_of, signal_type, subject_key) WHERE event_count >= CASE WHEN signal_type = 'GEOGRAPHIC_CONCENTRATION' THEN 3 ELSE 2 END),
 sig AS (SELECT * FROM sg WHERE NOT regexp_matches(lower(title), '\\b({"|".join(lx.PREDICTIVE_WORDS)})\\b'))"""


def detected(t, limit=None):
    c, _, l = linked(t)
    return signals.detect(links.cluster_windows(c, [dates.ts(x) for x in AS_OFS]), l, 7, limit)


@query("V9 E22 E23 E24 E25 E26 B33 C18", f"""
WITH RECURSIVE {SIGNAL_SQL} SELECT CAST(as_of AS DATE)::VARCHAR AS day, signal_type, subject_key, event_count, source_count, CAST(entity_count AS BIGINT) AS entity_count, title, fingerprint FROM sig""")
def observed_signals(t):
    return detected(t).select(
        F.to_date("as_of").cast("string").alias("day"), "signal_type", "subject_key", "event_count", F.col("source_count").cast("bigint"), F.col("entity_count").cast("bigint"), "title", "fingerprint"
    )


@query("W24", f"""
WITH RECURSIVE {SIGNAL_SQL} SELECT CAST(as_of AS DATE)::VARCHAR AS day, CAST(row_number() OVER (PARTITION BY as_of ORDER BY event_count DESC, source_count DESC, subject_key, fingerprint) AS INT) AS position, signal_type, subject_key FROM sig
QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY event_count DESC, source_count DESC, subject_key, fingerprint) <= 8""")
def top_signals(t):
    return detected(t, 8).select(F.to_date("as_of").cast("string").alias("day"), "position", "signal_type", "subject_key")


@query("A15", f"""
WITH RECURSIVE {SIGNAL_SQL}, o AS (SELECT *, CASE WHEN event_count % 5 = 0 THEN 'ENDED' ELSE 'ACTIVE' END AS status FROM sig WHERE as_of <= TIMESTAMP '{AS_OFS[2]}'), n AS (SELECT * FROM sig WHERE as_of >= TIMESTAMP '{AS_OFS[2]}')
SELECT coalesce(n.fingerprint, o.fingerprint) AS fingerprint, coalesce(n.signal_type, o.signal_type) AS signal_type, CASE WHEN n.fingerprint IS NOT NULL THEN 'ACTIVE' WHEN o.status = 'ACTIVE' AND o.as_of < TIMESTAMP '{AS_OFS[3]}' - INTERVAL 7 DAY THEN 'ENDED' ELSE o.status END AS status,
 CASE WHEN n.fingerprint IS NOT NULL AND o.fingerprint IS NOT NULL THEN 'UPDATED' WHEN n.fingerprint IS NOT NULL THEN 'CREATED' WHEN o.status = 'ACTIVE' AND o.as_of < TIMESTAMP '{AS_OFS[3]}' - INTERVAL 7 DAY THEN 'EXPIRED' ELSE 'UNCHANGED' END AS change FROM o FULL JOIN n ON n.fingerprint = o.fingerprint""")
def signal_upsert(t):
    d = cut_lineage(detected(t).withColumn("window_end", F.col("as_of")))
    old = d.where(F.col("as_of") <= dates.ts(AS_OFS[2])).withColumn("status", F.when(F.col("event_count") % 5 == 0, F.lit("ENDED")).otherwise(F.lit("ACTIVE")))
    new = d.where(F.col("as_of") >= dates.ts(AS_OFS[2]))
    return signals.upsert(old, new, dates.ts(AS_OFS[3]) - F.expr("INTERVAL 7 DAYS")).select("fingerprint", "signal_type", "status", "change")


@query("A15 E26", f"""
WITH RECURSIVE {SIGNAL_SQL}, e AS (SELECT sig.fingerprint, sm.cluster_id, CASE WHEN sig.signal_type IN ('ENTITY_CONCENTRATION', 'GEOGRAPHIC_CONCENTRATION') THEN sig.subject_key END AS slug, sm.primary_source_id AS ps FROM sig JOIN sm USING (as_of, signal_type, subject_key))
SELECT fingerprint, cluster_id, slug FROM e WHERE NOT (ps IS NOT NULL AND ps % 2 = 0)""")
def signal_evidence(t):
    c, _, l = linked(t)
    d = cut_lineage(detected(t))
    keys = ["as_of", "signal_type", "subject_key"]
    m = signals.members(links.cluster_windows(c, [dates.ts(x) for x in AS_OFS]), l)
    e = cut_lineage(m.join(d.select(*keys, "fingerprint"), keys).select("fingerprint", "cluster_id", "slug", "primary_source_id"))
    stored = e.where(F.coalesce(F.col("primary_source_id") % 2 == 0, F.lit(False)))
    return signals.new_evidence(stored, e.select("fingerprint", "cluster_id", "slug"))


# --- coverage ------------------------------------------------------------------------------
def odd_clusters(t):
    """Clusters of half the archive, the base that the other half is attached to."""

    def make():
        half = t.articles(heavy=True).where(F.col("id") % 2 == 1)
        c, m = clusters.build(half, t.sources(), t.annotations(), dates.ts(AS_OF))
        return cut_lineage(c), half.select("id"), cut_lineage(m)

    return shared(t, "half", make)


_half = CLUSTERS_SQL.replace("SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge", "SELECT a, b FROM edge WHERE a % 2 = 1 AND b % 2 = 1 UNION ALL SELECT b, a FROM edge WHERE a % 2 = 1 AND b % 2 = 1").replace(
    "SELECT id, id AS root FROM article", "SELECT id, id AS root FROM article WHERE id % 2 = 1")


@query("D9", f"""
WITH RECURSIVE {_half} SELECT a.id, count(cl.cluster_id) AS clusters FROM article a LEFT JOIN cl ON cl.earliest_at <= a.eff_at + INTERVAL 48 HOUR AND cl.latest_at >= a.eff_at - INTERVAL 48 HOUR WHERE a.id % 2 = 0 GROUP BY 1""")
def overlapping_clusters(t):
    c, _, _ = odd_clusters(t)
    return backfill.open_clusters(t.articles().where(F.col("id") % 2 == 0), c)


_att = f"""{_half}, near AS (SELECT a AS pid, b AS id FROM {compare_sql("SELECT x, y FROM cl JOIN feat x ON x.id = cl.primary_id JOIN feat y ON y.id % 2 = 0 AND y.eff_at BETWEEN cl.earliest_at - INTERVAL 48 HOUR AND cl.latest_at + INTERVAL 48 HOUR")} WHERE band = 'HIGH_CONFIDENCE'),
 att AS (SELECT near.id, min(cl.cluster_id) AS cluster_id FROM near JOIN cl ON cl.primary_id = near.pid GROUP BY 1)"""


@query("D10 G6", f"WITH RECURSIVE {_att} SELECT id, cluster_id FROM att")
def attached_articles(t):
    return attached(t)


def attached(t):
    c, _, _ = odd_clusters(t)
    a = t.articles(heavy=True)
    todo = a.where(F.col("id") % 2 == 0)
    base = pairs.features(a, t.sources(), t.annotations()).select(F.col("id").alias("primary_id"), "pub_us", "f")
    prim = c.select("cluster_id", "primary_id", F.unix_micros("earliest_at").alias("lo_us"), F.unix_micros("latest_at").alias("hi_us")).join(base, "primary_id").drop("primary_id")
    return backfill.attach(pairs.features(todo, t.sources(), t.annotations()), prim)


_rest = f"""{_att}, rest AS (SELECT a.* FROM article a WHERE id % 2 = 0 AND id NOT IN (SELECT id FROM att)),
 sym2 AS (SELECT a, b FROM edge WHERE a IN (SELECT id FROM rest) AND b IN (SELECT id FROM rest) UNION ALL SELECT b, a FROM edge WHERE a IN (SELECT id FROM rest) AND b IN (SELECT id FROM rest)),
 walk2 AS (SELECT id, id AS root FROM rest UNION SELECT sym2.b, walk2.root FROM walk2 JOIN sym2 ON sym2.a = walk2.id WHERE walk2.root < sym2.b),
 label2 AS (SELECT id, min(root) AS label FROM walk2 GROUP BY 1), name2 AS (SELECT label, 'evt_' || label || '_' || substr(sha256(count(*) || '-' || min(id) || '-' || {s.hash_sum('id')}), 1, 16) AS cluster_id FROM label2 GROUP BY 1)"""


@query("G6 A18", f"WITH RECURSIVE {_rest} SELECT id, cluster_id, 'ATTACHED' AS how FROM att UNION ALL SELECT id, cluster_id, 'NEW' FROM label2 JOIN name2 USING (label)")
def coverage_backfill(t):
    c, half, _ = odd_clusters(t)
    return backfill.backfill(t.articles(heavy=True), t.sources(), t.annotations(), half, c)


@query("E27", f"""
WITH RECURSIVE {LINK_SQL.replace(CLUSTERS_SQL, _att)}, held AS (SELECT mem.id, cl.cluster_id FROM mem JOIN cl USING (label) UNION SELECT id, cluster_id FROM att),
 x AS (SELECT a.id, a.eff_at, coalesce(n.relevant, 0) AS relevant, coalesce(n.good, false) AND a.title IS NOT NULL AND a.canonical_url IS NOT NULL AS ok, a.id IN (SELECT id FROM held) AS c, a.id IN (SELECT article_id FROM kept_mention) AS m
  FROM article a LEFT JOIN (SELECT article_id, count(*) FILTER (WHERE is_relevant) AS relevant, bool_or(coalesce(status = 'success' AND is_relevant, false)) AS good FROM annotation GROUP BY 1) n ON n.article_id = a.id),
 p AS (SELECT period, count(*) FILTER (WHERE ok) AS n, count(*) FILTER (WHERE ok AND c) AS k FROM x, (VALUES ('7D', 7), ('14D', 14), ('30D', 30), ('All-Time', 100000)) AS v(period, days) WHERE eff_at >= {_now} - to_days(CAST(days AS INT)) GROUP BY 1),
 r AS (SELECT period, n, k, {s.rnd('k / greatest(n, 1) * 100.0e0', 2)} AS pct FROM p), o AS (SELECT count(*) FILTER (WHERE ok AND c) / greatest(count(*) FILTER (WHERE ok), 1) * 100 AS pct FROM x)
SELECT 'recency' AS part, period AS name, n, k AS covered, pct FROM r
UNION ALL SELECT 'rating', CASE WHEN o.pct >= 90 AND coalesce((SELECT pct FROM r WHERE period = '7D'), 0) >= 90 AND coalesce((SELECT pct FROM r WHERE period = '14D'), 0) >= 90 THEN 'PASS' ELSE 'NEEDS REVISION' END, 1, NULL, NULL FROM o
UNION ALL SELECT 'funnel', 'relevant_annotations', CAST(sum(relevant) AS BIGINT), NULL, NULL FROM x
UNION ALL SELECT 'funnel', 'clustering_eligible', count(*) FILTER (WHERE ok), NULL, NULL FROM x
UNION ALL SELECT 'funnel', 'represented_articles', count(*) FILTER (WHERE ok AND c), NULL, NULL FROM x
UNION ALL SELECT 'funnel', 'events', count(DISTINCT cluster_id), NULL, NULL FROM held
UNION ALL SELECT 'funnel', 'event_articles_with_mentions', count(*) FILTER (WHERE c AND m), NULL, NULL FROM x
UNION ALL SELECT 'funnel', 'events_with_entities', count(DISTINCT cluster_id), NULL, NULL FROM lk WHERE NOT rejected""")
def coverage_funnel(t):
    """The stages from annotation to linked event, where events are the clusters of half the archive and what attaches to them."""
    c, _, m = odd_clusters(t)
    kept = entities.first_mentions(resolved(t)[0])
    found = links.link(links.evidence(kept, m, c, t.articles()), resolved(t)[1])
    held = m.select(F.col("article_id").alias("id"), "cluster_id").unionByName(attached(t).select("id", "cluster_id"))
    return audits.coverage_funnel(t.articles(heavy=True), t.annotations(), cut_lineage(held), kept.select("article_id"), found.where(~F.col("rejected")), dates.ts(AS_OF))


@query("E27", f"""
WITH p AS (SELECT * FROM (VALUES ('7d', 7), ('14d', 14), ('30d', 30), ('all', NULL)) AS v(period, days))
SELECT period, count(*) AS eligible, count(*) FILTER (WHERE c) AS covered, {s.rnd('count(*) FILTER (WHERE c) / count(*) * 100.0e0', 2)} AS pct, {s.rnd('count(*) FILTER (WHERE c) / count(*) * 100.0e0', 2)} >= 95 AS passes
FROM (SELECT a.*, a.id IN (SELECT article_id FROM annotation WHERE is_relevant) AS c FROM article a) a, p WHERE a.eff_at <= TIMESTAMP '{AS_OF}' AND (days IS NULL OR a.eff_at >= TIMESTAMP '{AS_OF}' - to_days(CAST(days AS INT))) GROUP BY 1""")
def coverage_by_period(t):
    done = t.annotations().where(F.col("is_relevant")).select(F.col("article_id").alias("id"))
    return backfill.coverage(t.articles(), done, dates.ts(AS_OF))
