"""Audits: explanations, retrieval losses, depth variants, citations, mappings, freshness, distributions, aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmart.functions import dates
from newsmart.operators import answers, audits, entities, evaluate, feeds, pairs, search
from newsmart.plans import clusters as cl
from newsmart.plans import feeds as feed_plans
from newsmart.plans import knowledge
from newsmart.plans import search as sp
from newsmart.plans import sqltext as s
from newsmart.plans.registry import query
from newsmart.plans.scalars import AS_OF
from newsmart.session import run_folder
from newsmart.sources import writers

NOW = "TIMESTAMP '2024-01-28 12:00:00'"


def as_of():
    return dates.ts(AS_OF)


_two = lambda c: f"printf('%.2f', {c})"


@query("G1", f"""
SELECT p.kind, c.a, c.b, score AS final_score, band AS confidence_band, {s.rnd('ts', 2)} AS title_sim, {s.rnd('es', 2)} AS entity_sim, CAST(m AS INT) AS specific_entity_matches, cm AS category_match, {s.rnd('temp', 2)} AS temporal_proximity, nc AS numeric_conflict, nm AS numeric_match,
 'Pair [' || c.a || '-' || c.b || '] Similarity: ' || {_two('score')} || ' (' || band || ') | Title Sim: ' || {_two(s.rnd('ts', 2))} || ' | Entity Sim: ' || {_two(s.rnd('es', 2))} || ' (' || CAST(m AS INT) || ' matches) | Category Match: ' || printf('%.1f', cm)
  || ' | Proximity: ' || {_two(s.rnd('temp', 2))} || ' | Numeric Conflict: ' || CASE WHEN nc THEN 'True' ELSE 'False' END AS explanation
FROM {cl.compare_sql(f"SELECT x, y FROM {cl._lab} p JOIN feat x ON x.id = p.a JOIN feat y ON y.id = p.b GROUP BY x, y")} c JOIN {cl._lab} p ON p.a = c.a AND p.b = c.b""")
def pair_explanations(t):
    feats = pairs.features(t.articles(heavy=True), t.sources(), t.annotations())
    return audits.explained(pairs.score_pairs(cl.labelled_pairs(t), feats))


# --- retrieval -----------------------------------------------------------------------
_missing = "SELECT query_id, id, core FROM gold UNION ALL SELECT query_id, id + 100000000, core FROM gold WHERE query_id % 5 = 0"
PROVENANCE_SQL = f"""{sp.ranked_sql('a')}, {sp._rec.replace("r_c", "v_c").replace("r_f", "v_f").replace("r_g", "v_g").replace("r AS (SELECT *, row_number", "v AS (SELECT *, row_number").replace("FROM r JOIN article a ON a.id = r.id", "FROM v r JOIN article a ON a.id = r.id")},
 gg AS ({_missing}),
 w AS (SELECT g.query_id, g.id, q.tokens, x.id AS xid, x.language, lower(coalesce(x.title, '')) AS ti, lower(coalesce(x.raw_summary, '')) AS su, lower(coalesce(n.summary, '')) AS nt, n.article_id AS nid, n.is_relevant, a.ord, a.rank, EXISTS (SELECT 1 FROM rec WHERE rec.query_id = g.query_id AND rec.id = g.id) AS shown
  FROM gg g JOIN q_terms q USING (query_id) LEFT JOIN article x ON x.id = g.id LEFT JOIN first_any n ON n.article_id = g.id LEFT JOIN a ON a.query_id = g.query_id AND a.id = g.id),
 pv AS (SELECT *, CASE WHEN xid IS NOT NULL THEN len(list_filter(tokens, lambda k: contains(ti, k) OR contains(su, k) OR contains(nt, k))) > 0 END AS hit FROM w),
 pc AS (SELECT *, CASE WHEN xid IS NULL THEN 'GOLD_LABEL_ISSUE' WHEN shown THEN 'SUCCESS_RETRIEVED' WHEN rank IS NULL AND len(tokens) > 0 AND NOT hit THEN CASE WHEN coalesce(language, '') NOT IN ('', 'en') THEN 'LANGUAGE_LEXICAL_GAP' ELSE 'FTS_LEXICAL_MISS' END
   WHEN rank IS NULL THEN 'CANDIDATE_LIMIT_MISS' WHEN rank > 10 THEN 'FINAL_TOP_K_TRUNCATION' ELSE 'SOURCE_DIVERSITY_EFFECT' END AS cause FROM pv)"""


def gold_with_missing(t):
    """The gold pairs, and for every fifth question also ids that are not in the archive."""
    g = sp.gold(t).select("query_id", "id", "core")
    return g.unionByName(g.where(F.col("query_id") % 5 == 0).withColumn("id", F.col("id") + 100000000))


def provenance(t):
    q = search.query_terms(search.scope_bounds(sp.scoped_questions(t)))
    ranked = evaluate.ranked_positions(sp.searched(t))
    return audits.gold_provenance(gold_with_missing(t).drop("core"), q, t.articles(heavy=True), t.annotations(), ranked, sp.records(t))


@query("E33 D21", f"""
WITH {PROVENANCE_SQL} SELECT query_id, id, hit AS matched, ord AS pool_place, rank, shown, cause, xid IS NULL OR nid IS NULL OR is_relevant IS NOT DISTINCT FROM false AS manual_review FROM pc""")
def gold_provenance(t):
    p = provenance(t)
    return p.withColumn("matched", F.when(F.col("cause") != "GOLD_LABEL_ISSUE", F.col("matched"))).withColumn("pool_place", F.col("pool_place").cast("long")).withColumn("rank", F.col("rank").cast("long"))


@query("E33", f"WITH {PROVENANCE_SQL} SELECT cause, count(*) AS n, (SELECT count(*) FROM gg) AS total, true AS reconciled FROM pc GROUP BY 1")
def failure_causes(t):
    return audits.reconciled(provenance(t), "cause")


@query("E33", f"""
WITH gg AS ({_missing}), k AS (SELECT CASE WHEN x.id IS NULL THEN 'STALE_ID_OR_DATA_DRIFT' WHEN n.article_id IS NULL THEN 'UNANALYZED' WHEN NOT coalesce(n.is_relevant, false) THEN 'OUT_OF_SCOPE' WHEN g.core THEN 'VALID_GOLD' ELSE 'WEAK_GOLD' END AS class
 FROM gg g LEFT JOIN article x ON x.id = g.id LEFT JOIN first_any n ON n.article_id = g.id) SELECT class, count(*) AS n, (SELECT count(*) FROM gg) AS total, true AS reconciled FROM k GROUP BY 1""")
def gold_classification(t):
    return audits.reconciled(audits.gold_classes(gold_with_missing(t), t.articles(), t.annotations()), "class")


@query("E35", f"""
WITH {sp.ranked_sql('a')}, d AS (SELECT * FROM (VALUES (20), (30), (40)) AS v(depth)),
 k AS (SELECT query_id, id, depth, row_number() OVER (PARTITION BY query_id, depth ORDER BY score DESC, ord) AS rank FROM a, d WHERE ord <= depth),
 e AS (SELECT g.query_id, d.depth, g.core, k.rank FROM gold g CROSS JOIN d LEFT JOIN k ON k.query_id = g.query_id AND k.id = g.id AND k.depth = d.depth),
 q AS (SELECT depth, query_id, count(*) AS n, count(rank) AS p, count(*) FILTER (WHERE rank <= 10) AS s, count(*) FILTER (WHERE core) AS c, count(*) FILTER (WHERE core AND rank <= 10) AS cs FROM e GROUP BY ALL)
SELECT depth, CAST(sum(n) AS BIGINT) AS gold_pairs, CAST(sum(p) AS BIGINT) AS in_pool, CAST(sum(s) AS BIGINT) AS shown, coalesce({s.rnd('avg(cs / c) FILTER (WHERE c > 0)', 4)}, 0.0e0) AS core_hit_rate, (SELECT count(*) FROM k WHERE k.depth = q.depth) AS candidates FROM q GROUP BY 1""")
def depth_comparison(t):
    return audits.depth_variants(sp.searched(t), sp.gold(t).select("query_id", "id", "core"), [20, 30, 40])


@query("E46", f"""
WITH {sp._rec} SELECT (SELECT count(*) FROM question_list) AS queries, count(*) AS total_citations, count(*) FILTER (WHERE canonical_url LIKE 'http%') AS valid_citations, count(*) AS evidence,
 CASE WHEN count(*) > 0 THEN {s.rnd("count(*) FILTER (WHERE canonical_url LIKE 'http%') / count(*) * 100.0e0", 1)} ELSE 100.0e0 END AS citation_accuracy_pct, (SELECT count(*) FROM question_list WHERE query_id NOT IN (SELECT query_id FROM rec)) AS without_citations FROM rec""")
def citation_rollup(t):
    return audits.citation_rollup(answers.answer_packs(t.questions(), sp.records(t)))


@query("A19 E30", f"WITH {sp._metrics} {sp._agg('category')}")
def retrieval_report(t):
    """The category table as the JSON report, written and read back."""
    path = run_folder(t.spark, "report")
    report = evaluate.run_aggregate(sp.metrics(t), "category")
    writers.write_report(report, path)
    return t.spark.read.schema(report.schema).json(path)


# --- mappings, freshness, distributions ------------------------------------------------
_no = lambda *ws: " AND ".join(f"NOT contains(t, '{w}')" for w in ws)
_map = """CASE lower(trim(category)) WHEN 'ai & technology' THEN 'TECH' WHEN 'ai' THEN 'TECH' WHEN 'technology' THEN 'TECH' WHEN 'markets & economy' THEN 'ECONOMY' WHEN 'economy' THEN 'ECONOMY' WHEN 'commodities' THEN 'BUSINESS'
  WHEN 'energy' THEN 'ENERGY' WHEN 'trade' THEN 'TRADE' WHEN 'supply chain' THEN 'TRADE' WHEN 'business' THEN 'BUSINESS' WHEN 'industry & operations' THEN 'BUSINESS' WHEN 'sustainability' THEN 'SUSTAINABILITY' ELSE 'WORLD' END"""


@query("E43 B19", f"""
WITH x AS (SELECT n.annotation_id, lower(a.title) AS t, coalesce(nullif(n.primary_category, ''), s.category, '') AS category FROM annotation n JOIN article a ON a.id = n.article_id LEFT JOIN source_dim s ON s.id = a.source_id WHERE n.status = 'success' AND n.is_relevant),
 y AS (SELECT *, {_map} AS section FROM x),
 z AS (SELECT *, {_no('energy', 'oil', 'gas', 'power')} AND section = 'ENERGY' AND contains(lower(category), 'commodities') AS goods, NOT ({_no('ai', 'software', 'tech')}) AND section = 'WORLD' AS tech, NOT ({_no('fed', 'ecb', 'inflation', 'rate')}) AND section NOT IN ('ECONOMY', 'WORLD') AS macro FROM y)
SELECT CASE WHEN goods THEN 'INCORRECT' WHEN tech THEN 'QUESTIONABLE' WHEN macro THEN 'INCORRECT' ELSE 'CORRECT' END AS verdict, section, CASE WHEN goods THEN 'commodity in energy' WHEN tech THEN 'technology in world' WHEN macro THEN 'policy outside economy' END AS reason, count(*) AS n FROM z GROUP BY ALL""")
def category_mappings(t):
    good = t.annotations().where((F.col("status") == "success") & F.col("is_relevant"))
    return audits.mapping_audit(t.articles(), t.sources(), good).groupBy("verdict", "section", "reason").agg(F.count(F.lit(1)).alias("n"))


_mins = lambda x: s.rnd(f"(epoch_us({NOW}) - epoch_us({x})) / 60000000.0e0", 1)


@query("E42", f"""
WITH {feed_plans._cand}, k AS (SELECT * FROM c WHERE ord <= 200 AND id NOT IN {feed_plans._oos}), {feed_plans._div.format(part='', bypart='')}
SELECT 'ingestion' AS stage, {_mins('max(collected_at)')} AS minutes FROM article WHERE collected_at <= {NOW} UNION ALL SELECT 'source', {_mins('max(published_at)')} FROM article WHERE published_at <= {NOW}
UNION ALL SELECT 'annotation', {_mins('max(processed_at)')} FROM annotation WHERE processed_at <= {NOW}
UNION ALL SELECT 'relevant_annotation', {_mins('max(processed_at)')} FROM annotation WHERE status = 'success' AND is_relevant AND processed_at <= {NOW}
UNION ALL SELECT 'briefing', {_mins('max(a.eff_at)')} FROM article a WHERE id IN (SELECT id FROM z WHERE position = 1)""")
def freshness_stages(t):
    feed = feeds.recent_feed(t.articles(), t.annotations(), t.sources(), as_of(), "balanced")
    return audits.freshness_stages(t.articles(), t.annotations(), feed, as_of())


_rank = lambda p: f"(SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS c FROM x) WHERE r = CAST(ceil({p}e0 * c) AS BIGINT))"


@query("E19", f"""
WITH x AS (SELECT CAST(importance_score AS DOUBLE) AS v FROM annotation WHERE importance_score IS NOT NULL)
SELECT count(v) AS n, {s.rnd('avg(v)', 4)} AS mean, min(v) AS least, max(v) AS greatest, {s.rnd('quantile_cont(v, 0.25)', 4)} AS p25, {s.rnd('quantile_cont(v, 0.5)', 4)} AS median, {s.rnd('quantile_cont(v, 0.75)', 4)} AS p75, {s.rnd('quantile_cont(v, 0.9)', 4)} AS p90,
 {_rank('0.25')} AS nearest_p25, {_rank('0.75')} AS nearest_p75, {_rank('0.90')} AS nearest_p90 FROM x""")
def score_distribution(t):
    return audits.distribution(t.annotations().where(F.col("importance_score").isNotNull()).select(F.col("importance_score").cast("double").alias("v")), "v")


@query("E40", f"""
WITH n AS (SELECT slug, name, count(*) AS n FROM kept_mention GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY slug) AS total, count(*) OVER (PARTITION BY slug) AS aliases, row_number() OVER (PARTITION BY slug ORDER BY n DESC, name) AS k FROM n)
SELECT r.slug, e.entity_type, aliases, CAST(total AS BIGINT) AS mentions, name AS top_name, {s.rnd('n / total', 4)} AS top_share FROM r JOIN (SELECT DISTINCT slug, entity_type FROM entity) e ON e.slug = r.slug WHERE k = 1""")
def alias_profile(t):
    kept = entities.first_mentions(knowledge.resolved(t)[0])
    return audits.alias_profile(kept, knowledge.resolved(t)[1].select("slug", "entity_type").distinct())
