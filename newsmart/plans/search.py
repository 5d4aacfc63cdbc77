"""Archive search, answers and evaluation over the question table."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions import dates
from newsmart.operators import answers, evaluate, search
from newsmart.plans import sqltext as s
from newsmart.plans.editions import EDITION_SQL
from newsmart.plans.registry import query, shared
from newsmart.plans.scalars import AS_OF, stamp
from newsmart.session import cut_lineage

NOW = f"TIMESTAMP '{AS_OF}'"
TODAY = "DATE '2024-01-28'"
POOL = 40


def as_of():
    return dates.ts(AS_OF)


def scoped_questions(t):
    q = t.questions()
    none = F.lit(None).cast("date")
    r = dates.question_dates(F.col("question"), dates.local_date(as_of()), none, none)
    low = F.lower("question")
    scope = F.when(low.contains("today"), F.lit("today")).when(low.contains("last week"), F.lit("this_week")).otherwise(F.lit("all"))
    return q.withColumn("r", r).select("query_id", "question", "passage", "category", "r.date_from", "r.date_to", scope.alias("scope"))


_rules = "[" + ", ".join(f"{{'k': {s.q(k)}, 'v': {s.arr(v)}}}" for k, v in lx.EXPANSION_RULES.items()) + "]"


def _any(p):
    return s.contains_any("q_low", p)


s.cte("q_terms", rf"""
SELECT *, CASE WHEN date_from IS NULL THEN NULL ELSE {s.to_utc('CAST(date_from AS TIMESTAMP)')} END AS from_at, CASE WHEN date_to IS NULL THEN NULL ELSE {s.to_utc('CAST(date_to + 1 AS TIMESTAMP) - INTERVAL 1 MICROSECOND')} END AS to_at,
 list_sort(list_distinct(list_filter(flatten(list_transform(list_concat(ph, sg), lambda r: r.v)), lambda e: NOT list_contains(rule_words, e) AND e <> q_low))) AS expanded,
 list_concat(list_transform(ph, lambda r: 'PHRASE:''' || r.k || ''''), list_transform(list_filter(rule_words, lambda w, i: w IN {s.inlist(lx.EXPANSION_RULES)} AND list_position(rule_words, w) = i), lambda w: 'TOKEN:''' || w || '''')) AS rules
FROM (SELECT *, list_filter({_rules}, lambda r: contains(r.k, ' ') AND contains(q_low, r.k)) AS ph, list_filter({_rules}, lambda r: list_contains(rule_words, r.k)) AS sg,
  CAST(CASE WHEN contains(q_low, 'today') THEN {TODAY} WHEN contains(q_low, 'yesterday') THEN {TODAY} - 1 WHEN {_any(lx.WEEK_PHRASES)} THEN {TODAY} - 6 WHEN {_any(lx.MONTH_PHRASES)} THEN date_trunc('month', {TODAY}) END AS DATE) AS date_from,
  CAST(CASE WHEN contains(q_low, 'today') THEN {TODAY} WHEN contains(q_low, 'yesterday') THEN {TODAY} - 1 WHEN {_any(lx.WEEK_PHRASES + lx.MONTH_PHRASES)} THEN {TODAY} END AS DATE) AS date_to
 FROM (SELECT *, list_distinct(list_filter(raw, lambda w: w NOT IN {s.inlist(lx.SEARCH_STOPWORDS)} AND length(w) > 1)) AS tokens, list_filter(raw, lambda w: length(w) > 2) AS terms,
   list_filter(regexp_extract_all(q_low, '[\p{{L}}\p{{N}}_]+'), lambda w: w NOT IN {s.inlist(lx.EXPANSION_STOPWORDS)} AND length(w) > 1) AS rule_words
  FROM (SELECT *, lower(trim(question)) AS q_low, {s.words('lower(trim(question))')} AS raw FROM question_list)))""")

_note = "lower(array_to_string(list_concat([coalesce(summary, '')], coalesce(topics, []), coalesce(countries, []), coalesce(list_transform(entities, lambda e: e.name || chr(10) || e.type), [])), chr(10)))"
s.cte("search_doc", f"""
SELECT a.id, a.eff_at, lower(concat_ws(chr(10), a.title, a.raw_summary)) || chr(10) || coalesce(n.txt, '') AS core, lower(concat_ws(chr(10), a.primary_category, s.name)) AS extra
FROM article a LEFT JOIN source_dim s ON s.id = a.source_id LEFT JOIN (SELECT article_id, string_agg({_note}, chr(10)) AS txt FROM annotation GROUP BY 1) n ON n.article_id = a.id""")


def ranked_sql(name, expansion=False, rerank=False, relevant=False):
    """CTEs ending in ``name``(query_id, id, ord, score, origin, tags, rank)."""
    rel = "AND d.id IN (SELECT article_id FROM annotation WHERE is_relevant)" if relevant else ""
    exp_match = "OR len(list_filter(q.expanded, lambda w: contains(d.core, w))) > 0" if expansion else ""
    exp_none = "AND len(q.expanded) = 0" if expansion else ""
    extra = "list_filter(q.expanded, lambda w: length(w) > 2)" if expansion else "CAST([] AS VARCHAR[])"
    body = lambda w: f"(contains(sm, {w}) OR contains(nt, {w}))"
    anyw = lambda lst, cond: f"len(list_filter({lst}, lambda w: {cond})) > 0"
    pts = f"CASE WHEN fullm THEN 50.0e0 WHEN intitle THEN 30.0e0 ELSE 0.0e0 END + CASE WHEN inbody THEN 15.0e0 ELSE 0.0e0 END"
    if rerank:
        pts += f" + len(list_filter(terms, lambda w: contains(ti, w) OR {body('w')})) * 8.0e0 + CASE WHEN len(terms) > 0 AND len(list_filter(terms, lambda w: NOT contains(ti, w))) = 0 THEN 15.0e0 ELSE 0.0e0 END"
        pts += f" + len(list_filter(ex, lambda w: contains(ti, w) OR {body('w')})) * 4.0e0"
    elif expansion:
        pts += " + CASE WHEN etitle THEN 10.0e0 ELSE 0.0e0 END + CASE WHEN ebody THEN 5.0e0 ELSE 0.0e0 END"
    direct = "(len(list_filter(terms, lambda w: contains(lower(x), w))) > 0 OR contains(lower(x), q_low))"
    pts += f" + len(list_filter(labels, lambda x: {direct})) * 15.0e0 + len(list_filter(labels, lambda x: NOT {direct} AND len(list_filter(ex, lambda w: contains(lower(x), w))) > 0)) * 5.0e0"
    wr, wi = ("0.25e0", "0.2e0") if rerank else ("0.15e0", "0.15e0")
    span = "CASE WHEN from_at IS NULL AND to_at IS NULL THEN 365.0e0 ELSE 180.0e0 END" if rerank else "180.0e0"
    trust = "CASE trust_tier WHEN 'institutional' THEN 5.0e0 WHEN 'primary' THEN 3.0e0 WHEN 'secondary' THEN 1.0e0 ELSE 0.0e0 END" if rerank else "0.0e0"
    exp_tag = "CASE WHEN etitle THEN '(exp) ' || substr(title, 1, 25) || '...' END" if expansion and not rerank else "NULL"
    return f"""{name}_c AS (SELECT * FROM (SELECT q.query_id, d.id, row_number() OVER (PARTITION BY q.query_id ORDER BY d.eff_at DESC, d.id DESC) AS ord FROM q_terms q JOIN search_doc d
   ON ((len(q.tokens) = 0 {exp_none}) OR len(list_filter(q.tokens, lambda w: contains(d.core, w) OR contains(d.extra, w))) > 0 {exp_match}) AND (q.from_at IS NULL OR d.eff_at >= q.from_at) AND (q.to_at IS NULL OR d.eff_at <= q.to_at)
   JOIN article a ON a.id = d.id WHERE (a.published_at IS NULL OR a.published_at <= {NOW}) {rel}) WHERE ord <= {POOL}),
 {name}_f AS (SELECT c.query_id, c.id, c.ord, q.terms, q.q_low, q.from_at, q.to_at, {extra} AS ex, a.title, lower(a.title) AS ti, lower(coalesce(a.raw_summary, '')) AS sm, lower(coalesce(n.summary, '')) AS nt, s.trust_tier, a.eff_at, n.relevance_score AS rs, n.importance_score AS im,
   list_concat(coalesce(list_transform(n.topics, lambda x: regexp_replace(x, '^#+', '')), []), coalesce(list_transform(n.entities, lambda x: x.name), [])) AS labels
  FROM {name}_c c JOIN q_terms q ON q.query_id = c.query_id JOIN article a ON a.id = c.id LEFT JOIN source_dim s ON s.id = a.source_id LEFT JOIN latest_any n ON n.article_id = a.id),
 {name}_g AS (SELECT *, contains(ti, q_low) AS fullm, {anyw('terms', 'contains(ti, w)')} AS intitle, {anyw('terms', body('w'))} AS inbody, {anyw('ex', 'contains(ti, w)')} AS etitle, {anyw('ex', body('w'))} AS ebody FROM {name}_f),
 {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank, count(*) OVER (PARTITION BY query_id) AS pool_size FROM (
  SELECT query_id, id, ord, {s.rnd(f"{pts} + coalesce(CAST(rs AS DOUBLE), 70.0e0) * {wr} + coalesce(CAST(im AS DOUBLE), 50.0e0) * {wi} + greatest(0.0e0, 1.0e0 - greatest(0.0e0, (epoch_us({NOW}) - epoch_us(eff_at)) / 86400000000.0e0) / {span}) * 5.0e0 + {trust}", 2)} AS score,
   CASE WHEN (fullm OR intitle OR inbody) AND (etitle OR ebody) THEN 'BOTH' WHEN fullm OR intitle OR inbody THEN 'ORIGINAL_QUERY' WHEN etitle OR ebody THEN 'EXPANSION' ELSE 'ORIGINAL_QUERY' END AS origin,
   list_filter(list_concat([CASE WHEN fullm THEN substr(title, 1, 30) || '...' END, {exp_tag}], list_filter(labels, lambda x: {direct})), lambda x, i: x IS NOT NULL) AS tags0 FROM {name}_g))"""


TAGS = "array_to_string(list_filter(tags0, lambda x, i: list_position(tags0, x) = i)[1:5], '|')"


def searched(t, **kw):
    """Ranked candidates of every question under one variant."""

    def make():
        q = scoped_questions(t)
        return cut_lineage(search.run(q, t.articles(heavy=True), t.annotations(), t.sources(), as_of(), POOL, **kw))

    return shared(t, f"search {sorted(kw)}", make)


@query("B30 B31", """
SELECT query_id, array_to_string(list_sort(tokens), '|') AS tokens, array_to_string(expanded, '|') AS expanded, array_to_string(rules, '|') AS rules,
 CASE WHEN len(rule_words) = 0 AND len(expanded) = 0 THEN trim(question) ELSE concat_ws(' | ', CASE WHEN len(rule_words) > 0 THEN '(' || array_to_string(rule_words, ' & ') || ')' END,
  CASE WHEN len(expanded) > 0 THEN '(' || array_to_string(list_transform(expanded, lambda e: replace(e, ' ', ' & ')), ' | ') || ')' END) END AS expression FROM q_terms""")
def expanded_queries(t):
    q = search.query_terms(search.scope_bounds(scoped_questions(t)))
    return q.select(
        "query_id", F.array_join(F.array_sort("tokens"), "|").alias("tokens"), F.array_join("expanded", "|").alias("expanded"),
        F.array_join("rules", "|").alias("rules"), "expression",
    )


@query("C9 W5", f"WITH {ranked_sql('r')} SELECT query_id, id, ord FROM r_c")
def search_candidates(t):
    q = search.query_terms(search.scope_bounds(scoped_questions(t)))
    rows = t.articles(heavy=True).where(dates.not_future(F.col("published_at"), as_of()))
    docs = search.searchable(rows, t.annotations(), t.sources())
    return search.candidate_pool(cut_lineage(q), docs, POOL, False).select("query_id", "id", F.col("ord").cast("bigint").alias("ord"))


_endings = ["ational", "ization", "fulness", "ousness", "iveness", "tional", "ements", "ments", "ingly", "edly", "ement", "ness", "ment", "ing", "ies", "ied", "ion", "ed", "ly", "es", "s"]


def _stem_sql(w):
    def cut(e):
        left = f"substr({w}, 1, length({w}) - {len(e)})"
        if e in ("ies", "ied"):
            return f"{left} || 'y'"
        if e in ("ing", "ed"):
            return f"CASE WHEN length({left}) > 1 AND substr({left}, -1) = substr({left}, -2, 1) AND contains('bdfgmnprt', substr({left}, -1)) THEN substr({left}, 1, length({left}) - 1) ELSE {left} END"
        return left

    return "CASE " + " ".join(f"WHEN ends_with({w}, '{e}') AND length({w}) >= {len(e) + 3} THEN {cut(e)}" for e in _endings) + f" ELSE {w} END"


@query("C10", rf"""
WITH ask AS (SELECT query_id, 'must' AS clause, unnest(list_distinct(rule_words)) AS w FROM q_terms WHERE len(rule_words) > 0 UNION ALL SELECT query_id, e, unnest(regexp_split_to_array(e, '[ -]')) FROM (SELECT query_id, unnest(expanded) AS e FROM q_terms)),
 a AS (SELECT DISTINCT query_id, clause, {_stem_sql('w')} AS stem FROM ask), need AS (SELECT query_id, clause, count(*) AS need FROM a GROUP BY 1, 2),
 txt AS (SELECT id, 'article' AS field, concat_ws(' ', title, raw_summary) AS x FROM article WHERE published_at IS NULL OR published_at <= {NOW}
  UNION ALL SELECT n.article_id, 'annotation', n.summary FROM annotation n JOIN article r ON r.id = n.article_id WHERE n.summary IS NOT NULL AND (r.published_at IS NULL OR r.published_at <= {NOW})),
 w AS (SELECT DISTINCT id, field, unnest(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}_]+')) AS w FROM txt), ix AS (SELECT DISTINCT id, field, {_stem_sql('w')} AS stem FROM w)
SELECT DISTINCT query_id, id, field FROM (SELECT a.query_id, a.clause, ix.id, ix.field, count(DISTINCT ix.stem) AS got FROM a JOIN ix ON ix.stem = a.stem GROUP BY ALL) JOIN need USING (query_id, clause) WHERE got >= need""")
def fulltext_matches(t):
    """Stemmed boolean matches of the questions' expressions on title and summary."""
    from newsmart.operators.fulltext import fulltext

    rows = t.articles(heavy=True).where(dates.not_future(F.col("published_at"), as_of()))
    return fulltext(search.query_terms(search.scope_bounds(scoped_questions(t))), rows, t.annotations()).select("query_id", "id", "field")


for _n, _kw in {"plain": {}, "expanded": {"expansion": True}, "reranked": {"expansion": True, "rerank": True}}.items():

    def _make(kw):
        def plan(t):
            p = search.paged(searched(t, **kw), 1, 10)
            return p.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "score", "origin", F.array_join("tags", "|").alias("tags"), F.col("pool_size").cast("bigint").alias("pool_size"))

        return plan

    _p = _make(_kw)
    _p.__name__ = f"search_{_n}"
    globals()[_p.__name__] = query(
        "W6 W7 W4" + (" B31 E35" if _kw else ""), f"WITH {ranked_sql('r', **_kw)} SELECT query_id, rank, id, score, origin, {TAGS} AS tags, pool_size FROM r WHERE rank <= 10"
    )(_p)


# --- answers -----------------------------------------------------------------------------
_rec = f"""{ranked_sql('r', relevant=True)},
 rec AS (SELECT r.query_id, r.rank AS number, r.id, a.title, a.canonical_url, coalesce(s.name, 'RSS Feed') AS source, a.eff_at, coalesce(CASE WHEN n.article_id IS NOT NULL THEN n.primary_category ELSE a.primary_category END, 'World') AS category
  FROM r JOIN article a ON a.id = r.id LEFT JOIN source_dim s ON s.id = a.source_id LEFT JOIN latest_any n ON n.article_id = a.id WHERE rank <= 10)"""


def records(t):
    page = search.paged(searched(t, relevant_only=True), 1, 10)
    return answers.evidence_records(page, t.articles(heavy=True), t.annotations(), t.sources())


@query("V5", f"""
WITH {_rec}, g AS (SELECT query_id, count(*) AS n, strftime(min(eff_at), '%b %d, %Y') AS lo, strftime(max(eff_at), '%b %d, %Y') AS hi, string_agg('[' || id || '] ' || title, '; ' ORDER BY number) AS b FROM rec GROUP BY 1)
SELECT q.query_id, CAST(coalesce(n, 0) AS INT) AS evidence_count, CASE WHEN lo = hi THEN lo ELSE lo || ' – ' || hi END AS date_range, CASE WHEN n IS NULL THEN 'low' ELSE 'high' END AS confidence, n IS NULL AS insufficient_evidence,
 CASE WHEN n IS NULL THEN {s.q(answers.NOTHING)} ELSE 'Based on ' || n || ' matching archive record(s): ' || b END AS answer FROM question_list q LEFT JOIN g USING (query_id)""")
def answer_packs(t):
    return answers.answer_packs(t.questions(), records(t)).select("query_id", "evidence_count", "date_range", "confidence", "insufficient_evidence", "answer")


@query("V6", f"""
WITH {_rec}, g AS (SELECT query_id, list(number ORDER BY number) AS ns, list(id ORDER BY number) AS ids FROM rec GROUP BY 1), c AS (SELECT *, [query_id % 12 + 1, query_id % 5 + 1] AS cited FROM g)
SELECT query_id, array_to_string(CASE WHEN len(list_intersect(ns, cited)) > 0 THEN list_filter(ids, lambda x, i: list_contains(cited, i)) ELSE ids END, ',') AS final_ids, CAST(len(list_distinct(list_filter(cited, lambda x: NOT list_contains(ns, x)))) AS INT) AS fake FROM c""")
def cited_answers(t):
    p = answers.answer_packs(t.questions(), records(t)).where(F.col("evidence_count") > 0)
    cited = F.array((F.col("query_id") % 12 + 1).cast("int"), (F.col("query_id") % 5 + 1).cast("int"))
    r = answers.cited_only(p.withColumn("cited", cited))
    return r.select("query_id", F.array_join(F.transform("final", lambda c: c["id"].cast("string")), ",").alias("final_ids"), F.size("fake").alias("fake"))


# --- evaluation -----------------------------------------------------------------------------
s.cte("gold", "SELECT q.query_id, d.doc_id AS id, d.doc_id % 3 <> 1 AS core FROM question_list q JOIN documents d ON contains(d.text, q.passage)")


def gold(t):
    return shared(t, "gold", lambda: _gold(t))


def _gold(t):
    g = evaluate.gold_by_passage(t.questions().select("query_id", "passage"), t.spread("documents").select("doc_id", "text"))
    split = g.where(F.col("id") % 3 == 1).select("query_id", "id", F.lit(False).alias("is_core"))
    return cut_lineage(evaluate.split_gold(g, split))


@query("V10 A7 D21", "SELECT query_id, id, core FROM gold")
def gold_pairs(t):
    return gold(t)


_metrics = f"""{_rec}, gh AS (SELECT query_id, count(*) FILTER (WHERE core) AS nc, count(*) FILTER (WHERE core AND hit) AS ch, count(*) FILTER (WHERE NOT core) AS no, count(*) FILTER (WHERE NOT core AND hit) AS oh
   FROM (SELECT g.*, EXISTS (SELECT 1 FROM rec WHERE rec.query_id = g.query_id AND rec.id = g.id) AS hit FROM gold g) GROUP BY 1),
 sc AS (SELECT query_id, category, CASE WHEN contains(q_low, 'today') THEN 'today' WHEN contains(q_low, 'last week') THEN 'this_week' ELSE 'all' END AS scope FROM q_terms),
 ev AS (SELECT rec.query_id, count(*) AS n, count(DISTINCT rec.id) AS ids, count(DISTINCT source) AS srcs, bool_or(contains(lower(rec.category), lower(sc.category))) AS ont,
   bool_and(CASE scope WHEN 'today' THEN {s.local_date('eff_at')} = {TODAY} WHEN 'this_week' THEN {s.local_date('eff_at')} BETWEEN {TODAY} - 6 AND {TODAY} ELSE true END) AS scoped FROM rec JOIN sc USING (query_id) GROUP BY 1),
 qm AS (SELECT sc.query_id, sc.category, scope, coalesce(nc, 0) > 0 AS answerable, coalesce(n, 0) AS evidence_count, CASE WHEN coalesce(nc, 0) > 0 THEN {s.rnd('ch / nc', 4)} ELSE 1.0e0 END AS core_hit_rate,
   CASE WHEN coalesce(no, 0) > 0 THEN {s.rnd('oh / no', 4)} ELSE 1.0e0 END AS optional_coverage, CASE WHEN ont THEN 1.0e0 ELSE 0.0e0 END AS topic_coverage, CASE WHEN n > 0 THEN {s.rnd('1.0e0 - ids / n', 4)} ELSE 0.0e0 END AS duplicate_rate,
   CASE WHEN n > 0 THEN {s.rnd('srcs / n', 4)} ELSE 0.0e0 END AS source_diversity, coalesce(scoped, true) AS temporal_pass, true AS citation_valid, coalesce(nc, 0) > 0 OR coalesce(n, 0) = 0 AS refusal_pass
  FROM sc LEFT JOIN gh USING (query_id) LEFT JOIN ev USING (query_id))"""


def metrics(t):
    r = cut_lineage(records(t))
    q = scoped_questions(t).select("query_id", "category", "scope")
    return evaluate.question_metrics(q, gold(t), r, answers.answer_packs(t.questions(), r), dates.local_date(as_of()))


@query("E29 D21 O1", f"WITH {_metrics} SELECT * FROM qm")
def retrieval_metrics(t):
    return metrics(t)


def _agg(group):
    g = f"{group}, " if group else ""
    return f"""SELECT {g}questions, hit_rate, temporal_pct, citation_pct, refusal_pct, avg_evidence, {s.rnd('0.25e0 * (hit_rate * 100.0e0) + 0.25e0 * temporal_pct + 0.2e0 * citation_pct + 0.2e0 * refusal_pct + 10.0e0', 2)} AS overall FROM (
 SELECT {g}count(*) AS questions, coalesce({s.rnd('avg(core_hit_rate) FILTER (WHERE answerable)', 4)}, 0.0e0) AS hit_rate, {s.rnd('count(*) FILTER (WHERE temporal_pass) / count(*) * 100.0e0', 1)} AS temporal_pct, {s.rnd('count(*) FILTER (WHERE citation_valid) / count(*) * 100.0e0', 1)} AS citation_pct,
  CASE WHEN count(*) FILTER (WHERE NOT answerable) > 0 THEN {s.rnd('count(*) FILTER (WHERE NOT answerable AND refusal_pass) / count(*) FILTER (WHERE NOT answerable) * 100.0e0', 1)} ELSE 100.0e0 END AS refusal_pct, {s.rnd('avg(evidence_count)', 2)} AS avg_evidence
 FROM qm {'GROUP BY 1' if group else ''})"""


@query("E30", f"WITH {_metrics} {_agg('category')}")
def retrieval_by_category(t):
    return evaluate.run_aggregate(metrics(t), "category")


@query("E30 E46 A19", f"WITH {_metrics} {_agg(None)}")
def retrieval_summary(t):
    return evaluate.run_aggregate(metrics(t))


_item = f"{s.rnd('CASE WHEN answerable THEN core_hit_rate * 40.0e0 + CASE WHEN citation_valid THEN 30.0e0 ELSE 0.0e0 END + CASE WHEN temporal_pass THEN 30.0e0 ELSE 0.0e0 END WHEN refusal_pass THEN 100.0e0 ELSE 0.0e0 END', 2)}"


@query("W29", f"""
WITH {_metrics}, i AS (SELECT query_id, {_item} AS item_score FROM qm)
SELECT 'strongest' AS side, * FROM (FROM i ORDER BY item_score DESC, query_id LIMIT 5) UNION ALL SELECT 'weakest', * FROM (FROM i ORDER BY item_score, query_id DESC LIMIT 5)""")
def question_extremes(t):
    return evaluate.extremes(evaluate.item_scores(metrics(t)))


_two = f"{ranked_sql('a')}, {ranked_sql('b', expansion=True, rerank=True)}"


def variants(t):
    one = lambda **kw: cut_lineage(evaluate.ranked_positions(searched(t, **kw)))
    return one(), one(expansion=True, rerank=True)


@query("W28 D21", f"""
WITH {_two} SELECT g.query_id, g.id, a.ord AS a_cand, a.rank AS a_rank, b.ord AS b_cand, b.rank AS b_rank,
 CASE WHEN coalesce(a.rank <= 10, false) AND coalesce(b.rank <= 10, false) THEN 'KEPT' WHEN coalesce(b.rank <= 10, false) THEN 'RECOVERED' WHEN coalesce(a.rank <= 10, false) THEN 'DEGRADED' ELSE 'MISSED' END AS change
FROM gold g LEFT JOIN a ON a.query_id = g.query_id AND a.id = g.id LEFT JOIN b ON b.query_id = g.query_id AND b.id = g.id""")
def gold_rank_trace(t):
    a, b = variants(t)
    return evaluate.gold_trace(gold(t).select("query_id", "id"), a, b)


@query("E33 D21", f"""
WITH {ranked_sql('a')}, f AS (SELECT CASE WHEN x.id IS NULL THEN 'NOT_IN_ARCHIVE' WHEN x.published_at > {NOW} THEN 'FUTURE_DATED' WHEN a.rank IS NULL THEN 'NOT_RETRIEVED' WHEN a.rank > 10 THEN 'RANKED_TOO_LOW' ELSE 'HIT' END AS cause
 FROM gold g LEFT JOIN article x ON x.id = g.id LEFT JOIN a ON a.query_id = g.query_id AND a.id = g.id)
SELECT cause, count(*) AS n, (SELECT count(*) FROM gold) AS total FROM f GROUP BY 1""")
def retrieval_failures(t):
    g = gold(t).select("query_id", "id")
    c = evaluate.failure_class(g, evaluate.ranked_positions(searched(t)), t.articles(heavy=True), as_of())
    return c.groupBy("cause").agg(F.count(F.lit(1)).alias("n")).withColumn("total", g.agg(F.count(F.lit(1)).alias("x")).scalar())


@query("E34 O2", f"""
WITH {ranked_sql('a')}, {ranked_sql('b', expansion=True)}, nw AS (SELECT b.query_id, count(*) AS n, count(*) FILTER (WHERE (b.query_id, b.id) IN (SELECT query_id, id FROM gold)) AS r FROM b WHERE (b.query_id, b.id) NOT IN (SELECT query_id, id FROM a) GROUP BY 1)
SELECT rule, count(*) AS triggered, CAST(coalesce(sum(n), 0) AS BIGINT) AS new_candidates, CAST(coalesce(sum(r), 0) AS BIGINT) AS gold_recovered, CAST(coalesce(sum(n), 0) - coalesce(sum(r), 0) AS BIGINT) AS false_candidates
FROM (SELECT query_id, unnest(rules) AS rule FROM q_terms) LEFT JOIN nw USING (query_id) GROUP BY 1""")
def expansion_rule_efficiency(t):
    q = search.query_terms(search.scope_bounds(scoped_questions(t)))
    return evaluate.rule_efficiency(q, searched(t), searched(t, expansion=True), gold(t))


def _variant_sql(name):
    return f"""SELECT '{name}' AS variant, (SELECT count(*) FROM {name}) AS candidates, count(*) AS gold_pairs, count(*) FILTER (WHERE r.rank IS NOT NULL) AS in_pool, count(*) FILTER (WHERE r.rank <= 10) AS shown
 FROM gold g LEFT JOIN {name} r ON r.query_id = g.query_id AND r.id = g.id"""


@query("E35", f"WITH {ranked_sql('base')}, {ranked_sql('expanded_v', expansion=True)}, {ranked_sql('reranked', expansion=True, rerank=True)} {_variant_sql('base')} UNION ALL {_variant_sql('expanded_v')} UNION ALL {_variant_sql('reranked')}")
def variant_comparison(t):
    g = gold(t).select("query_id", "id")
    parts = []
    for name, kw in (("base", {}), ("expanded_v", {"expansion": True}), ("reranked", {"expansion": True, "rerank": True})):
        r = cut_lineage(evaluate.ranked_positions(searched(t, **kw)))
        n = r.agg(F.count(F.lit(1)).alias("n")).scalar()
        j = g.join(r.select("query_id", "id", "rank", "shown"), ["query_id", "id"], "left")
        parts.append(j.agg(F.count(F.lit(1)).alias("gold_pairs"), F.count("rank").alias("in_pool"), F.count_if("shown").alias("shown")).select(F.lit(name).alias("variant"), n.alias("candidates"), "gold_pairs", "in_pool", "shown"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("E45", """
WITH g AS (SELECT query_id, id FROM gold UNION ALL SELECT query_id, id + 100000000 FROM gold WHERE query_id % 5 = 0), d AS (SELECT g.query_id, CASE WHEN a.id IS NULL THEN 'missing_article' WHEN length(coalesce(title, '')) < 10 THEN 'short_title' WHEN NOT regexp_matches(canonical_url, '^https?://') THEN 'bad_url' ELSE 'ok' END AS drift
 FROM g LEFT JOIN article a ON a.id = g.id) SELECT query_id, drift, count(*) AS n FROM d GROUP BY ALL""")
def gold_drift(t):
    g = gold(t).select("query_id", "id")
    more = g.where(F.col("query_id") % 5 == 0).select("query_id", (F.col("id") + 100000000).alias("id"))
    return evaluate.gold_drift(g.unionByName(more), t.articles(heavy=True)).groupBy("query_id", "drift").agg(F.count(F.lit(1)).alias("n"))


_dg = lambda x: f"regexp_replace({x}, '[^\\d.]', '', 'g')"
_sent = lambda x: f"len(list_filter(regexp_split_to_array({x}, '[.!?]+'), lambda z: {s.strip('z')} <> ''))"
_pre = lambda lst, label: f"list_transform(list_sort({lst}), lambda z: {s.q(label)} || z)"
GROUND_SQL = f"""{EDITION_SQL},
 sup AS (SELECT e.edition_date, e.cluster_id, m.id, row_number() OVER (PARTITION BY e.edition_date, e.cluster_id ORDER BY (m.source_id IS NOT NULL AND m.source_id IS DISTINCT FROM e.source) DESC,
   (m.id IN (SELECT article_id FROM annotation)) DESC, coalesce(epoch_us(m.published_at), 0) DESC, m.id) AS r FROM events_sel e JOIN mem m ON m.edition_date = e.edition_date AND m.label = e.label AND m.id <> e.primary_id),
 ids AS (SELECT edition_date, cluster_id, primary_id AS id, 0 AS r FROM events_sel UNION ALL SELECT edition_date, cluster_id, id, r FROM sup WHERE r <= 3),
 eb AS (SELECT i.*, a.title, coalesce(nullif(n.summary, ''), CASE WHEN length(a.raw_summary) > 250 THEN substr(a.raw_summary, 1, 250) || '...' ELSE a.raw_summary END, a.title) AS best FROM ids i JOIN article a ON a.id = i.id LEFT JOIN latest_success n ON n.article_id = i.id),
 eg AS (SELECT edition_date, cluster_id, min(id) FILTER (WHERE r = 0) AS pid, min(title) FILTER (WHERE r = 0) AS head, min(best) FILTER (WHERE r = 0) AS best, string_agg(title || ' ' || best, ' ' ORDER BY r) AS evidence, list(id ORDER BY r) AS allowed FROM eb GROUP BY 1, 2),
 e1 AS (SELECT *, {s.strip("best || CASE WHEN pid % 4 = 1 THEN ' Output rose 37.5% over the year.' ELSE '' END || CASE WHEN pid % 6 = 2 THEN ' This was forced by events.' ELSE '' END")} AS summ FROM eg),
 e2 AS (SELECT *, head || ' ' || summ AS gen, lower(evidence) AS evl FROM e1),
 e3 AS (SELECT *, {s.numeric_tokens('gen')} AS gn, {s.numeric_tokens('evidence')} AS kn FROM e2),
 ck AS (SELECT *, list_concat(list_filter([CASE WHEN head = '' THEN 'headline missing' END, CASE WHEN summ = '' THEN 'summary missing' END, CASE WHEN head <> '' AND (len({s.words('head')}) < 4 OR len({s.words('head')}) > 30) THEN 'headline length' END, CASE WHEN pid % 10 = 0 THEN 'watch source not in evidence' END], lambda z: z IS NOT NULL),
   CASE WHEN pid % 9 = 0 THEN ['unknown article 999999999'] ELSE CAST([] AS VARCHAR[]) END, {_pre(f"list_filter({s.arr(lx.SENSATIONAL_TERMS)}, lambda w: contains(lower(head), w))", 'sensational ')},
   {_pre(f"list_filter(gn, lambda w: NOT regexp_matches(w, '^[0-9]$') AND NOT list_contains(kn, w) AND {_dg('w')} <> '' AND NOT list_contains(list_transform(kn, lambda k: {_dg('k')}), {_dg('w')}))", 'unsupported number ')},
   CASE WHEN {s.contains_any('evl', lx.CAUSAL_EVIDENCE)} THEN CAST([] AS VARCHAR[]) ELSE {_pre(f"list_filter({s.arr(lx.CAUSAL_TRIGGERS)}, lambda w: contains(lower(gen), w) AND NOT contains(evl, w))", 'unsupported cause ')} END) AS errors,
   CASE WHEN {_sent('summ')} > 6 THEN 'summary length' ELSE '' END AS warnings FROM e3)"""


@query("V1 B13", f"WITH RECURSIVE {GROUND_SQL} SELECT CAST(edition_date AS VARCHAR) AS edition_date, cluster_id, len(errors) = 0 AS is_valid, array_to_string(errors, '; ') AS errors, warnings FROM ck")
def grounding_checks(t):
    return checked(t).select("edition_date", "cluster_id", "is_valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings")).withColumn(
        "edition_date", F.col("edition_date").cast("string")
    )


def checked(t):
    """Prose made from each event's own summary, with a number or cause planted in some."""
    from newsmart.operators import evidence, selection
    from newsmart.plans.editions import built

    cl, mem, dec = built(t)
    p = evidence.packs(selection.with_roles(dec), cl, mem, t.articles(heavy=True), t.sources(), t.annotations())
    i = F.get("rows", 0)
    pid = i["id"]
    text = F.array_join(F.transform("rows", lambda x: F.concat_ws(" ", x["title"], x["best"])), " ")
    planted = F.concat(
        i["best"], F.when(pid % 4 == 1, F.lit(" Output rose 37.5% over the year.")).otherwise(F.lit("")), F.when(pid % 6 == 2, F.lit(" This was forced by events.")).otherwise(F.lit(""))
    )
    rows = p.select(
        "edition_date", "cluster_id", i["title"].alias("headline"), planted.alias("summary"), F.lit(None).cast("string").alias("why"),
        F.when(pid % 5 == 0, F.lit("Next report")).alias("watch_event"), F.when(pid % 10 == 0, F.lit(-1).cast("bigint")).otherwise(pid).alias("watch_source"),
        "evidence_ids", F.when(pid % 9 == 0, F.concat("evidence_ids", F.array(F.lit(999999999).cast("bigint")))).otherwise(F.col("evidence_ids")).alias("ids"),
        F.col("evidence_ids").alias("allowed"), text.alias("evidence"),
    )
    return evidence.validate(rows)


_has = lambda p: f"count(*) FILTER (WHERE len(list_filter(errors, lambda z: starts_with(z, {s.q(p)}))) > 0)"


@query("E41 V1", f"""
WITH RECURSIVE {GROUND_SQL} SELECT count(*) AS events, count(*) FILTER (WHERE len(errors) = 0) AS valid, {_has('unsupported number')} AS unsupported_numbers, {_has('unsupported cause')} AS unsupported_causes,
 {s.rnd('count(*) FILTER (WHERE pid % 5 = 0) / count(*)', 6)} AS watch_rate FROM ck""")
def grounding_audit(t):
    from newsmart.operators import evidence

    return evidence.grounding_audit(checked(t))
