"""Pair scores, components, clusters and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions import dates, scoring
from newsmart.functions.numbers import round_half_up
from newsmart.operators import clusters, graph, pairs
from newsmart.plans import sqltext as s
from newsmart.plans.registry import query, shared
from newsmart.plans.scalars import AS_OF, CATEGORY_SQL, editorial_sql, stamp
from newsmart.session import cut_lineage, run_folder
from newsmart.sources import writers
from newsmart.sources.versions import VersionedTable, replace_keys_in


def _word(terms):
    return f"regexp_matches(lower(a.title), {s.q(scoring.whole_words(terms))})"


def feature_sql(names):
    return f"""SELECT a.id, a.source_id, a.title, a.eff_at, a.published_at, {s.title_tokens('a.title')} AS tok, {s.key_entities('a.title', names)} AS ent,
  {s.numeric_markers('a.title')} AS num, {_word(lx.HOLD_WORDS)} AS hold, {_word(lx.CUT_WORDS)} AS cut, {_word(lx.HIKE_WORDS)} AS hike,
  {s.contains_any('lower(a.title)', lx.EARNINGS_TERMS)} AS earn, {s.contains_any('lower(a.title)', lx.LAUNCH_TERMS)} AS launch,
  lower(coalesce(a.primary_category, s.category, '')) AS cat
 FROM article a LEFT JOIN source_dim s ON s.id = a.source_id LEFT JOIN first_relevant f ON f.article_id = a.id"""


s.cte("feat", feature_sql("list_transform(f.entities, lambda z: z.name)"))
s.cte("plain_feat", feature_sql(None))


def compare_sql(pairs_sql):
    """a/b feature rows -> score, band. ``pairs_sql`` yields columns x (feat row) and y (feat row)."""
    common = (
        "len(list_distinct(flatten(list_transform(x.ent, lambda p: list_transform(list_filter(y.ent, lambda q: p = q OR (length(p) > 3 AND length(q) > 3 "
        "AND (contains(p, q) OR contains(q, p)))), lambda q: least(p, q))))))"
    )
    return f"""(SELECT *, CASE WHEN score >= CASE WHEN m >= 2 AND nm AND NOT act THEN 0.55e0 ELSE 0.68e0 END AND NOT act THEN 'HIGH_CONFIDENCE'
   WHEN score >= 0.45e0 THEN 'AMBIGUOUS' ELSE 'LOW_CONFIDENCE' END AS band FROM (
 SELECT *, {s.rnd('''least(1.0e0, greatest(0.0e0, (CASE WHEN m >= 2 THEN ts * 0.35e0 + es * 0.45e0 + cm * 0.10e0 + temp * 0.10e0
   WHEN m = 1 THEN ts * 0.45e0 + es * 0.30e0 + cm * 0.15e0 + temp * 0.10e0 ELSE ts * 0.65e0 + cm * 0.20e0 + temp * 0.15e0 END)
   + CASE WHEN nm THEN 0.15e0 WHEN nc THEN -0.35e0 ELSE 0.0e0 END))''', 2)} AS score FROM (
 SELECT *, CASE WHEN mn > 0 THEN (inter / un + inter / mn) / 2.0e0 ELSE 0.0e0 END AS ts, CASE WHEN eu > 0 THEN m / eu ELSE 0.0e0 END AS es,
   marked AND shared AND NOT act AS nm, (marked AND NOT shared) OR act AS nc FROM (
 SELECT x.id AS a, y.id AS b, len(list_intersect(x.tok, y.tok)) AS inter, len(list_distinct(list_concat(x.tok, y.tok))) AS un, least(len(x.tok), len(y.tok)) AS mn,
   {common} AS m, len(list_distinct(list_concat(x.ent, y.ent))) AS eu,
   CASE WHEN x.cat <> '' AND x.cat = y.cat THEN 1.0e0 ELSE 0.5e0 END AS cm, len(x.num) > 0 AND len(y.num) > 0 AS marked, len(list_intersect(x.num, y.num)) > 0 AS shared,
   (x.hold AND (y.cut OR y.hike)) OR (y.hold AND (x.cut OR x.hike)) OR (x.cut AND y.hike) OR (y.cut AND x.hike) OR (x.earn AND y.launch AND NOT y.earn) OR (y.earn AND x.launch AND NOT x.earn) AS act,
   CASE WHEN x.published_at IS NULL OR y.published_at IS NULL THEN 1.0e0
     ELSE greatest(0.0e0, 1.0e0 - abs(epoch_us(x.published_at) - epoch_us(y.published_at)) / 3600000000.0e0 / 48.0e0) END AS temp
  FROM ({pairs_sql})))))"""


_bro = s.inlist(lx.BROAD_CATEGORIES)


def candidates_sql(feat="feat"):
    return f"""SELECT x, y FROM {feat} x JOIN {feat} y ON x.id < y.id AND abs(epoch_us(x.eff_at) - epoch_us(y.eff_at)) <= {pairs.WINDOW_US}
  AND (x.cat = '' OR y.cat = '' OR x.cat = y.cat OR x.cat IN {_bro} OR y.cat IN {_bro})"""


@query("D8", f"""
WITH p AS (SELECT x.id AS a, y.id AS b FROM ({candidates_sql('plain_feat')}))
SELECT id, count(a) AS partners FROM article LEFT JOIN (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) ON a = id GROUP BY 1""")
def candidate_partner_counts(t):
    return pairs.partner_counts(pairs.features(t.articles(heavy=True), t.sources()))


# consecutive articles and consecutive repeats of one title: a labelled set that grows with the archive
_lab = """(SELECT id AS a, lead(id) OVER (ORDER BY id) AS b, 'next_id' AS kind FROM article UNION ALL
 SELECT id, lead(id) OVER (PARTITION BY title ORDER BY id), 'same_title' FROM article)"""


def labelled_pairs(t):
    a = t.articles(heavy=True).select("id", "title")
    step = a.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    nxt = step.join(a.select(F.col("id").alias("b")), "b").select("a", "b", F.lit("next_id").alias("kind"))
    # a repeat's successor: the smallest larger id of the same title, found inside id ranges of fixed width
    from newsmart.operators.neighbours import next_in_group

    same = next_in_group(a, "title", "id").select(F.col("id").alias("a"), F.col("next").alias("b"), F.lit("same_title").alias("kind"))
    return nxt.unionByName(same.where(F.col("b").isNotNull()))


@query("G1 B14 B15 B16 B17", f"""
SELECT p.kind, c.a, c.b, {s.rnd('ts', 6)} AS title_sim, {s.rnd('es', 6)} AS entity_sim, CAST(m AS INT) AS matches, nm AS numeric_match, nc AS numeric_conflict, act AS action_conflict, score, band
FROM {compare_sql(f"SELECT x, y FROM {_lab} p JOIN feat x ON x.id = p.a JOIN feat y ON y.id = p.b GROUP BY x, y")} c JOIN {_lab} p ON p.a = c.a AND p.b = c.b""")
def pair_similarity(t):
    feats = pairs.features(t.articles(heavy=True), t.sources(), t.annotations())
    r = pairs.score_pairs(labelled_pairs(t), feats)
    x = F.col("s")
    return r.select(
        "kind", "a", "b", round_half_up(x["title"], 6).alias("title_sim"), round_half_up(x["e"]["ratio"], 6).alias("entity_sim"),
        x["e"]["matches"].alias("matches"), x["num_match"].alias("numeric_match"), x["num_conflict"].alias("numeric_conflict"),
        x["action"].alias("action_conflict"), "score", "band",
    )


_conf = f"""(SELECT kind = 'same_title' AS expected, band = 'HIGH_CONFIDENCE' AS predicted FROM {compare_sql(f"SELECT x, y FROM {_lab} p JOIN feat x ON x.id = p.a JOIN feat y ON y.id = p.b GROUP BY x, y")} c JOIN {_lab} p ON p.a = c.a AND p.b = c.b)"""


@query("E31", f"""
SELECT tp, fp, fn, tn, {s.rnd('tp / (tp + fp)', 6)} AS precision, {s.rnd('tp / (tp + fn)', 6)} AS recall, {s.rnd('2.0e0 * tp / (2 * tp + fp + fn)', 6)} AS f1, fp = 0 AS gate
FROM (SELECT count(*) FILTER (WHERE expected AND predicted) AS tp, count(*) FILTER (WHERE NOT expected AND predicted) AS fp,
 count(*) FILTER (WHERE expected AND NOT predicted) AS fn, count(*) FILTER (WHERE NOT expected AND NOT predicted) AS tn FROM {_conf})""")
def pair_confusion(t):
    feats = pairs.features(t.articles(heavy=True), t.sources(), t.annotations())
    r = pairs.score_pairs(labelled_pairs(t), feats).select((F.col("kind") == "same_title").alias("e"), (F.col("band") == "HIGH_CONFIDENCE").alias("p"))
    return clusters.confusion(r)


_edges = f"""edge AS (SELECT a, b FROM {compare_sql(candidates_sql())} WHERE band = 'HIGH_CONFIDENCE' OR score >= 0.70e0),
 sym AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge),
 walk AS (SELECT id, id AS root FROM article UNION SELECT sym.b, walk.root FROM walk JOIN sym ON sym.a = walk.id WHERE walk.root < sym.b),
 label AS (SELECT id, min(root) AS label FROM walk GROUP BY 1)"""


def components(t):
    return shared(t, "components", lambda: cut_lineage(clusters.assign_articles(t.articles(heavy=True), t.sources(), t.annotations(), 0.70)))


@query("G2 G5 D8", f"WITH RECURSIVE {_edges} SELECT id, label FROM label")
def article_components(t):
    return components(t)


@query("G2", """
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, p_partkey AS b FROM lineitem JOIN part ON p_partkey = l_partkey + l_suppkey),
 sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e), v AS (SELECT DISTINCT a AS id FROM sym),
 walk AS (SELECT id, id AS root FROM v UNION SELECT sym.b, walk.root FROM walk JOIN sym ON sym.a = walk.id WHERE walk.root < sym.b)
SELECT id, min(root) AS label FROM walk GROUP BY 1""")
def supply_components(t):
    """The component step on an unrelated graph with long chains."""
    li = t.raw("lineitem").select("l_partkey", "l_suppkey")
    p = t.raw("part").select(F.col("p_partkey").alias("v"))
    e = li.select(F.col("l_partkey").alias("u"), (F.col("l_partkey") + F.col("l_suppkey")).alias("v")).join(p, "v").select("u", "v")
    loops = e.select("u").union(e.select("v")).distinct().select(F.col("u").alias("id"))
    c = graph.connected_components(e)
    return loops.join(c, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


CLUSTERS_SQL = f"""{_edges},
 mem AS (SELECT l.label, a.* FROM label l JOIN article a ON a.id = l.id),
 ns AS (SELECT label, greatest(1, count(DISTINCT source_id)) AS k FROM mem GROUP BY 1),
 sc0 AS (SELECT a.label, a.id, a.title, a.source_id, a.eff_at, a.published_at, ns.k, s.source_type, n.importance_score, coalesce(n.primary_category, {CATEGORY_SQL}) AS category, {editorial_sql('n.importance_score', 'ns.k', AS_OF)}
  FROM mem a JOIN ns ON ns.label = a.label LEFT JOIN source_dim s ON s.id = a.source_id LEFT JOIN first_relevant n ON n.article_id = a.id),
 sc AS (SELECT *, {s.rnd('least(100.0e0, importance_pts + source_pts + recency_pts + strategic_pts + corroboration_pts)', 1)} AS editorial FROM sc0),
 pr AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY label ORDER BY editorial DESC, coalesce(source_type IN {s.inlist(lx.OFFICIAL_SOURCE_TYPES)}, false) DESC, coalesce(epoch_us(published_at), 0) DESC, id) = 1),
 cl AS (SELECT pr.label, 'evt_' || pr.label || '_' || substr(sha256(g.ids), 1, 16) AS cluster_id, pr.title AS canonical_title, pr.id AS primary_id, pr.category, CAST(pr.k AS INT) AS distinct_source_count, g.n AS article_count,
   {s.rnd('least(100.0e0, pr.editorial + least(15.0e0, (pr.k - 1) * 5.0e0))', 1)} AS cluster_score, pr.editorial AS primary_score, g.earliest_at, g.latest_at, pr.source_id AS primary_source_id, pr.source_type AS primary_source_type, pr.importance_score AS primary_importance
  FROM pr JOIN (SELECT label, count(*) AS n, min(eff_at) AS earliest_at, max(eff_at) AS latest_at, count(*) || '-' || min(id) || '-' || {s.hash_sum('id')} AS ids FROM mem GROUP BY 1) g ON g.label = pr.label)"""


def built(t):
    """(clusters, members) of the whole archive."""

    def make():
        c, m = clusters.build(t.articles(heavy=True), t.sources(), t.annotations(), dates.ts(AS_OF))
        return cut_lineage(c), cut_lineage(m)

    return shared(t, "clusters", make)


@query("G3 G4 G5 W10 E18 B42", f"""
WITH RECURSIVE {CLUSTERS_SQL} SELECT cluster_id, canonical_title, primary_id, category, distinct_source_count, article_count, cluster_score, primary_score,
 {s.fmt_ts('earliest_at')} AS earliest_at, {s.fmt_ts('latest_at')} AS latest_at FROM cl""")
def event_clusters(t):
    c, _ = built(t)
    return c.select(
        "cluster_id", "canonical_title", "primary_id", "category", "distinct_source_count", "article_count", "cluster_score", "primary_score",
        stamp(F.col("earliest_at")).alias("earliest_at"), stamp(F.col("latest_at")).alias("latest_at"),
    )


@query("G5 A12", f"""
WITH RECURSIVE {CLUSTERS_SQL} SELECT cluster_id, m.id AS article_id, m.id = primary_id AS is_primary, CASE WHEN m.id = primary_id THEN 'PRIMARY' ELSE 'SUPPORTING' END AS relationship,
 CASE WHEN m.id = primary_id THEN 1.0e0 ELSE 0.85e0 END AS similarity FROM mem m JOIN cl USING (label)""")
def cluster_members(t):
    return built(t)[1]


_before = "SELECT l_suppkey AS cluster_id, l_orderkey * 10 + l_linenumber AS article_id FROM lineitem"


@query("A12", f"""
WITH b AS ({_before}),
f AS (SELECT cluster_id, article_id FROM b WHERE cluster_id % 10 = 2 AND article_id % 10 <> 1 UNION ALL SELECT cluster_id + 1000000, article_id FROM b WHERE cluster_id % 10 = 4),
a AS (SELECT * FROM b WHERE cluster_id NOT IN (SELECT cluster_id FROM f) UNION ALL SELECT * FROM f),
u AS (SELECT 'before' AS stage, * FROM b UNION ALL SELECT 'crash', * FROM b UNION ALL SELECT 'after', * FROM a)
SELECT stage, cluster_id, count(*) AS members, min(article_id) AS first_member, CAST(sum(article_id) AS BIGINT) AS member_sum FROM u GROUP BY 1, 2""")
def versioned_cluster_members(t):
    """Members of re-clustered events replace the stored ones in one step: what a reader sees before the replacement, after
    a writer died between writing and publishing, and after the replacement."""
    before = t.raw("lineitem").select(F.col("l_suppkey").alias("cluster_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("article_id"))
    kept = before.where((F.col("cluster_id") % 10 == 2) & (F.col("article_id") % 10 != 1))
    fresh = kept.unionByName(before.where(F.col("cluster_id") % 10 == 4).withColumn("cluster_id", F.col("cluster_id") + 1000000))
    store = VersionedTable(t.spark, run_folder(t.spark, "members"))
    store.replace(lambda _: before)
    first = store.read(before.schema)
    store.stage(writers.replace_keys(first, fresh, "cluster_id"))  # never published
    crash = store.read(before.schema)
    replace_keys_in(store, fresh, "cluster_id")
    rows = [df.select(F.lit(stage).alias("stage"), "*") for stage, df in (("before", first), ("crash", crash), ("after", store.read(before.schema)))]
    n = [F.count(F.lit(1)).alias("members"), F.min("article_id").alias("first_member"), F.sum("article_id").alias("member_sum")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("stage", "cluster_id").agg(*n)


@query("E32", f"""
WITH RECURSIVE {_edges} SELECT CAST(sum(n) AS BIGINT) AS articles, count(*) AS clusters, count(*) FILTER (WHERE n = 1) AS singletons, count(*) FILTER (WHERE n > 1) AS multis, max(n) AS largest,
 {s.rnd('(1.0e0 - count(*) / sum(n)) * 100.0e0', 2)} AS compression_pct FROM (SELECT label, count(*) AS n FROM label GROUP BY 1)""")
def cluster_compression(t):
    sizes = components(t).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return clusters.compression(sizes)
