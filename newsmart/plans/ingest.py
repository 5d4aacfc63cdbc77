"""Registry, landed feeds, ingest, keyed writes and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions import dates, entities
from newsmart.functions.text import strip
from newsmart.operators import archive, ingest
from newsmart.plans import sqltext as s
from newsmart.plans.registry import query
from newsmart.plans.scalars import _U, clean_sql, stamp
from newsmart.sources import readers, writers
from newsmart.session import run_folder

CUT = "2024-01-03 00:00:00"


def canonical_sql(u):
    kept = (
        f"list_filter(string_split(regexp_extract(trim({u}), '{_U}', 4), '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) "
        f"NOT IN {s.inlist(lx.TRACKING_KEYS)})"
    )
    path = f"regexp_replace(regexp_extract(trim({u}), '{_U}', 3), '/+$', '')"
    return (
        f"(lower(regexp_extract(trim({u}), '{_U}', 1)) || '://' || lower(regexp_extract(trim({u}), '{_U}', 2)) || CASE WHEN {path} = '' THEN '/' ELSE {path} END"
        f" || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"
    )


s.cte("normal_item", f"""
SELECT *, {canonical_sql('url')} AS canonical_url, sha256({s.normalise_title('title')}) AS title_fingerprint FROM (
 SELECT item_id, source_name, {s.strip('title')} AS title, CASE WHEN regexp_matches(trim(link), '^https?://') THEN trim(link)
   WHEN regexp_matches(trim(coalesce(guid, '')), '^https?://') THEN trim(guid) END AS url, published_at, collected_at FROM feed_item)
WHERE title <> '' AND url IS NOT NULL""")
s.cte("open_item", f"""
SELECT n.*, s.id AS source_id FROM normal_item n JOIN source_dim s ON s.name = n.source_name
WHERE active AND lower(source_type) IN {s.inlist(lx.FEED_SOURCE_TYPES)} AND feed_url IS NOT NULL""")
s.cte("old_url", f"SELECT DISTINCT canonical_url FROM open_item WHERE collected_at < TIMESTAMP '{CUT}'")
s.cte("fresh_item", f"""
SELECT * FROM open_item WHERE collected_at >= TIMESTAMP '{CUT}' AND canonical_url NOT IN (SELECT canonical_url FROM old_url)
QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY source_name, item_id) = 1""")


def split_items(t):
    """Items before the cut form the archive, the rest one batch."""
    rows = ingest.from_open_sources(ingest.normalise(t.feed_items()), t.sources())
    cut = dates.ts(CUT)
    return rows.where(F.col("collected_at") < cut), rows.where(F.col("collected_at") >= cut)


@query("A3", """
SELECT item_id, CASE WHEN regexp_matches(trim(link), '^https?://') THEN trim(link) WHEN regexp_matches(trim(coalesce(guid, '')), '^https?://') THEN trim(guid) END AS url
FROM feed_item WHERE regexp_matches(trim(link), '^https?://') OR regexp_matches(trim(coalesce(guid, '')), '^https?://')""")
def item_permalinks(t):
    from newsmart.functions.urls import permalink

    return t.feed_items().select("item_id", permalink(F.col("link"), F.col("guid")).alias("url")).where(F.col("url").isNotNull())


@query("A10 B4", "SELECT item_id, source_id, canonical_url, title_fingerprint FROM fresh_item")
def archive_append(t):
    old, batch = split_items(t)
    return ingest.new_items(batch, old).select("item_id", "source_id", "canonical_url", "title_fingerprint")


@query("A10 B2", f"""
WITH clean AS MATERIALIZED (SELECT page_id, {clean_sql('html')} AS txt FROM pages), k AS (SELECT count(*) AS k FROM pages)
SELECT f.item_id, canonical_url, f.title, clean.txt AS raw_summary FROM fresh_item f, k JOIN clean ON clean.page_id = f.item_id % k.k""")
def archive_append_clean(t):
    old, batch = split_items(t)
    return ingest.with_clean_summary(ingest.new_items(batch, old)).select("item_id", "canonical_url", "title", "raw_summary")


@query("E17", f"""
WITH b AS (SELECT source_name, count(*) AS f FROM open_item WHERE collected_at >= TIMESTAMP '{CUT}' GROUP BY 1), n AS (SELECT source_name, count(*) AS k FROM fresh_item GROUP BY 1),
 r AS (SELECT s.name, coalesce(f, 0) AS fetched, coalesce(k, 0) AS new, coalesce(f, 0) - coalesce(k, 0) AS duplicates,
  CASE WHEN NOT active THEN 'SKIPPED_INACTIVE' WHEN lower(source_type) IN {s.inlist(lx.FEED_SOURCE_TYPES)} AND feed_url IS NOT NULL THEN CASE WHEN f IS NULL THEN 'EMPTY' ELSE 'OK' END
   WHEN lower(source_type) IN {s.inlist(lx.UNSUPPORTED_SOURCE_TYPES)} THEN 'SKIPPED_UNSUPPORTED' ELSE 'UNKNOWN_TYPE' END AS status
  FROM source_dim s LEFT JOIN b ON b.source_name = s.name LEFT JOIN n ON n.source_name = s.name)
SELECT * FROM r UNION ALL SELECT 'TOTAL', CAST(sum(fetched) AS BIGINT), CAST(sum(new) AS BIGINT), CAST(sum(duplicates) AS BIGINT), 'OK' FROM r""")
def ingest_summary(t):
    old, batch = split_items(t)
    return ingest.ingest_summary(batch, ingest.new_items(batch, old), t.sources())


# --- landed formats -----------------------------------------------------------------
def _esc(c):
    for a, x in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(x))
    return c


_ctl = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


@query("A2 A3", f"""
SELECT item_id, sha256({s.strip("title")}) AS title_digest, CASE WHEN regexp_matches(trim(link), '^https?://') THEN trim(link) ELSE trim(guid) END AS url, {s.fmt_ts('coalesce(published_at, collected_at)')} AS published_at
FROM feed_item WHERE {s.strip("title")} <> '' AND (regexp_matches(trim(link), '^https?://') OR regexp_matches(trim(coalesce(guid, '')), '^https?://'))""")
def feed_xml_items(t):
    """Each item rendered as one RSS ``item`` element and read back by the feed reader."""
    rfc = lambda c: F.concat(F.date_format(c, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    el = lambda tag, c: F.coalesce(F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")), F.lit(""))
    x = F.concat(
        F.lit("<item>"), el("title", _esc(F.col("title"))), el("link", _esc(F.col("link"))), el("guid", _esc(F.col("guid"))),
        el("pubDate", rfc(F.col("published_at"))), el("updated", F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("</item>"),
    )
    return readers.parse_rss_items(t.feed_items().select("item_id", x.alias("xml"))).select(
        "item_id", F.sha2("title", 256).alias("title_digest"), "url", stamp(F.col("published_at")).alias("published_at")
    )


@query("A4", """
SELECT annotation_id, coalesce(is_relevant, NULL) AS is_relevant, primary_category, array_to_string(topics, '|') AS topics, array_to_string(countries, '|') AS countries,
 CAST(len(entities) AS INT) AS n_entities, importance_score, relevance_score FROM annotation""")
def parsed_annotations(t):
    p = readers.parse_annotations(t.annotation_json())
    return p.select(
        "annotation_id", "is_relevant", "primary_category", F.array_join("topics", "|").alias("topics"), F.array_join("countries", "|").alias("countries"),
        F.when(F.col("entities").isNotNull(), F.size("entities")).alias("n_entities"), "importance_score", "relevance_score",
    )


@query("A5", """
SELECT o_custkey AS instrument, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS close, count(*) AS n
FROM orders WHERE o_totalprice > 0 AND o_orderdate <= TIMESTAMP '2000-06-30' GROUP BY ALL""")
def price_payload_points(t):
    """Order-level payloads with null, negative and future points around the real one."""
    sec = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    payload = F.to_json(
        F.struct(
            F.col("o_custkey").alias("instrument"), F.array(sec, sec, sec, F.lit(4102444800)).alias("timestamp"),
            F.array(F.col("o_totalprice"), F.lit(None).cast("double"), -F.col("o_totalprice"), F.lit(1.0)).alias("close"),
        ),
        {"ignoreNullFields": "false"},
    )
    p = readers.parse_price_payloads(t.raw("orders").select(payload.alias("payload")), dates.ts("2000-06-30"))
    return p.groupBy("instrument", F.date_format("at", "yyyy-MM-dd").alias("day"), "close").agg(F.count(F.lit(1)).alias("n"))


@query("A7", "SELECT query_id AS id, category, question FROM question_list")
def gold_questions(t):
    """Bare lists and wrapped objects, one per passage, read by the gold-set reader."""
    item = F.array(F.struct(F.col("query_id").alias("id"), "category", "question"))
    body = F.when(F.col("query_id") % 2 == 0, F.to_json(item)).otherwise(F.to_json(F.struct(item.alias("questions"))))
    return readers.parse_gold(t.questions().select(body.alias("json")))


@query("A1", """
SELECT name, website_url, feed_url, source_type, category, trust_tier, active, country_code, source_family FROM source_dim""")
def registry_rows(t):
    """The registry as JSON text under its fixed twelve-field schema."""
    j = t.sources().select(F.to_json(F.struct(*[c for c in t.sources().columns if c != "id"])).alias("json"))
    x = j.select(F.from_json("json", readers.REGISTRY).alias("x")).select("x.*")
    return x.drop("provenance", "replacement_candidate", "notes")


# --- keyed writes ----------------------------------------------------------------------
_old = "SELECT s_suppkey AS id, 'feed-' || s_suppkey AS feed_url, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier"
_new = """SELECT CASE WHEN id % 11 = 5 THEN 'moved-' || id WHEN id % 10 = 4 THEN 'extra-' || id ELSE feed_url END AS feed_url,
  CASE WHEN id % 10 = 4 THEN 'New ' || name ELSE name END AS name, nation, CASE WHEN id % 7 = 2 THEN balance + 1 ELSE balance END AS balance FROM o WHERE id % 10 <> 3"""


def registries(t):
    o = t.raw("supplier").select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("feed-"), F.col("s_suppkey").cast("string")).alias("feed_url"),
        F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"),
    )
    i = F.col("id")
    n = o.where(i % 10 != 3).select(
        F.when(i % 11 == 5, F.concat(F.lit("moved-"), i.cast("string"))).when(i % 10 == 4, F.concat(F.lit("extra-"), i.cast("string"))).otherwise(F.col("feed_url")).alias("feed_url"),
        F.when(i % 10 == 4, F.concat(F.lit("New "), F.col("name"))).otherwise(F.col("name")).alias("name"), "nation",
        F.when(i % 7 == 2, F.col("balance") + 1).otherwise(F.col("balance")).alias("balance"),
    )
    return o, n


@query("A8", f"""
WITH o AS ({_old}), n AS ({_new}), m AS (SELECT n.*, coalesce(f.id, b.id) AS old_id FROM n LEFT JOIN o f ON f.feed_url = n.feed_url LEFT JOIN o b ON b.name = n.name)
SELECT m.old_id, m.feed_url, m.name, CASE WHEN old_id IS NULL THEN 'INSERTED' WHEN (m.feed_url, m.name, m.nation, m.balance) IS NOT DISTINCT FROM (o.feed_url, o.name, o.nation, o.balance) THEN 'UNCHANGED' ELSE 'UPDATED' END AS change_type
FROM m LEFT JOIN o ON o.id = m.old_id""")
def registry_upsert(t):
    o, n = registries(t)
    return writers.upsert_dimension(o, n, ["feed_url", "name"], ["feed_url", "name", "nation", "balance"]).select("old_id", "feed_url", "name", "change_type")


@query("A9", f"""
WITH o AS ({_old}), n AS ({_new}), g AS (SELECT * FROM o WHERE name NOT IN (SELECT name FROM n) AND feed_url NOT IN (SELECT feed_url FROM n))
SELECT *, CASE WHEN children = 0 THEN 'DELETE' ELSE 'DEACTIVATE' END AS action FROM (SELECT id, name, (SELECT count(*) FROM lineitem WHERE l_suppkey = id) AS children FROM g)""")
def registry_retire(t):
    o, n = registries(t)
    kids = t.raw("lineitem").select(F.col("l_suppkey").alias("id"))
    return writers.retire_missing(o, n, ["name", "feed_url"], kids).select("id", "name", "children", "action")


CONTRACT = {
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "summary": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "string"},
    "events": {"event_id": "bigint", "value": "double", "props": "string"},
}


@query("A11", " UNION ALL ".join(
    f"SELECT '{tb}' AS \"table\", '{c}' AS \"column\", {str(c != 'summary').lower()} AS present, {str(c not in ('summary', 'toxic')).lower()} AS type_ok, "
    + ("max(CAST(NULL AS BIGINT))" if c == "summary" else f"count(*) FILTER (WHERE {c} IS NULL)") + f" AS nulls FROM {tb}"
    for tb, cols in CONTRACT.items() for c in cols
))
def contract_report(t):
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [writers.contract_gaps(t.raw(k), k, v) for k, v in CONTRACT.items()])


_key = "article_id, provider, model, task, prompt_version"


@query("A16", f"""
WITH i AS (SELECT article_id * 2 + 2000000000 AS annotation_id, {_key}, CASE WHEN article_id % 4 = 0 THEN 'success' ELSE 'timeout' END AS status, processed_at + INTERVAL 1 DAY AS processed_at
  FROM annotation WHERE article_id % 2 = 0 UNION ALL SELECT article_id * 2 + 3000000000, article_id, provider, model, task, 'v9', 'success', processed_at FROM annotation WHERE article_id % 5 = 0 AND prompt_version = 'v1'),
 u AS (SELECT annotation_id, {_key}, status, processed_at, 0 AS inc FROM annotation UNION ALL SELECT *, 1 FROM i)
SELECT annotation_id, article_id, prompt_version, status, CASE WHEN inc = 1 THEN 'WRITTEN' ELSE 'KEPT' END AS outcome FROM u
QUALIFY row_number() OVER (PARTITION BY {_key} ORDER BY (inc = 0 AND status IN ('success', 'out_of_scope')) DESC, inc DESC, processed_at DESC, annotation_id DESC) = 1""")
def annotation_upsert(t):
    keys = ["article_id", "provider", "model", "task", "prompt_version"]
    a = t.annotations().select("annotation_id", *keys, "status", "processed_at")
    i = F.col("article_id")
    again = a.where(i % 2 == 0).withColumn("annotation_id", i * 2 + 2000000000).withColumn(
        "status", F.when(i % 4 == 0, F.lit("success")).otherwise(F.lit("timeout"))
    ).withColumn("processed_at", F.col("processed_at") + F.expr("INTERVAL 1 DAY"))
    new = a.where((i % 5 == 0) & (F.col("prompt_version") == "v1")).withColumn("annotation_id", i * 2 + 3000000000).withColumn(
        "prompt_version", F.lit("v9")
    ).withColumn("status", F.lit("success"))
    return writers.upsert_annotations(a, again.unionByName(new), keys).select("annotation_id", "article_id", "prompt_version", "status", "outcome")


@query("A17", """
WITH b AS (SELECT l_suppkey AS k, min(l_partkey) AS p, count(*) AS n, list_sort(list(l_orderkey * 10 + l_linenumber)) AS m FROM lineitem GROUP BY 1),
 a AS (SELECT l_suppkey AS k, min(l_partkey) AS p, count(*) AS n, list_sort(list(l_orderkey * 10 + l_linenumber)) AS m FROM lineitem
  WHERE l_suppkey % 10 <> 1 AND NOT (l_suppkey % 10 = 2 AND l_linenumber = 7) AND NOT (l_suppkey % 10 = 3 AND l_partkey < 100) GROUP BY 1)
SELECT coalesce(b.k, a.k) AS cluster_id, CASE WHEN a.k IS NULL THEN 'DELETED' WHEN b.k IS NULL THEN 'ADDED' WHEN a.p <> b.p THEN 'PRIMARY_CHANGED' WHEN a.m <> b.m THEN 'MEMBERS_CHANGED' ELSE 'UNCHANGED' END AS change
FROM b FULL JOIN a ON a.k = b.k""")
def membership_audit(t):
    before = t.raw("lineitem").select(
        F.col("l_suppkey").alias("cluster_id"), F.col("l_partkey").alias("primary"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("member"), "l_linenumber"
    )
    k = F.col("cluster_id") % 10
    after = before.where((k != 1) & ~((k == 2) & (F.col("l_linenumber") == 7)) & ~((k == 3) & (F.col("primary") < 100)))
    return writers.snapshot_diff(before, after, "cluster_id", "primary", "member")


@query("A18", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_remaining(t):
    done = t.raw("labels").where(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    return writers.remaining(t.raw("documents").select(F.col("doc_id").alias("id")), done)


@query("A20", """
WITH l AS (SELECT date, instrument, max((seq, close)).close AS c FROM (SELECT date, instrument, {'seq': seq, 'close': close} AS x, seq, close FROM price WHERE close > 0) GROUP BY 1, 2)
SELECT CAST(date AS VARCHAR) AS day, string_agg(CAST(instrument AS VARCHAR) || '=' || CAST(CAST(round(c * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY instrument) AS snapshot FROM l WHERE instrument IN (3, 7, 11) GROUP BY 1""".replace(
    "max((seq, close)).close", "arg_max(close, seq)").replace("(SELECT date, instrument, {'seq': seq, 'close': close} AS x, seq, close FROM price WHERE close > 0)", "(SELECT * FROM price WHERE close > 0)"))
def market_snapshot_maps(t):
    p = t.prices().where(F.col("close") > 0)
    m = writers.freeze_map(p, "date", "instrument", ["seq", "close"])
    kept = F.map_filter("snapshot", lambda k, v: k.isin(3, 7, 11))
    e = F.array_sort(F.map_entries(kept))
    text = F.transform(e, lambda x: F.concat(x["key"].cast("string"), F.lit("="), F.round(x["value"]["close"] * 100).cast("bigint").cast("string")))
    return m.select(F.col("date").cast("string").alias("day"), F.array_join(text, ",").alias("snapshot")).where(F.col("snapshot") != "")


@query("A21", """
SELECT 'TITLE' AS kind, id FROM article WHERE title ILIKE '%test%' OR title ILIKE 'the %'
UNION ALL SELECT 'URL', id FROM article WHERE NOT coalesce(title ILIKE '%test%' OR title ILIKE 'the %', false) AND canonical_url ILIKE '%STORY/99%'
UNION ALL SELECT 'ORPHAN', annotation_id FROM annotation WHERE article_id IN (SELECT id FROM article WHERE title ILIKE '%test%' OR title ILIKE 'the %' OR canonical_url ILIKE '%STORY/99%')""")
def fixture_contamination(t):
    bad = archive.fixture_rows(t.articles().select("id", "title", "canonical_url"), ["%test%", "the %"], ["%STORY/99%"])
    kept = t.articles().select("id").join(bad.select("id"), "id", "left_anti")
    orphans = t.annotations().select("annotation_id", F.col("article_id").alias("id")).join(kept, "id", "left_anti")
    return bad.select(F.col("reason").alias("kind"), "id").unionByName(orphans.select(F.lit("ORPHAN").alias("kind"), F.col("annotation_id").alias("id")))


@query("E39", f"""
SELECT CAST(collected_at AS DATE)::VARCHAR AS day, count(*) AS new_items, count(*) - count(DISTINCT canonical_url) AS duplicate_urls, count(*) FILTER (WHERE title = '' OR canonical_url = '') AS corrupt,
 {s.rnd('count(*) / 24.0e0', 4)} AS per_hour, count(*) FILTER (WHERE id NOT IN (SELECT article_id FROM annotation)) AS backlog FROM article GROUP BY 1""")
def soak_invariants(t):
    from newsmart.operators.health import soak

    return soak(t.articles(), t.annotations())


# --- streams ------------------------------------------------------------------------------
@query("S1 A10", """
SELECT item_id, source_name, canonical_url, title_fingerprint FROM normal_item QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY source_name, item_id) = 1""")
def streamed_archive(t):
    from newsmart.streaming import ingest as stream

    items = t.feed_items(t.stream("documents")).drop("summary")
    return stream.run_available(items, run_folder(t.spark, "ingest")).select("item_id", "source_name", "canonical_url", "title_fingerprint")


@query("S1 E17", """
WITH f AS (SELECT source_name, count(*) AS fetched FROM feed_item GROUP BY 1),
n AS (SELECT source_name, count(*) AS new FROM (SELECT source_name FROM normal_item QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY source_name, item_id) = 1) GROUP BY 1)
SELECT f.source_name, fetched, coalesce(new, 0) AS new, fetched - coalesce(new, 0) AS duplicates FROM f LEFT JOIN n ON n.source_name IS NOT DISTINCT FROM f.source_name""")
def streamed_counters(t):
    """Per-source counts of the streamed ingest, read back from what its micro-batches stored."""
    from newsmart.streaming import ingest as stream

    folder = run_folder(t.spark, "ingest")
    stream.run_available(t.feed_items(t.stream("documents")).drop("summary"), folder)
    return stream.counters(t.spark, folder)


_win = "(epoch_us(ts) // 1800000000 - k) * 1800"


@query("S3", f"""
SELECT {s.fmt_ts(f"TIMESTAMP '1970-01-01' + to_seconds({_win})")} AS window_start, event_type, count(*) AS n, {s.fmt_ts('max(ts)')} AS newest
FROM events, (VALUES (0), (1), (2), (3)) AS ks(k) GROUP BY 1, 2""")
def streamed_freshness(t):
    from newsmart.streaming import freshness

    e = t.stream("events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    r = freshness.run_available(e, "ts", "event_type", run_folder(t.spark, "freshness"))
    return r.select(stamp(F.col("window_start")).alias("window_start"), "event_type", "n", stamp(F.col("newest")).alias("newest"))


@query("S3", f"""
SELECT {s.fmt_ts(f"TIMESTAMP '1970-01-01' + to_seconds({_win})")} AS window_start, event_type, count(*) AS n, {s.fmt_ts('max(ts)')} AS newest
FROM events, (VALUES (0), (1), (2), (3)) AS ks(k) GROUP BY 1, 2""")
def windowed_freshness(t):
    from newsmart.streaming import freshness

    e = t.raw("events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    r = freshness.window_counts(e, "ts", "event_type")
    return r.select(stamp(F.col("window_start")).alias("window_start"), "event_type", "n", stamp(F.col("newest")).alias("newest"))


_status = "CASE event_type WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'invalid_json' ELSE 'timeout' END"


@query("S2", f"""
WITH e AS (SELECT user_id, {_status} AS status, CAST(ts AS TIMESTAMP) AS seen, event_id FROM events),
l AS (SELECT *, seen + CASE WHEN status = 'processing' THEN INTERVAL 15 MINUTE WHEN status IN ('failed', 'timeout') THEN INTERVAL 5 MINUTE END AS due FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, event_id DESC) = 1),
c AS (SELECT max(seen) AS clock FROM e)
SELECT user_id AS article_id, CASE WHEN status = 'success' THEN 'COMPLETED' WHEN status = 'invalid_json' THEN 'NON_RETRYABLE' WHEN status = 'processing' THEN CASE WHEN due <= clock THEN 'STALE' ELSE 'PROCESSING' END
  WHEN due <= clock THEN 'RETRYABLE' ELSE 'COOLDOWN' END AS state, {s.fmt_ts('CASE WHEN due <= clock THEN due ELSE seen END')} AS "at" FROM l, c""")
def streamed_job_states(t):
    """Job events from the event stream: one annotation job per user, statuses by event type."""
    from newsmart.streaming import jobstate

    kind = F.col("event_type")
    status = (
        F.when(kind == "click", F.lit("processing")).when(kind == "error", F.lit("failed")).when(kind == "purchase", F.lit("success"))
        .when(kind == "view", F.lit("invalid_json")).otherwise(F.lit("timeout"))
    )
    e = t.stream("events").select(
        F.col("user_id").alias("article_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("processed_at"), F.col("event_id").alias("seq")
    )
    return jobstate.run_available(e, run_folder(t.spark, "jobs")).select("article_id", "state", stamp(F.col("at")).alias("at"))
