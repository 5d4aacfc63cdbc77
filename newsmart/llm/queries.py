"""One query per operator, as the contracts state them, with check SQL where SQL can express the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmart.llm import decontam, jaccard, langid, linededup, merkle, mixing, pii, secretscan, spelling, suffixdedup, topk, toxicity, urlrules
from newsmart.llm.base import in_bucket, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(plan):
        QUERIES[plan.__name__] = plan
        if sql:
            ORACLE_SQL[plan.__name__] = sql
        return plan

    return wrap


@query()
def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


@query()
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    held_out = in_bucket("doc_id", 4, 2)
    docs = table(spark, folder, "documents")
    found = langid.identify(docs, ~held_out & F.col("doc_id").isNotNull())
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query(r"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM u)),
r AS (SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(lower(host || path), '(^|[^a-z0-9])(spam-farm|cheap-pills|casino)([^a-z0-9]|$)|/(login|cart)([^a-z0-9]|$)|(^|[^a-z0-9])download[^a-z0-9].*\.exe([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM r
""")
def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urlrules.judge(table(spark, folder, "pages"), urlrules.rules_table(spark, urlrules.HOST_RULES, urlrules.PATTERN_RULES))


@query()
def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan(table(spark, folder, "documents"))


@query()
def op6_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op7_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.topk(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query()
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secretscan.scan(table(spark, folder, "documents"))


@query()
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = in_bucket("doc_id", 5, 0)
    found = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"))


@query()
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixdedup.dedup(table(spark, folder, "documents"))


#: crc32 in SQL: its table of 256 words from the polynomial, and the sum over the bytes of a string, where column ``t`` holds the table.
CRC_TABLE = "SELECT list_transform(range(256), lambda c: list_reduce(list_concat([c], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t"


def crc_sql(text: str) -> str:
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
r AS (SELECT id, translate(run, {CAPITALS}) AS run FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents)),
g AS (SELECT id || ':' || run AS s, run, count(*) AS m FROM r GROUP BY 1, 2),
h AS (SELECT run, m, {crc_sql("s")} AS h FROM g, crc),
c AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM h),
v AS (SELECT word, sum(m)::BIGINT AS n FROM c WHERE length(word) >= 7 GROUP BY 1 HAVING sum(m) >= 2),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
y AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM x),
p AS (SELECT a.word, b.word AS other, b.n FROM y a JOIN y b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT y.word, v.word, v.n FROM y JOIN v ON y.cut = v.word UNION SELECT v.word, y.word, y.n FROM y JOIN v ON y.cut = v.word),
b AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k FROM p),
f AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 10 * v.n THEN b.other END AS form, CASE WHEN b.n >= 10 * v.n THEN b.n END AS form_n FROM v LEFT JOIN b ON b.word = v.word AND b.k = 1),
w AS (SELECT word, word AS at FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM f JOIN w ON w.word = f.word JOIN f e ON e.word = w.at AND e.form IS NULL
""")
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')"
    return f"sha256({' || '.join(map(part, ['doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', text]))})"


def _siblings_sql(tree: str) -> str:
    side = lambda rows: f"coalesce(string_agg(d, '') OVER (PARTITION BY lev, g, i // 16 ORDER BY i ROWS BETWEEN {rows}), '')"
    return f"SELECT lev, g, i, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {tree} WHERE n > 1"


def _tree_sql(tree: str) -> str:
    return f"SELECT lev + 1, g, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM {tree} WHERE n > 1 GROUP BY lev, g, n, i // 16"


def _walk_sql(walk: str, siblings: str) -> str:
    step = "w.lev + 1, w.g, w.i // 16, w.proof || s.l || s.r, sha256(s.l || w.cur || s.r)"
    return f"SELECT w.g0, w.i0, {step} FROM {walk} w JOIN {siblings} s ON s.lev = w.lev AND s.g = w.g AND s.i = w.i"


@query(f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
d AS (SELECT doc_id, coalesce('=' || source, '') AS g, coalesce({crc_sql("doc_id::VARCHAR")} % 5 = 0, false) AS hit, {_leaf_sql("text")} AS leaf, {_leaf_sql(f"translate(text, {CAPITALS})")} AS low FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT 0 AS lev, g, i, n, leaf AS d FROM l UNION ALL {_tree_sql("t")}),
sub AS (SELECT g AS g0, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lev, '' AS g, i, n, subroot AS d FROM sub UNION ALL {_tree_sql("u")}),
ts AS ({_siblings_sql("t")}), us AS ({_siblings_sql("u")}),
tw AS (SELECT g AS g0, i AS i0, 0 AS lev, g, i, '' AS proof, CASE WHEN hit THEN low ELSE leaf END AS cur FROM l UNION ALL {_walk_sql("tw", "ts")}),
te AS (SELECT g0, i0, arg_max(proof, lev) AS proof, arg_max(cur, lev) AS cur FROM tw GROUP BY g0, i0),
uw AS (SELECT te.g0, i0, 0 AS lev, '' AS g, sub.i, proof, cur FROM te JOIN sub USING (g0) UNION ALL {_walk_sql("uw", "us")}),
ue AS (SELECT g0, i0, arg_max(proof, lev) AS proof, arg_max(cur, lev) AS cur FROM uw GROUP BY g0, i0)
SELECT doc_id, leaf, subroot, u.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = u.d AS verified
FROM l JOIN ue ON ue.g0 = l.g AND ue.i0 = l.i JOIN sub ON sub.g0 = l.g JOIN u ON u.n = 1
""")
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.audit(table(spark, folder, "documents"), in_bucket("doc_id", 5, 0))


@query(rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT r, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {CAPITALS}) AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
o AS (SELECT r, count(*) AS n, count(f.key) AS gone, string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL) AS kept FROM k LEFT JOIN f USING (key) GROUP BY r)
SELECT doc_id, n AS n_lines, gone AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN o USING (r)
""")
def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    clean = linededup.clean(docs, linededup.index(docs))
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
