"""SQL text for the checks: the same binding and rules as DuckDB expressions.

Nothing here runs in a Spark job. Each query is paired with one SQL string; the
common table expressions it mentions are put in front of it.
"""

from __future__ import annotations

import re

from newsmart import lexicon as lx
from newsmart.sources import bind as b


def q(value) -> str:
    """SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]" if values else "CAST([] AS VARCHAR[])"


def inlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


def values(rows, names) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(names)}))"


def pick(vals, index: str) -> str:
    return f"({arr(vals)})[CAST(({index}) % {len(vals)} AS INT) + 1]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w_: w_ <> '')"


def contains_any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def rnd(x: str, d: int) -> str:
    s = f"1e{d}"
    return f"(floor(({x}) * {float(10**d)!r} + 0.5) / {float(10**d)!r})"


def hash_sum(x: str) -> str:
    return f"CAST(sum(CAST('0x' || substr(sha256(CAST({x} AS VARCHAR)), 1, 15) AS HUGEINT)) AS VARCHAR)"


def fmt_ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def to_local(x: str, zone: str = "Europe/London") -> str:
    return f"timezone('{zone}', timezone('UTC', {x}))"


def to_utc(x: str, zone: str = "Europe/London") -> str:
    return f"timezone('UTC', timezone('{zone}', {x}))"


def local_date(x: str) -> str:
    return f"CAST({to_local(x)} AS DATE)"


def normalise_title(x: str) -> str:
    t = rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', '', 'g')"
    return strip(rf"regexp_replace({t}, '\s+', ' ', 'g')")


def capital_runs(x: str) -> str:
    t = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s\x{{00}}-\x{{7F}}]', '.', 'g')"
    t = rf"regexp_replace({t}, '[a-zA-Z0-9]*[_\x{{80}}-\x{{10FFFF}}][a-zA-Z0-9_\x{{80}}-\x{{10FFFF}}]*', '.', 'g')"
    return rf"regexp_extract_all({t}, '\b[A-Z][a-zA-Z0-9]*(?:\s+[A-Z][a-zA-Z0-9]*)*\b')"


def alias(x: str) -> str:
    return case_map(x, lx.TOKEN_ALIASES, x)


def normalize_token(x: str, var: str = "nt") -> str:
    """Written as nested list steps so that each value is computed once."""
    low = f"lower({strip(x)})"
    step1 = f"list_transform([{low}], lambda {var}1: {alias(f'{var}1')})[1]"
    return (
        f"list_transform([{step1}], lambda {var}: CASE WHEN {var} IN {inlist(lx.INSTITUTIONS)} THEN {var} ELSE "
        f"list_transform([CASE WHEN len({words(var)}) > 1 AND ({words(var)})[-1] IN {inlist(lx.TOKEN_SUFFIXES)} "
        f"THEN array_to_string(({words(var)})[1:-2], ' ') ELSE {var} END], lambda {var}2: {alias(f'{var}2')})[1] END)[1]"
    )


def title_tokens(x: str) -> str:
    raw = words(rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')")
    kept = f"list_filter({raw}, lambda tk: tk NOT IN {inlist(lx.SAFE_STOPWORDS)})"
    spelled = f"list_transform({kept}, lambda tk: {alias('tk')})"
    return f"list_distinct({words(f'array_to_string({spelled}, chr(32))')})"


def key_entities(title: str, names: str | None = None) -> str:
    runs = (
        f"list_filter(list_transform({capital_runs(title)}, lambda r_: {normalize_token('r_')}), "
        f"lambda e_: length(e_) > 1 AND e_ NOT IN {inlist(lx.GENERIC_ENTITIES + lx.SAFE_STOPWORDS)})"
    )
    terms = (
        f"list_transform(list_filter({arr(lx.DOMAIN_TERMS)}, lambda d_: contains(lower({title}), d_)), "
        f"lambda d_: {normalize_token('d_')})"
    )
    out = f"list_concat({runs}, {terms})"
    if names:
        extra = (
            f"list_filter(list_transform(coalesce({names}, CAST([] AS VARCHAR[])), lambda n_: {normalize_token('n_')}), "
            f"lambda e_: e_ <> '' AND e_ NOT IN {inlist(lx.GENERIC_ENTITIES)})"
        )
        out = f"list_concat({extra}, {out})"
    return f"list_distinct({out})"


def numeric_markers(x: str) -> str:
    return (
        f"list_distinct(list_transform(regexp_extract_all(lower({x}), {q(lx.NUMERIC_MARKER)}), "
        f"lambda m_: regexp_replace(m_, '[, ]', '', 'g')))"
    )


def numeric_tokens(x: str) -> str:
    found = (
        f"list_transform(regexp_extract_all(lower({x}), {q(lx.NUMERIC_TOKEN)}), "
        f"lambda m_: regexp_replace(m_, '[, ]', '', 'g'))"
    )
    digits = (
        f"list_filter(list_transform({found}, lambda m_: regexp_replace(m_, '[^\\d.]', '', 'g')), lambda d_: d_ <> '')"
    )
    return f"list_distinct(list_concat({found}, {digits}))"


def sorted_join(x: str, sep: str = "|") -> str:
    return f"array_to_string(list_sort({x}), {q(sep)})"


_CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    _CTES[name] = sql


_base = f"(TIMESTAMP '2024-01-01 00:00:00' + to_seconds((doc_id * 7919) % {b.MONTH_SECONDS}))"
_line = "split_part(text, chr(10), 1)"
cte("article", f"""
SELECT doc_id AS id,
  CASE WHEN doc_id % 41 <> 5 THEN CAST(substr(source, 4) AS INT) + 1 END AS source_id,
  {strip(_line)} AS title,
  nullif({strip(f"substr(text, length({_line}) + 2)")}, '') AS raw_summary,
  'https://news.example.org/story/' || CAST(CASE WHEN doc_id % 50 = 1 THEN doc_id - 1 ELSE doc_id END AS VARCHAR) AS canonical_url,
  CASE WHEN doc_id % 37 <> 0 THEN {_base} END AS published_at,
  {_base} + to_hours(doc_id % 7) AS collected_at,
  coalesce(CASE WHEN doc_id % 37 <> 0 THEN {_base} END, {_base} + to_hours(doc_id % 7)) AS eff_at,
  lang AS language,
  CASE WHEN doc_id % 4 = 0 THEN {pick(lx.CATEGORIES, 'doc_id * 3')} END AS primary_category,
  n_chars,
  {strip("split_part(text, chr(10), -1)")} AS last_line
FROM documents""")
cte("source_dim", f"""
SELECT n + 1 AS id, name,
  CASE WHEN n % 9 <> 4 THEN 'https://' || name || '.example.org/feed.xml' END AS feed_url,
  'https://' || name || '.example.org' AS website_url,
  {pick(b.TYPES, 'n')} AS source_type, {pick(b.FAMILIES, 'n')} AS source_family,
  CASE WHEN n % 13 <> 12 THEN {pick(lx.CATEGORIES, 'n')} END AS category,
  {pick(b.TIERS, 'n')} AS trust_tier, (n % 7 <> 3) AS active,
  CASE WHEN n % 15 <> 14 THEN {pick(b.SOURCE_COUNTRIES, 'n')} END AS country_code
FROM (SELECT DISTINCT source AS name, CAST(substr(source, 4) AS INT) AS n FROM documents)""")
cte("annotation", f"""
SELECT l.doc_id * 2 + k AS annotation_id, l.doc_id AS article_id, 'local' AS provider, 'm1' AS model,
  'article_analysis' AS task, 'v' || CAST(k + 1 AS VARCHAR) AS prompt_version, status, is_relevant,
  CASE WHEN is_relevant THEN {pick(lx.CATEGORIES, 'l.doc_id * 7 + k * 3')} END AS primary_category,
  CASE WHEN is_relevant IS NOT NULL THEN CAST(30 + (l.doc_id * 37 + n_chars) % 71 AS INT) END AS importance_score,
  CASE WHEN is_relevant IS NOT NULL THEN CAST(40 + (l.doc_id * 53 + n_chars) % 61 AS INT) END AS relevance_score,
  CASE WHEN is_relevant AND l.doc_id % 5 <> 0 THEN last_line END AS summary,
  CASE WHEN is_relevant IS NOT NULL THEN [{pick(b.TOPICS, 'l.doc_id')}, {pick(b.TOPICS, 'l.doc_id * 5 + 3')}] END AS topics,
  CASE WHEN is_relevant IS NOT NULL THEN
    CASE WHEN l.doc_id % 3 = 0 THEN [{pick(b.COUNTRY_MENTIONS, 'l.doc_id')}, {pick(b.COUNTRY_MENTIONS, 'l.doc_id * 5 + 1')}]
    ELSE [{pick(b.COUNTRY_MENTIONS, 'l.doc_id')}] END END AS countries,
  CASE WHEN is_relevant IS NOT NULL THEN list_transform({capital_runs('last_line')}, lambda nm, j:
    {{'name': nm, 'type': ({arr(b.MENTION_TYPES)})[CAST((l.doc_id + j - 1) % {len(b.MENTION_TYPES)} AS INT) + 1],
      'context': CASE WHEN j % 2 = 0 THEN title END}}) END AS entities,
  collected_at + to_minutes(10 + 60 * k) AS created_at,
  collected_at + to_minutes(12 + 60 * k) AS processed_at
FROM (SELECT *, CASE WHEN k = 1 THEN CASE WHEN status = 'success' THEN doc_id % 2 = 0 END
        WHEN status = 'success' THEN true WHEN status = 'out_of_scope' THEN false END AS is_relevant
      FROM (SELECT *, CASE WHEN k = 1 THEN {pick(b.RETRY_STATES, 'doc_id // 3')} WHEN toxic = 1 THEN 'failed'
              WHEN quality = 1 THEN 'success' ELSE 'out_of_scope' END AS status
            FROM labels, (VALUES (0), (1)) AS ks(k) WHERE k = 0 OR doc_id % 3 = 0)) l
JOIN article a ON a.id = l.doc_id""")
cte("latest_any", """
SELECT * FROM annotation QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, annotation_id DESC) = 1""")
cte("latest_success", """
SELECT * FROM annotation WHERE status = 'success'
QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, annotation_id DESC) = 1""")
cte("first_relevant", """
SELECT * FROM annotation WHERE status = 'success' AND is_relevant
QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY annotation_id) = 1""")
cte("first_any", """
SELECT * FROM annotation QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY annotation_id) = 1""")
cte("feed_item", f"""
SELECT d.doc_id AS item_id, d.source AS source_name,
  CASE WHEN d.doc_id % 23 <> 7 THEN {strip(_line)} ELSE ' ' END AS title,
  CASE WHEN d.doc_id % 11 = 3 THEN 'urn:item:' || CAST(d.doc_id AS VARCHAR) ELSE p.url END AS link,
  CASE WHEN d.doc_id % 11 = 3 THEN CASE WHEN d.doc_id % 2 = 0 THEN p.url END ELSE 'tag:x' END AS guid,
  CASE WHEN doc_id % 37 <> 0 THEN {_base} END AS published_at,
  {_base} + to_hours(doc_id % 7) AS collected_at, p.html AS summary
FROM documents d JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)""")
cte("action_log", f"""
SELECT event_id, user_id, event_id % 97 AS article_id, {case_map('event_type', b.ACTIONS)} AS action, ts FROM events""")
cte("country_dim", f"""
SELECT n_nationkey AS nation_key, {pick(b.NATION_CODES, 'n_nationkey')} AS code, n_name AS name, n_regionkey AS region_key FROM nation""")
cte("article_country", f"""
SELECT DISTINCT l_orderkey AS article_id, {pick(b.NATION_CODES, 's_nationkey')} AS country_code
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
cte("price", """
SELECT c_nationkey AS instrument, CAST(o_orderdate AS DATE) AS date, o_orderkey AS seq,
  CASE WHEN o_orderkey % 53 <> 0 THEN o_totalprice END AS close
FROM orders JOIN customer ON o_custkey = c_custkey""")
_ruletext = f"(CASE WHEN item_id % 4 = 0 THEN {pick(list(lx.EXPANSION_RULES), 'item_id // 4')} ELSE '' END)"
cte("question_list", f"""
SELECT item_id AS query_id, text AS passage,
  {strip(f"regexp_replace(text, '\\s+', ' ', 'g') || ' ' || {_ruletext} || CASE item_id % 8 WHEN 1 THEN ' today' WHEN 3 THEN ' last week' WHEN 5 THEN ' this month' ELSE '' END")} AS question,
  {pick(lx.CATEGORIES, 'item_id')} AS category
FROM benchmark""")


def with_ctes(sql: str) -> str:
    """Put the shared expressions a query mentions in front of it, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in _CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    if not needed:
        return sql.strip()
    parts = [f"{n} AS MATERIALIZED ({body.strip()})" for n, body in _CTES.items() if n in needed]
    head = "WITH " + ",\n".join(parts)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + head[5:] + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return head + ",\n" + body[5:]
    return head + "\n" + body
