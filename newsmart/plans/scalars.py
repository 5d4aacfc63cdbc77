"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions import dates, entities, markets, numbers, scoring, text, urls
from newsmart.plans import sqltext as s
from newsmart.plans.registry import query
from newsmart.sources import bind as b

AS_OF = "2024-01-28 12:00:00"
FMT = "yyyy-MM-dd HH:mm:ss"


def stamp(c):
    return F.date_format(c, FMT)


def joined(c, sep="|"):
    return F.array_join(F.sort_array(c), sep)


_U = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


@query("B1", rf"""
SELECT page_id, lower(regexp_extract(url, '{_U}', 1)) || '://' || lower(regexp_extract(url, '{_U}', 2))
  || CASE WHEN path = '' THEN '/' ELSE path END
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url
FROM (SELECT page_id, trim(url) AS url, regexp_replace(regexp_extract(trim(url), '{_U}', 3), '/+$', '') AS path,
  list_filter(string_split(regexp_extract(trim(url), '{_U}', 4), '&'),
    lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN {s.inlist(lx.TRACKING_KEYS)}) AS kept FROM pages)""")
def canonical_urls(t):
    return t.raw("pages").select("page_id", urls.canonicalize_url(F.col("url")).alias("canonical_url"))


_entities = [
    ("nbsp", " "), ("copy", "©"), ("reg", "®"), ("trade", "™"), ("middot", "·"), ("bull", "•"), ("mdash", "—"), ("ndash", "–"), ("hellip", "…"), ("lsquo", "‘"), ("rsquo", "’"),
    ("ldquo", "“"), ("rdquo", "”"), ("laquo", "«"), ("raquo", "»"), ("euro", "€"), ("pound", "£"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("amp", "&"),
]


def clean_sql(x):
    """Cleaned text of markup, or null."""
    out = rf"regexp_replace({x}, '(?is)<!--.*?-->|<(script|style|template)\b.*?</(script|style|template)\s*>', ' ', 'g')"
    out = rf"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    for name, value in _entities:
        out = f"replace({out}, '&{name};', {s.q(value)})"
    out = s.strip(rf"regexp_replace(replace({out}, chr(160), ' '), '\s+', ' ', 'g')")
    return f"nullif({out}, '')"


@query("B2", f"SELECT page_id, {clean_sql('html')} AS clean_text FROM pages")
def cleaned_page_text(t):
    return t.spread("pages").select("page_id", text.clean_markup(F.col("html")).alias("clean_text"))


@query("B2", f"SELECT page_id, {clean_sql('html')} AS clean_text FROM pages")
def cleaned_page_text_native(t):
    return t.raw("pages").select("page_id", text.clean_summary_native(F.col("html")).alias("clean_text"))


_dirty = r"regexp_replace(coalesce(raw_summary, ''), '\s+', ' ', 'g')"


@query("B2", f"""
SELECT count(*) AS scanned, CAST(count(*) FILTER (WHERE raw_summary IS DISTINCT FROM nullif({_dirty}, '')) AS BIGINT) AS updated
FROM article""")
def reclean_counts(t):
    new = F.regexp_replace(F.coalesce("raw_summary", F.lit("")), r"\s+", " ")
    new = F.when(new != "", new)
    return t.articles().agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(~F.col("raw_summary").eqNullSafe(new)).alias("updated")
    )


@query("B3 B4", f"""
SELECT id, {s.normalise_title('title')} AS normal_title, sha256({s.normalise_title('title')}) AS fingerprint FROM article""")
def title_fingerprints(t):
    c = F.col("title")
    return t.articles().select(
        "id", text.normalise_title(c).alias("normal_title"), text.title_fingerprint(c).alias("fingerprint")
    )


@query("B5", f"SELECT id, {s.fmt_ts('coalesce(published_at, collected_at)')} AS effective_at FROM article")
def effective_times(t):
    return t.articles().select("id", stamp(F.coalesce("published_at", "collected_at")).alias("effective_at"))


_d = "CAST(o_orderdate AS DATE)"


@query("B6 B7", f"""
SELECT CAST(d AS VARCHAR) AS day, {s.fmt_ts(s.to_utc('CAST(d AS TIMESTAMP)'))} AS start_utc,
  {s.fmt_ts(s.to_utc('CAST(d + 1 AS TIMESTAMP)'))} AS next_start_utc,
  strftime({s.to_utc("CAST(d + 1 AS TIMESTAMP) - INTERVAL 1 MICROSECOND")}, '%Y-%m-%d %H:%M:%S.%f') AS last_instant_utc,
  {s.fmt_ts(s.to_utc("CAST(d + 1 AS TIMESTAMP) - INTERVAL 1 SECOND") + " - INTERVAL 48 HOURS")} AS window_start_utc,
  {s.fmt_ts(s.to_utc("CAST(d + 1 AS TIMESTAMP) - INTERVAL 1 SECOND"))} AS window_end_utc, n AS orders
FROM (SELECT {_d} AS d, count(*) AS n FROM orders GROUP BY 1)""")
def local_day_bounds(t):
    days = t.raw("orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("orders"))
    d = F.col("d")
    lo, hi = dates.window_48h(d)
    return days.select(
        d.cast("string").alias("day"), stamp(dates.day_start(d)).alias("start_utc"),
        stamp(dates.day_end_exclusive(d)).alias("next_start_utc"),
        F.date_format(dates.day_end_inclusive(d), FMT + ".SSSSSS").alias("last_instant_utc"),
        stamp(lo).alias("window_start_utc"), stamp(hi).alias("window_end_utc"), "orders",
    )


def _phr(p):
    return s.contains_any("ql", p)


@query("B8", f"""
SELECT query_id, CAST(CASE WHEN query_id % 7 = 2 THEN DATE '2024-01-05' WHEN query_id % 7 = 2 THEN NULL
    WHEN contains(ql, 'today') THEN today WHEN contains(ql, 'yesterday') THEN today - 1
    WHEN {_phr(lx.WEEK_PHRASES)} THEN today - 6 WHEN {_phr(lx.MONTH_PHRASES)} THEN date_trunc('month', today) END AS DATE)::VARCHAR AS date_from,
  CAST(CASE WHEN query_id % 7 = 2 THEN NULL WHEN contains(ql, 'today') THEN today WHEN contains(ql, 'yesterday') THEN today - 1
    WHEN {_phr(lx.WEEK_PHRASES + lx.MONTH_PHRASES)} THEN today END AS DATE)::VARCHAR AS date_to
FROM (SELECT query_id, lower(question) AS ql, DATE '2024-01-28' AS today FROM question_list)""")
def question_date_scopes(t):
    given = F.when(F.col("query_id") % 7 == 2, F.lit("2024-01-05").cast("date"))
    scope = dates.question_dates(
        F.col("question"), dates.local_date(dates.ts(AS_OF)), given, F.lit(None).cast("date")
    )
    return t.questions().select("query_id", scope.alias("r")).select(
        "query_id", F.col("r.date_from").cast("string").alias("date_from"), F.col("r.date_to").cast("string").alias("date_to")
    )


@query("B9 B10", f"""
SELECT id, {s.sorted_join(s.title_tokens('title'), ' ')} AS tokens, {s.normalize_token('title')} AS phrase FROM article""")
def title_comparison_tokens(t):
    c = F.col("title")
    return t.articles().select(
        "id", joined(text.title_tokens(c), " ").alias("tokens"), text.normalize_token(c).alias("phrase")
    )


@query("B11", f"SELECT id, {s.sorted_join(s.key_entities('title'))} AS entities FROM article")
def title_entities(t):
    return t.articles().select("id", joined(text.key_entities(F.col("title"))).alias("entities"))


@query("B12 B13", f"""
SELECT doc_id AS id, {s.sorted_join(s.numeric_markers('text'))} AS markers, {s.sorted_join(s.numeric_tokens('text'))} AS numbers
FROM documents""")
def document_numbers(t):
    return t.spread("documents").select(
        F.col("doc_id").alias("id"), joined(text.numeric_markers(F.col("text"))).alias("markers"),
        joined(text.numeric_tokens(F.col("text"))).alias("numbers"),
    )


_kw = " ".join(
    f"WHEN {s.contains_any('lower(title)', terms)} THEN {s.q(name)}" for name, terms in lx.TITLE_CATEGORY_TERMS
)
CATEGORY_SQL = (
    f"coalesce(a.primary_category, (CASE {_kw} END), s.category, 'General')"
)


@query("B18", f"""
SELECT a.id, coalesce(n.primary_category, {CATEGORY_SQL}) AS category
FROM article a LEFT JOIN source_dim s ON s.id = a.source_id LEFT JOIN latest_any n ON n.article_id = a.id""")
def resolved_categories(t):
    from newsmart.operators.annotations import pick_annotation
    from newsmart.operators.joins import with_source

    a = with_source(t.articles().select("id", "source_id", "title", "primary_category"), t.sources(), ["category"])
    n = pick_annotation(t.annotations(), "latest").select(
        F.col("article_id").alias("id"), F.col("primary_category").alias("annotated")
    )
    return a.join(n, "id", "left").select(
        "id",
        scoring.resolve_category(
            F.col("annotated"), F.col("primary_category"), F.col("title"), F.col("source_category")
        ).alias("category"),
    )


_exact = s.case_map("c", dict(lx.FEED_SECTIONS))
_multi = "list_distinct(list_filter([" + ", ".join(
    rf"CASE WHEN regexp_matches(c, '(^|[^\p{{L}}\p{{N}}_]){k}($|[^\p{{L}}\p{{N}}_])') THEN {s.q(v)} END" for k, v in lx.FEED_SECTIONS
) + "], lambda x: x IS NOT NULL))"


@query("B19", f"""
SELECT id, {s.case_map('c', lx.EVENT_SECTIONS, "'WORLD'")} AS event_section,
  {s.case_map('c', lx.EDITION_SECTIONS, "'World Watch'")} AS edition_section,
  CASE WHEN {_exact} IS NOT NULL THEN {_exact} ELSE {s.sorted_join(_multi)} END AS feed_sections
FROM (SELECT id, lower(coalesce(primary_category, 'Clean Energy & Oil')) AS c FROM article)""")
def category_sections(t):
    c = F.coalesce("primary_category", F.lit("Clean Energy & Oil"))
    return t.articles().select(
        "id", scoring.event_section(c).alias("event_section"), scoring.edition_section(c).alias("edition_section"),
        joined(scoring.feed_sections(c)).alias("feed_sections"),
    )


def type_sql(x):
    r = f"lower({s.strip(x)})"
    return f"""coalesce({s.case_map(r, lx.RAW_TYPE_MAP)}, CASE WHEN {s.contains_any(r, ['company', 'corp'])} THEN 'COMPANY'
      WHEN contains({r}, 'bank') THEN CASE WHEN contains({r}, 'central') THEN 'CENTRAL_BANK' ELSE 'COMPANY' END
      WHEN {s.contains_any(r, ['government', 'ministry'])} THEN 'GOVERNMENT_BODY'
      WHEN {s.contains_any(r, ['person', 'official', 'executive', 'minister'])} THEN 'PERSON'
      WHEN {s.contains_any(r, ['model', 'product'])} THEN 'PRODUCT' WHEN {s.contains_any(r, ['tech', 'software'])} THEN 'TECHNOLOGY'
      WHEN contains({r}, 'country') THEN 'COUNTRY' WHEN contains({r}, 'region') THEN 'REGION' ELSE 'ORGANIZATION' END)"""


def name_sql(x):
    n = rf"regexp_replace({s.strip(f'lower({x})')}, '[^\w\s\-&.+]', '', 'g')"
    w = s.words(n)
    return (
        f"(CASE WHEN len({w}) > 1 AND ({w})[-1] IN {s.inlist(lx.NAME_SUFFIXES)} THEN array_to_string(({w})[1:-2], ' ') "
        f"WHEN len({w}) > 0 THEN array_to_string({w}, ' ') ELSE {s.strip(n)} END)"
    )


def slug_sql(norm, typ):
    x = f"replace(replace(lower({norm}), '+', '-plus'), '&', 'and')"
    base = rf"replace({s.strip(rf'''regexp_replace({x}, '[^\w\s\-]', '', 'g')''')}, ' ', '-')"
    return f"({base} || '-' || replace(lower({typ}), '_', '-'))"


FOLD = r"regexp_replace(strip_accents({}), '[^\x{{00}}-\x{{7F}}]', '', 'g')"
_ent = "(SELECT annotation_id, unnest(entities) AS e FROM annotation)"


@query("B20", f"""
SELECT raw_type, {type_sql('raw_type')} AS entity_type, n FROM (SELECT e.type AS raw_type, count(*) AS n FROM {_ent} GROUP BY 1)""")
def entity_types(t):
    e = t.annotations().select(F.explode("entities").alias("e")).groupBy(F.col("e.type").alias("raw_type"))
    return e.agg(F.count(F.lit(1)).alias("n")).select(
        "raw_type", entities.normalize_type(F.col("raw_type")).alias("entity_type"), "n"
    )


@query("B21 B22", f"""
SELECT title, norm AS normalized_name, {slug_sql('norm', "'GOVERNMENT_BODY'")} AS slug
FROM (SELECT title, {name_sql(FOLD.format('title'))} AS norm FROM (SELECT DISTINCT title FROM article))""")
def entity_names_and_slugs(t):
    d = t.articles().select("title").distinct().withColumn("norm", entities.normalize_name(entities.ascii_fold("title")))
    return d.select(
        "title", F.col("norm").alias("normalized_name"),
        entities.slug(F.col("norm"), F.lit("GOVERNMENT_BODY")).alias("slug"),
    )


_names = {v.lower(): k for k, v in lx.COUNTRY_NAMES.items()} | lx.COUNTRY_NAME_ALIASES


@query("B23 B24", f"""
SELECT raw, {s.case_map('lower(raw)', lx.COUNTRY_ALIASES)} AS alias_code,
  CASE WHEN length(raw) = 2 AND upper(raw) IN {s.inlist(lx.COUNTRY_NAMES)} THEN upper(raw) ELSE {s.case_map('lower(raw)', _names)} END AS iso,
  CASE WHEN upper(raw) IN {s.inlist(lx.COUNTRY_NAMES)} THEN {s.case_map('upper(raw)', lx.COUNTRY_NAMES)}
    WHEN {s.case_map('lower(raw)', _names)} IS NOT NULL THEN {s.case_map(s.case_map('lower(raw)', _names), lx.COUNTRY_NAMES)}
    WHEN length(raw) > 2 THEN upper(substr(raw, 1, 1)) || lower(substr(raw, 2)) ELSE upper(raw) END AS display_name, n
FROM (SELECT c AS raw, count(*) AS n FROM (SELECT unnest(countries) AS c FROM annotation) GROUP BY 1)""")
def country_codes(t):
    c = t.annotations().select(F.explode("countries").alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    raw = F.col("raw")
    return c.select(
        "raw", entities.country_alias(raw).alias("alias_code"), entities.iso_code(raw).alias("iso"),
        entities.country_info(raw)["name"].alias("display_name"), "n",
    )


_num = {v: k for k, v in lx.ISO_NUMERIC.items()}


@query("B23", f"""
SELECT nation_key, code, CAST({s.case_map('code', {k: int(v) for k, v in _num.items()})} AS INT) AS numeric_code,
  {s.case_map(s.case_map('code', _num), lx.ISO_NUMERIC)} AS from_numeric FROM country_dim""")
def country_numeric_codes(t):
    c = t.countries()
    n = F.element_at(text.str_map(_num), F.col("code")).cast("int")
    return c.select("nation_key", "code", n.alias("numeric_code"), entities.iso_code(n).alias("from_numeric"))


@query("B23", f"""
SELECT code, CASE WHEN code % 2 = 0 THEN CAST(code AS VARCHAR) ELSE lpad(CAST(code AS VARCHAR), 3, '0') END AS raw, {s.case_map("lpad(CAST(code AS VARCHAR), 3, '0')", lx.ISO_NUMERIC)} AS iso, n
FROM (SELECT CAST(p_partkey % 1000 AS INT) AS code, count(*) AS n FROM part GROUP BY 1)""")
def numbers_as_countries(t):
    """Numbers below 1000, padded or not, as numeric country codes; most of them are none."""
    code = F.col("code")
    c = t.raw("part").groupBy((F.col("p_partkey") % 1000).cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    raw = F.when(code % 2 == 0, code.cast("string")).otherwise(F.lpad(code.cast("string"), 3, "0"))
    return c.select("code", raw.alias("raw"), entities.iso_code(raw).alias("iso"), "n")


# labels are read in mixed case, missing and unknown
_spelled = lambda c: f"CASE id % 5 WHEN 1 THEN upper({c}) WHEN 2 THEN NULL WHEN 3 THEN 'odd Kind' ELSE {c} END"


@query("B24", f"""
SELECT name, coalesce({s.case_map('lower(fam)', lx.FAMILY_LABELS)}, upper(substr(fam, 1, 1)) || lower(substr(fam, 2))) AS family_label,
  coalesce({s.case_map('lower(tier)', {k: v[0] for k, v in lx.TIER_LABELS.items()})}, upper(substr(tier, 1, 1)) || lower(substr(tier, 2))) AS tier_label,
  CAST(coalesce({s.case_map('lower(tier)', {k: v[1] for k, v in lx.TIER_LABELS.items()})}, 1) AS INT) AS tier_weight,
  CASE WHEN category IS NULL THEN 'Strategic intelligence briefings and sector updates.'
    ELSE coalesce({s.case_map('category', lx.SECTOR_DESCRIPTIONS)}, 'Coverage and strategic intelligence analysis for ' || category || '.') END AS sector
FROM (SELECT *, coalesce({_spelled('source_family')}, 'news') AS fam, coalesce({_spelled('trust_tier')}, 'primary') AS tier FROM source_dim)""")
def source_labels(t):
    way = F.col("id") % 5
    spelled = lambda c: F.when(way == 1, F.upper(c)).when(way == 2, None).when(way == 3, F.lit("odd Kind")).otherwise(F.col(c))
    return t.sources().select(
        "name", entities.family_label(spelled("source_family")).alias("family_label"), entities.tier_label(spelled("trust_tier")).alias("tier_label"),
        entities.tier_weight(spelled("trust_tier")).alias("tier_weight"),
        F.when(F.col("category").isNull(), F.lit("Strategic intelligence briefings and sector updates."))
        .otherwise(
            F.coalesce(
                F.element_at(text.str_map(lx.SECTOR_DESCRIPTIONS), F.col("category")),
                F.concat(F.lit("Coverage and strategic intelligence analysis for "), F.col("category"), F.lit(".")),
            )
        )
        .alias("sector"),
    )


@query("B25", """
SELECT article_id, array_to_string(list_sort(list(country_code))[1:3], '|') AS visible,
  CAST(greatest(count(*) - 3, 0) AS INT) AS overflow_count, coalesce(array_to_string(list_sort(list(country_code))[4:], ', '), '') AS overflow_names
FROM article_country GROUP BY 1""")
def country_badges(t):
    g = t.article_countries().groupBy("article_id").agg(F.sort_array(F.collect_set("country_code")).alias("codes"))
    return g.select("article_id", text.first_n_overflow(F.col("codes"), 3).alias("x")).select(
        "article_id", F.array_join("x.visible", "|").alias("visible"), "x.overflow_count", "x.overflow_names"
    )


_bare = s.strip(f"regexp_replace({s.strip('t')}, '^#+', '')")


@query("B26", f"""
SELECT topic, CASE WHEN substr(topic,1,1) = lower(substr(topic,1,1)) AND substr(topic,1,1) <> upper(substr(topic,1,1))
  THEN upper(substr(topic,1,1)) || lower(substr(topic,2)) ELSE topic END AS clean, n
FROM (SELECT {_bare} AS topic, count(*) AS n FROM (SELECT unnest(topics) AS t FROM annotation) GROUP BY 1)""")
def clean_topics(t):
    bare = text.strip(F.regexp_replace(text.strip(F.col("t")), "^#+", ""))
    g = t.annotations().select(F.explode("topics").alias("t")).groupBy(bare.alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("topic", text.clean_topic(F.col("topic")).alias("clean"), "n")


_day = "CAST(collected_at AS DATE)"


@query("B27", f"""
SELECT id, CASE WHEN published_at IS NULL THEN 'on ' || strftime({_day}, '%d %B %Y')
  WHEN CAST(published_at AS DATE) = {_day} AND hour(published_at) < 6 THEN 'overnight on ' || strftime({_day}, '%d %B %Y')
  WHEN CAST(published_at AS DATE) = {_day} THEN 'on ' || strftime({_day}, '%d %B %Y')
  WHEN CAST(published_at AS DATE) = {_day} - 1 THEN 'on ' || strftime(CAST(published_at AS DATE), '%d %B %Y')
  ELSE 'earlier this week on ' || strftime(CAST(published_at AS DATE), '%d %B %Y') END AS label
FROM article""")
def temporal_labels(t):
    return t.articles().select(
        "id", dates.temporal_label(F.col("published_at"), F.to_date("collected_at")).alias("label")
    )


BEST_SUMMARY_SQL = (
    "coalesce(nullif(n.summary, ''), CASE WHEN length(raw_summary) > 250 THEN substr(raw_summary, 1, 250) || '...' "
    "ELSE raw_summary END, title)"
)


@query("B28", f"""
SELECT id, sha256({BEST_SUMMARY_SQL}) AS digest, length({BEST_SUMMARY_SQL}) AS n
FROM article a LEFT JOIN latest_success n ON n.article_id = a.id""")
def best_summaries(t):
    from newsmart.operators.annotations import pick_annotation

    n = pick_annotation(t.annotations(), "latest_success").select(F.col("article_id").alias("id"), "summary")
    best = text.best_summary(F.col("summary"), F.col("raw_summary"), F.col("title"))
    return t.articles().select("id", "title", "raw_summary").join(n, "id", "left").select(
        "id", F.sha2(best, 256).alias("digest"), F.length(best).cast("bigint").alias("n")
    )


_in = "CASE WHEN length(last_line) > 50 THEN last_line ELSE coalesce(raw_summary, '') END"


@query("B29", f"""
SELECT id, sha256(CASE WHEN length(x) > 3000 THEN substr(x, 1, 3000) || chr(10) || '...[truncated for AI processing]' ELSE x END) AS digest
FROM (SELECT id, {_in} AS x FROM article)""")
def annotation_inputs(t):
    return t.articles().select(
        "id", F.sha2(text.annotation_input(F.col("last_line"), F.col("raw_summary")), 256).alias("digest")
    )


_rel = "CASE WHEN len(h) > 0 THEN 'MARKET_MOVING' ELSE 'RELATED' END"
_hits = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(lower(text), {s.q(p)}) THEN {i + 1} END" for i, p in enumerate(lx.MARKET_MOVING_PATTERNS)
) + "], lambda x: x IS NOT NULL)"


@query("B32", f"SELECT doc_id AS id, {_rel} AS relationship, array_to_string(h, ',') AS patterns FROM (SELECT doc_id, {_hits} AS h FROM documents)")
def market_moving_documents(t):
    r = markets.market_moving(F.col("text"))
    return t.spread("documents").select(F.col("doc_id").alias("id"), r.alias("r")).select(
        "id", "r.relationship", F.array_join(F.col("r.patterns").cast("array<string>"), ",").alias("patterns")
    )


_known = s.inlist(lx.GENERIC_SECTION_NAMES + lx.GENERIC_THEME_SUFFIXES + lx.GENERIC_THEME_FILLERS)


@query("B33 B34 B35", rf"""
SELECT id, regexp_matches(lower(title), '\b({"|".join(lx.PREDICTIVE_WORDS)})\b') AS predictive,
  (lower(title) IN {s.inlist(lx.GENERIC_SECTION_NAMES + lx.GENERIC_THEME_TITLES)}
   OR len(list_filter({s.words('lower(title)')}, lambda w: w NOT IN {_known})) = 0) AS generic_theme,
  (lower(w1) IN {s.inlist(lx.GENERIC_TERMS)} OR length(w1) <= 1) AS generic_term
FROM (SELECT id, title, split_part(title, ' ', 1) AS w1 FROM article)""")
def language_flags(t):
    c = F.col("title")
    return t.articles().select(
        "id", text.has_predictive_language(c).alias("predictive"), text.is_generic_theme(c).alias("generic_theme"),
        entities.is_generic_term(F.substring_index(c, " ", 1)).alias("generic_term"),
    )


_closes = """(SELECT instrument, max(close) FILTER (WHERE r = 1) AS latest, max(close) FILTER (WHERE r = 2) AS previous FROM
  (SELECT instrument, close, row_number() OVER (PARTITION BY instrument ORDER BY date DESC, seq DESC) AS r FROM price WHERE close > 0)
  WHERE r <= 2 GROUP BY 1)"""
_cl = f"(SELECT instrument, {s.rnd('latest', 4)} AS a, {s.rnd('previous', 4)} AS p FROM {_closes})"
_pct = s.rnd("(a - p) / p * 100.0e0", 4)
_dir = lambda x, th: f"CASE WHEN {x} > {th} THEN 'UP' WHEN {x} < -{th} THEN 'DOWN' ELSE 'FLAT' END"
_lvl = lambda x: f"CASE WHEN {x} < 20 THEN {s.rnd(x, 4)} ELSE {s.rnd(x, 2)} END"
SNAPSHOT_SQL = f"""(SELECT instrument, {_lvl('a')} AS latest_close, {_lvl('p')} AS previous_close,
  {s.rnd('a - p', 4)} AS change_value, {_pct} AS change_percent, {_dir(_pct, '0.05e0')} AS direction FROM {_cl})"""


def snapshots(t):
    from newsmart.operators.markets import latest_two

    two = latest_two(t.prices(), "instrument", ["date", "seq"])
    r = markets.price_change(F.col("latest"), F.col("previous"))
    return two.select("instrument", r.alias("r")).select("instrument", "r.*")


@query("B36 W26", f"SELECT * FROM {SNAPSHOT_SQL}")
def price_snapshots(t):
    return snapshots(t)


@query("B37", f"""
SELECT instrument, {s.rnd('(a - p) * 100.0e0', 1)} AS change_bp, {_dir(s.rnd('(a - p) * 100.0e0', 1), '0.5e0')} AS direction,
  CASE WHEN bp > 0.5e0 THEN 'HIKE' WHEN bp < -0.5e0 THEN 'CUT' ELSE 'HOLD' END AS action, bp AS policy_bp
FROM (SELECT instrument, {s.rnd('latest / 100000.0e0', 3)} AS a, {s.rnd('previous / 100000.0e0', 3)} AS p,
  {s.rnd('(CASE WHEN instrument % 2 = 0 THEN latest / 100000.0e0 - previous / 100000.0e0 ELSE floor(latest / 100000.0e0) - floor(previous / 100000.0e0) END) * 100.0e0', 1)} AS bp
  FROM {_closes})""")
def yield_and_policy_moves(t):
    from newsmart.operators.markets import latest_two

    two = latest_two(t.prices(), "instrument", ["date", "seq"])
    a, p = F.col("latest") / F.lit(100000.0), F.col("previous") / F.lit(100000.0)
    single = F.col("instrument") % 2 == 0
    none = F.lit(None).cast("double")
    y = markets.yield_change(a, p)
    act = markets.policy_action(
        F.when(single, a), F.when(single, p), F.when(~single, F.floor(a).cast("double")),
        F.when(~single, F.floor(a).cast("double") + 0.25), F.when(~single, F.floor(p).cast("double")).otherwise(none),
    )
    return two.select("instrument", y.alias("y"), act.alias("c")).select(
        "instrument", "y.change_bp", "y.direction", "c.action", F.col("c.change_bp").alias("policy_bp")
    )


FX_SYMBOLS = ["GBP/USD", "EUR/USD", "USD/INR", "USD/JPY", "BRENT"]
_sp = (
    f"(CASE WHEN {s.rnd('change_percent', 2)} < 0 THEN '-' ELSE '+' END || format('{{:,}}', CAST(abs({s.rnd('change_percent', 2)}) * 100 + 0.5 AS BIGINT) // 100)"
    f" || '.' || lpad(CAST(CAST(round(abs({s.rnd('change_percent', 2)}) * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') || '%')"
)
_sp = _sp.replace("CAST(abs(" + s.rnd("change_percent", 2) + ") * 100 + 0.5 AS BIGINT)", "CAST(round(abs(" + s.rnd("change_percent", 2) + ") * 100) AS BIGINT)")


def _fx_case():
    st, de = "sym || ' ' || direction", "''"
    for code, label, word, pair, buys, what, base in reversed(markets.FX_WORDING):
        up, down = ("strengthened", "weakened") if base else ("weakened", "strengthened")
        st = (
            f"CASE WHEN contains(sym, '{code}') THEN CASE direction WHEN 'UP' THEN '{label} {up} {word} USD (' || {_sp} || ')' "
            f"WHEN 'DOWN' THEN '{label} {down} {word} USD (' || {_sp} || ')' ELSE '{label} held flat versus USD' END ELSE {st} END"
        )
        de = (
            f"CASE WHEN contains(sym, '{code}') THEN CASE direction WHEN 'UP' THEN '{pair} rose — {buys} more {what}' "
            f"WHEN 'DOWN' THEN '{pair} fell — {buys} fewer {what}' ELSE '{pair} unchanged' END ELSE {de} END"
        )
    return st, de


@query("B38", f"""
SELECT instrument, {_fx_case()[0]} AS statement, {_fx_case()[1]} AS detail
FROM (SELECT *, {s.pick(FX_SYMBOLS, 'instrument')} AS sym FROM {SNAPSHOT_SQL})""")
def fx_wording(t):
    sym = b.pick(FX_SYMBOLS, F.col("instrument"))
    r = markets.fx_statement(sym, sym, F.col("direction"), F.col("change_percent"))
    return snapshots(t).select("instrument", r.alias("r")).select("instrument", "r.statement", "r.detail")


_ex = " UNION ALL ".join(
    f"SELECT '{r}' AS region, {s.q(z)} AS zone, [" + ", ".join(f"{{'o': {o}, 'c': {c}}}" for o, c in ss) + f"] AS ss, {pre} AS pre, {post} AS post"
    for r, _, z, ss, pre, post in lx.EXCHANGES
)


@query("B39", f"""
WITH ex AS ({_ex}), loc AS (SELECT event_id, region, ss, pre, post, timezone(zone, timezone('UTC', ts)) AS l FROM events, ex),
m AS (SELECT *, (epoch_us(l) % 86400000000) / 60000000.0e0 AS mi FROM loc)
SELECT event_id, region, CASE WHEN isodow(l) >= 6 THEN 'CLOSED' WHEN len(list_filter(ss, lambda x: x.o <= mi AND mi <= x.c)) > 0 THEN 'OPEN'
  WHEN pre <= mi AND mi < ss[1].o THEN 'PRE_MARKET' WHEN ss[-1].c < mi AND mi <= post THEN 'POST_MARKET' ELSE 'CLOSED' END AS state
FROM m""")
def exchange_sessions(t):
    e = t.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.explode(markets.exchange_array()).alias("x"))
    return e.select("event_id", F.col("x.region").alias("region"), markets.session_state(F.col("ts"), F.col("x")).alias("state"))


@query("B40", """
SELECT CAST(d AS VARCHAR) AS day, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(sha256(CAST(d AS VARCHAR)), ''),
  lambda ch: CAST(strpos('0123456789abcdef', ch) - 1 AS BIGINT))), lambda a, x: (a * 16 + x) % n) AS BIGINT) AS pick
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), (SELECT count(*) AS n FROM part)""")
def daily_picks(t):
    n = t.raw("part").select(F.count(F.lit(1)).alias("n")).scalar()
    d = t.raw("orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.withColumn("n", n).select(F.col("d").cast("string").alias("day"), markets.daily_pick(F.col("d"), F.col("n")).alias("pick"))


_c2 = "lower(coalesce(a.primary_category, s.category, ''))"


def editorial_sql(imp, n_sources, as_of):
    hours = f"((epoch_us(TIMESTAMP '{as_of}') - epoch_us(eff_at)) / 3600000000.0e0)"
    return f"""{s.rnd(f'coalesce(CAST({imp} AS DOUBLE), 70.0e0) / 100.0e0 * 35.0e0', 1)} AS importance_pts,
  CASE WHEN coalesce(s.source_type, 'rss') IN {s.inlist(lx.OFFICIAL_SOURCE_TYPES)} THEN 15.0e0
    WHEN s.trust_tier = 'core' OR s.source_type = 'INSTITUTIONAL_RESEARCH' THEN 12.0e0
    WHEN coalesce(s.trust_tier, 'useful') = 'useful' THEN 9.0e0 ELSE 6.0e0 END AS source_pts,
  {s.rnd(f'greatest(0.0e0, 15.0e0 - greatest(0.0e0, {hours}) * 0.5e0)', 1)} AS recency_pts,
  CASE WHEN {s.contains_any(_c2, lx.STRATEGIC_TERMS)} THEN 20.0e0 ELSE 12.0e0 END AS strategic_pts,
  least(15.0e0, greatest(0, {n_sources} - 1) * 5.0e0) AS corroboration_pts"""


@query("B42 B52", f"""
SELECT *, {s.rnd('least(100.0e0, importance_pts + source_pts + recency_pts + strategic_pts + corroboration_pts)', 1)} AS total,
  CASE WHEN t >= 70 THEN 'LEAD' WHEN t >= 50 THEN 'PUBLISHABLE' ELSE 'BELOW' END AS band
FROM (SELECT *, importance_pts + source_pts + recency_pts + strategic_pts + corroboration_pts AS t0,
  {s.rnd('least(100.0e0, importance_pts + source_pts + recency_pts + strategic_pts + corroboration_pts)', 1)} AS t FROM (
SELECT a.id, {editorial_sql('n.importance_score', 'CAST(a.id % 5 AS INT)', AS_OF)}
FROM article a LEFT JOIN source_dim s ON s.id = a.source_id LEFT JOIN latest_success n ON n.article_id = a.id))""".replace("SELECT *, " + s.rnd('least', 1), "SELECT *"))
def article_editorial_scores(t):
    from newsmart.operators.annotations import pick_annotation
    from newsmart.operators.joins import with_source

    a = with_source(
        t.articles().select("id", "source_id", "published_at", "collected_at", "primary_category"),
        t.sources(), ["source_type", "trust_tier", "category"],
    )
    n = pick_annotation(t.annotations(), "latest_success").select(F.col("article_id").alias("id"), "importance_score")
    hours = dates.hours_between(dates.ts(AS_OF), F.coalesce("published_at", "collected_at"))
    r = scoring.editorial_score(
        F.col("importance_score"), F.col("source_source_type"), F.col("source_trust_tier"), hours,
        F.coalesce("primary_category", "source_category"), (F.col("id") % 5).cast("int"),
    )
    out = a.join(n, "id", "left").select("id", r.alias("r")).select("id", "r.*")
    total = F.col("total")
    parts = [c for c in out.columns if c.endswith("_pts")]
    return out.select(
        "id", *parts, (sum((F.col(c) for c in parts[1:]), F.col(parts[0]))).alias("t0"), total.alias("t"), total,
        F.when(total >= 70, F.lit("LEAD")).when(total >= 50, F.lit("PUBLISHABLE")).otherwise(F.lit("BELOW")).alias("band"),
    )


_w = lx.EDITION_WEIGHTS


def edition_score_sql(rel, imp, age, tier, nsrc, ngeo):
    """Parts and score as columns, from column expressions."""
    clampd = lambda x, d: f"least(1.0e0, greatest(0.0e0, coalesce(CAST({x} AS DOUBLE), {d}) / 100.0e0))"
    rec = f"greatest(0.0e0, 1.0e0 - greatest(0.0e0, {age}) / 36.0e0)"
    tru = f"coalesce({s.case_map(tier, lx.EDITION_TRUST)}, 0.5)::DOUBLE"
    div = f"(CASE WHEN {nsrc} = 0 THEN 1.0e0 WHEN {nsrc} = 1 THEN 0.5e0 ELSE 0.0e0 END)"
    geo = f"(CASE WHEN {ngeo} = 0 THEN 1.0e0 WHEN {ngeo} = 1 THEN 0.5e0 ELSE 0.2e0 END)"
    total = (
        f"({_w['relevance']}e0 * {clampd(rel, '70.0e0')} + {_w['importance']}e0 * {clampd(imp, '50.0e0')} + {_w['recency']}e0 * {rec}"
        f" + {_w['trust']}e0 * {tru} + {_w['source']}e0 * {div} + {_w['geo']}e0 * {geo}) * 100.0e0"
    )
    return {
        "score": s.rnd(total, 2), "recency_comp": s.rnd(rec, 3), "trust_comp": tru,
        "raw_relevance": f"CAST(coalesce({rel}, 70) AS INT)", "raw_importance": f"CAST(coalesce({imp}, 50) AS INT)",
        "age_hours": s.rnd(f"greatest(0.0e0, {age})", 1), "trust_tier": tier,
    }


def _d1(x):
    v = f"CAST(round(({x}) * 10) AS BIGINT)"
    return f"(CAST({v} // 10 AS VARCHAR) || '.' || CAST({v} % 10 AS VARCHAR))"


def reason_sql():
    parts = "list_filter([" + ", ".join([
        "CASE WHEN raw_relevance >= 85 THEN 'High relevance (' || raw_relevance || ')' WHEN raw_relevance >= 70 THEN 'Relevant (' || raw_relevance || ')' END",
        "CASE WHEN raw_importance >= 80 THEN 'High importance (' || raw_importance || ')' WHEN raw_importance >= 65 THEN 'Notable importance (' || raw_importance || ')' END",
        "CASE WHEN trust_tier IN ('institutional', 'primary') THEN 'Institutional source' WHEN trust_tier IN ('useful', 'specialist') THEN 'Specialist source' END",
        f"CASE WHEN age_hours <= 6 THEN 'Recent (' || {_d1('age_hours')} || 'h ago)' WHEN age_hours <= 18 THEN 'Fresh story' END",
    ]) + "], lambda x: x IS NOT NULL)"
    return f"(CASE WHEN len({parts}) > 0 THEN array_to_string({parts}, ', ') ELSE 'Score ' || {_d1(s.rnd('score', 1))} END)"


_es = edition_score_sql(
    "n.relevance_score", "n.importance_score",
    f"((epoch_us({s.to_utc('CAST(' + s.local_date('eff_at') + ' + 1 AS TIMESTAMP) - INTERVAL 1 MICROSECOND')}) - epoch_us(eff_at)) / 3600000000.0e0)",
    "coalesce(s.trust_tier, 'useful')", "(a.id % 3)", "(a.id % 4)",
)


@query("B43 B44", f"""
SELECT *, {reason_sql()} AS reason FROM (SELECT a.id, {', '.join(f'{v} AS {k}' for k, v in _es.items())}
FROM article a LEFT JOIN source_dim s ON s.id = a.source_id LEFT JOIN latest_success n ON n.article_id = a.id)""")
def article_edition_scores(t):
    from newsmart.operators.annotations import pick_annotation
    from newsmart.operators.joins import with_source

    a = with_source(t.articles().select("id", "source_id", "published_at", "collected_at"), t.sources(), ["trust_tier"])
    n = pick_annotation(t.annotations(), "latest_success").select(
        F.col("article_id").alias("id"), "relevance_score", "importance_score"
    )
    eff = F.coalesce("published_at", "collected_at")
    r = scoring.edition_score(
        F.col("relevance_score"), F.col("importance_score"),
        dates.hours_between(dates.day_end_inclusive(dates.local_date(eff)), eff), F.col("source_trust_tier"),
        F.col("id") % 3, F.col("id") % 4,
    )
    out = a.join(n, "id", "left").select("id", r.alias("r"))
    return out.select("id", "r.*", scoring.selection_reason(F.col("r")).alias("reason"))


def _kw_labels(patterns, n):
    items = ", ".join(
        f"CASE WHEN regexp_matches(x, {s.q(scoring.whole_words([p]))}) THEN {s.q(p.replace('(?:s)?', ''))} END" for p in patterns
    )
    return f"array_to_string(list_filter([{items}], lambda z: z IS NOT NULL)[1:{n}], ', ')"


def _kw_any(patterns):
    return f"regexp_matches(x, {s.q(scoring.whole_words(patterns))})"


PRIORITY_SQL = f"""(SELECT *, least(100.0e0, base_score + least(50.0e0, wait * 2.0e0)) AS eff FROM (
SELECT *, CAST(greatest(0, least(100, t_pts + f_pts + c_pts + CASE WHEN low THEN -30 ELSE 0 END
   + CASE WHEN crit THEN 25 WHEN high THEN 15 WHEN norm THEN 8 ELSE 0 END)) AS INT) AS base_score FROM (
SELECT *, {_kw_any(lx.LOW_KEYWORDS)} AS low, {_kw_any(lx.CRITICAL_KEYWORDS)} AS crit, {_kw_any(lx.HIGH_KEYWORDS)} AS high,
  {_kw_any(lx.NORMAL_KEYWORDS)} AS norm FROM (
SELECT a.id, a.collected_at, a.eff_at, coalesce(s.trust_tier, 'useful') AS tier, coalesce(s.source_family, 'news') AS fam,
  coalesce(a.primary_category, s.category) AS cat, a.title || ' ' || coalesce(a.raw_summary, '') AS x,
  coalesce({s.case_map("coalesce(s.trust_tier, 'useful')", lx.PRIORITY_TRUST)}, 5) AS t_pts,
  coalesce({s.case_map("coalesce(s.source_family, 'news')", lx.PRIORITY_FAMILY)}, 5) AS f_pts,
  CASE WHEN coalesce(a.primary_category, s.category) IS NULL THEN 0 ELSE coalesce({s.case_map('coalesce(a.primary_category, s.category)', lx.PRIORITY_CATEGORY)}, 5) END AS c_pts,
  greatest(0.0e0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(a.collected_at)) / 3600000000.0e0) AS wait
FROM article a LEFT JOIN source_dim s ON s.id = a.source_id))))"""
TIER_SQL = "CASE WHEN eff >= 80 THEN 'P0_CRITICAL' WHEN eff >= 60 THEN 'P1_HIGH' WHEN eff >= 35 THEN 'P2_NORMAL' ELSE 'P3_LOW' END"


def prioritised(t, reasons=True):
    from newsmart.operators.joins import with_source

    a = with_source(
        t.articles(heavy=True).select("id", "source_id", "title", "raw_summary", "published_at", "collected_at", "primary_category"),
        t.sources(), ["trust_tier", "source_family", "category"],
    )
    r = scoring.queue_priority(
        F.col("source_trust_tier"), F.col("source_source_family"), F.coalesce("primary_category", "source_category"),
        F.col("title"), F.col("raw_summary"),
        dates.hours_between(dates.ts(AS_OF), F.coalesce("collected_at", "published_at")), reasons,
    )
    return a.withColumn("r", r)


@query("B45", f"""
SELECT id, base_score, {s.rnd('least(50.0e0, wait * 2.0e0)', 2)} AS aging_bonus, {s.rnd('eff', 2)} AS effective_score, {TIER_SQL} AS priority_tier,
  array_to_string(list_filter(['Trust tier ''' || tier || ''' (+' || t_pts || ')', 'Source family ''' || fam || ''' (+' || f_pts || ')',
   'Category ''' || cat || ''' (+' || c_pts || ')',
   CASE WHEN low THEN 'Low priority material match: ' || {_kw_labels(lx.LOW_KEYWORDS, 2)} || ' (-30)' END,
   CASE WHEN crit THEN 'Critical keyword match: ' || {_kw_labels(lx.CRITICAL_KEYWORDS, 3)} || ' (+25)' END,
   CASE WHEN high AND NOT crit THEN 'High strategic keyword match: ' || {_kw_labels(lx.HIGH_KEYWORDS, 3)} || ' (+15)' END,
   CASE WHEN norm AND NOT crit AND NOT high THEN 'Strategic keyword match: ' || {_kw_labels(lx.NORMAL_KEYWORDS, 3)} || ' (+8)' END,
   CASE WHEN least(50.0e0, wait * 2.0e0) > 0.5 THEN 'Aging bonus: ' || {_d1(s.rnd('wait', 1))} || 'h in queue (+' || {_d1(s.rnd('least(50.0e0, wait * 2.0e0)', 1))} || ' pts)' END
  ], lambda z: z IS NOT NULL), '; ') AS reasons
FROM {PRIORITY_SQL}""")
def queue_priorities(t):
    return prioritised(t).select("id", "r.*").withColumn("reasons", F.array_join("reasons", "; "))


@query("B46", f"""
SELECT id, {s.rnd('''score + CASE WHEN n >= 2 THEN 10.0e0 ELSE 0.0e0 END
  + CASE WHEN sec IN ('ECONOMY','WORLD','ENERGY','TRADE') THEN 10.0e0 WHEN st IN ('CENTRAL_BANK','GOVERNMENT') THEN 15.0e0 ELSE 0.0e0 END
  + CASE WHEN coalesce(imp, 50) >= 80 THEN 5.0e0 ELSE 0.0e0 END''', 1)} AS significance
FROM (SELECT a.id, 40.0e0 + a.id % 50 AS score, a.id % 4 AS n, {s.case_map("lower(coalesce(a.primary_category, s.category))", lx.EVENT_SECTIONS, "'WORLD'")} AS sec,
  s.source_type AS st, f.importance_score AS imp
FROM article a LEFT JOIN source_dim s ON s.id = a.source_id LEFT JOIN first_relevant f ON f.article_id = a.id)""")
def lead_significances(t):
    from newsmart.operators.annotations import pick_annotation
    from newsmart.operators.joins import with_source

    a = with_source(t.articles().select("id", "source_id", "primary_category"), t.sources(), ["source_type", "category"])
    n = pick_annotation(t.annotations(), "first_relevant").select(F.col("article_id").alias("id"), "importance_score")
    return a.join(n, "id", "left").select(
        "id",
        scoring.lead_significance(
            F.lit(40.0) + F.col("id") % 50, F.col("id") % 4,
            scoring.event_section(F.coalesce("primary_category", "source_category")),
            F.col("source_source_type"), F.col("importance_score"),
        ).alias("significance"),
    )


_bad = "lower(trim(coalesce(cat, ''))) NOT IN " + s.inlist([c.lower() for c in lx.CATEGORIES])


@query("B48", f"""
SELECT annotation_id, array_to_string(issues, '; ') AS issues,
  CASE WHEN len(issues) > 0 THEN 'invalid_json' WHEN is_relevant THEN 'success' ELSE 'out_of_scope' END AS status,
  CASE WHEN is_relevant THEN {s.case_map('lower(trim(cat))', {c.lower(): c for c in lx.CATEGORIES})} END AS category,
  CASE WHEN NOT is_relevant THEN coalesce(nullif(trim(reason), ''), '{lx.OUT_OF_SCOPE}') END AS rejection_reason
FROM (SELECT *, list_filter([CASE WHEN is_relevant IS NULL THEN 'is_relevant missing' END,
   CASE WHEN imp < 0 OR imp > 100 THEN 'importance_score out of range' END, CASE WHEN rel < 0 OR rel > 100 THEN 'relevance_score out of range' END,
   CASE WHEN is_relevant AND coalesce(cat, '') = '' THEN 'primary_category required' END,
   CASE WHEN is_relevant AND coalesce(cat, '') <> '' AND {_bad} THEN 'primary_category unknown' END], lambda x: x IS NOT NULL) AS issues
 FROM (SELECT annotation_id, is_relevant, importance_score + CASE WHEN article_id % 7 = 0 THEN 60 ELSE 0 END AS imp, relevance_score AS rel,
   CASE WHEN article_id % 11 = 0 THEN NULL WHEN article_id % 13 = 0 THEN 'Gossip' WHEN article_id % 5 = 0 THEN ' ' || upper(primary_category) || ' ' ELSE primary_category END AS cat,
   CASE article_id % 3 WHEN 0 THEN ' Sports only ' WHEN 1 THEN '  ' END AS reason FROM annotation))""")
def annotation_validation(t):
    i = F.col("article_id")
    a = t.annotations().select(
        "annotation_id", "is_relevant", (F.col("importance_score") + F.when(i % 7 == 0, 60).otherwise(0)).alias("imp"),
        F.col("relevance_score").alias("rel"),
        F.when(i % 11 == 0, None).when(i % 13 == 0, F.lit("Gossip")).when(i % 5 == 0, F.concat(F.lit(" "), F.upper("primary_category"), F.lit(" "))).otherwise(F.col("primary_category")).alias("cat"),
        F.when(i % 3 == 0, F.lit(" Sports only ")).when(i % 3 == 1, F.lit("  ")).alias("reason"),
    )
    issues = scoring.annotation_issues(F.col("is_relevant"), F.col("cat"), F.col("imp"), F.col("rel"))
    return a.withColumn("issues", issues).select(
        "annotation_id", F.array_join("issues", "; ").alias("issues"),
        F.when(F.size("issues") > 0, F.lit("invalid_json")).when(F.col("is_relevant"), F.lit("success"))
        .otherwise(F.lit("out_of_scope")).alias("status"),
        scoring.canonical_category(F.col("is_relevant"), F.col("cat")).alias("category"),
        scoring.rejection_text(F.col("is_relevant"), F.col("reason")).alias("rejection_reason"),
    )


@query("B49", """
SELECT annotation_id, CASE WHEN is_relevant IS NULL THEN CASE WHEN status = 'invalid_json' THEN article_id END ELSE importance_score END AS importance
FROM annotation WHERE is_relevant IS NOT NULL OR status = 'invalid_json'""")
def fenced_annotations(t):
    """Wrap stored JSON in code fences, cut the brace off some, then clean and parse it back."""
    a = t.annotation_json().where(F.col("output_json").isNotNull())
    i = F.col("annotation_id")
    good = F.when(F.col("status") == "invalid_json", F.concat(F.lit('{"importance_score": '), F.col("article_id").cast("string"), F.lit("}")))
    body = F.coalesce(good, F.col("output_json"))
    wrapped = (
        F.when(i % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(i % 3 == 1, F.regexp_replace(body, r"^\{", ""))
        .otherwise(body)
    )
    return a.select(
        "annotation_id", F.get_json_object(text.strip_fences(wrapped), "$.importance_score").cast("bigint").alias("importance")
    )


@query("B50 B51", f"""
SELECT lens, n, CASE WHEN n >= 20 THEN '20+' WHEN n >= 10 THEN '10-19' WHEN n >= 5 THEN '5-9' WHEN n >= 1 THEN '1-4' ELSE '0' END AS band
FROM (SELECT lens, count(*) AS n FROM article_country JOIN (SELECT lens, unnest(codes) AS code FROM
  {s.values([(k,) for k in lx.LENSES], ['lens'])} JOIN (SELECT {' UNION ALL SELECT '.join(f"{s.q(k)} AS k, {s.arr(v[1])} AS codes" for k, v in lx.LENSES.items())}) ON k = lens)
  ON code = country_code GROUP BY 1)""")
def lens_density(t):
    lens = F.array(*[F.struct(F.lit(k).alias("lens"), text.str_array(v[1]).alias("codes")) for k, v in lx.LENSES.items()])
    hit = F.transform(F.filter(lens, lambda x: F.array_contains(x["codes"], F.col("country_code"))), lambda x: x["lens"])
    g = t.article_countries().select(F.explode(hit).alias("lens")).groupBy("lens").agg(F.count(F.lit(1)).alias("n"))
    return g.select("lens", "n", scoring.density_band(F.col("n")).alias("band"))
