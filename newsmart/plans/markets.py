"""Market series, baskets, breadth and market-linked stories."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions import dates
from newsmart.functions import markets as fm
from newsmart.functions.numbers import round_half_up
from newsmart.operators import markets, pairs
from newsmart.operators.windows import global_rank
from newsmart.plans import sqltext as s
from newsmart.plans.registry import query
from newsmart.plans.scalars import AS_OF, SNAPSHOT_SQL, snapshots, stamp
from newsmart.sources import baskets

NOW = f"TIMESTAMP '{AS_OF}'"
_pt = f"(SELECT instrument, date, {s.rnd('arg_min(close, seq)', 2)} AS close FROM price WHERE close > 0 GROUP BY 1, 2)"


@query("W25", f"SELECT instrument, CAST(date AS VARCHAR) AS day, close FROM {_pt}")
def daily_points(t):
    return markets.daily_points(t.prices()).select("instrument", F.col("date").cast("string").alias("day"), "close")


_yr = f"""e AS (SELECT instrument, max(date) AS d_end, arg_max(close, date) AS latest FROM {_pt} GROUP BY 1),
 p AS (SELECT q.*, d_end, latest FROM {_pt} q JOIN e USING (instrument) WHERE date > d_end - 365),
 g AS (SELECT instrument, any_value(latest) AS latest, max(close) AS high, min(close) AS low, coalesce(arg_min(close, date) FILTER (WHERE year(date) = year(d_end)), arg_min(close, date)) AS base FROM p GROUP BY 1)"""


@query("W27", f"WITH {_yr} SELECT instrument, latest, high, low, {s.rnd('(latest - high) / high * 100.0e0', 2)} AS from_high_pct, {s.rnd('(latest - base) / base * 100.0e0', 2)} AS ytd_pct FROM g")
def year_statistics(t):
    return markets.year_stats(markets.daily_points(t.prices()))


@query("W27", f"""
SELECT instrument, CAST(date AS VARCHAR) AS day, max(close) OVER w AS high, min(close) OVER w AS low FROM {_pt} WINDOW w AS (PARTITION BY instrument ORDER BY date RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW)""")
def rolling_year_range(t):
    return markets.rolling_range(markets.daily_points(t.prices())).select("instrument", F.col("date").cast("string").alias("day"), "high", "low")


_bk = s.values([(i, *row) for i, row in enumerate(baskets.instrument_rows())], ["k", "canonical_id", "region", "asset_class", "display_name", "currency"])


@query("A6 W26", f"""
SELECT x.instrument, b.canonical_id, b.region, b.asset_class, b.display_name, b.currency, latest_close, direction FROM {SNAPSHOT_SQL} x JOIN {_bk} b ON b.k = x.instrument % {len(baskets.instrument_rows())}""")
def basket_snapshots(t):
    b = baskets.instruments(t.spark)
    x = snapshots(t).withColumn("k", F.col("instrument") % len(baskets.instrument_rows()))
    return x.join(F.broadcast(b), "k").select("instrument", "canonical_id", "region", "asset_class", "display_name", "currency", "latest_close", "direction")


_br = f"""br AS (SELECT count(*) AS n, count(*) FILTER (WHERE direction = 'UP') AS up, count(*) FILTER (WHERE direction = 'DOWN') AS down, count(*) FILTER (WHERE direction = 'FLAT') AS flat,
 arg_max(instrument, (abs(change_percent), -instrument)) AS top_instrument, arg_max(change_percent, (abs(change_percent), -instrument)) AS top_change, arg_max(direction, (abs(change_percent), -instrument)) AS top_direction FROM {SNAPSHOT_SQL}),
 mood AS (SELECT *, CASE WHEN down > up AND down >= 3 THEN 'RISK_OFF' WHEN up > down AND up >= 3 THEN 'RISK_ON' ELSE 'MIXED' END AS sentiment FROM br)"""


@query("E36", f"WITH {_br} SELECT * FROM mood")
def market_breadth(t):
    return markets.breadth(snapshots(t))


def _dec(x, d):
    v = f"CAST(round(abs({x}) * {10**d}) AS BIGINT)"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || format('{{:,}}', {v} // {10**d}) || '.' || lpad(CAST({v} % {10**d} AS VARCHAR), {d}, '0'))"


def _plain(x, d):
    return _dec(x, d).replace("format('{:,}', ", "CAST(").replace(f" // {10**d})", f" // {10**d} AS VARCHAR)")


# --- affinity -------------------------------------------------------------------------
_reg = " UNION ALL ".join(
    f"SELECT {i} AS ord, {s.q(r)} AS region, {s.arr(k)} AS kws, {s.arr(c)} AS codes, {s.arr(g)} AS cats" for i, (r, k, c, g) in enumerate(lx.MARKET_REGIONS)
)
_mv = " OR ".join(f"regexp_matches(mt, {s.q(p)})" for p in lx.MARKET_MOVING_PATTERNS)
s.cte("affinity_all", f"""
WITH reg AS ({_reg}), a AS (SELECT a.id, a.eff_at, a.published_at, a.collected_at, lower(concat_ws(' ', coalesce(title, ''), coalesce(raw_summary, ''), coalesce(n.summary, ''))) AS txt, lower(concat_ws(' ', coalesce(title, ''), coalesce(n.summary, ''))) AS mt,
  coalesce(n.primary_category, s.category) AS cat, coalesce(n.importance_score, 5) AS imp, coalesce(n.relevance_score, 5) AS rel, coalesce(c.places, CAST([] AS VARCHAR[])) AS places
  FROM article a LEFT JOIN source_dim s ON s.id = a.source_id LEFT JOIN first_any n ON n.article_id = a.id LEFT JOIN (SELECT article_id, list(country_code) AS places FROM article_country GROUP BY 1) c ON c.article_id = a.id),
 x AS (SELECT a.*, ord, region, len(list_filter(kws, lambda k: contains(txt, k))) AS keywords, len(list_intersect(codes, places)) > 0 AS place, coalesce(list_contains(cats, cat), false) AS sector FROM a, reg)
SELECT id, ord, region, CAST(keywords AS INT) AS keywords, place, sector, {s.rnd('keywords * 10.0e0 + CASE WHEN place THEN 25.0e0 ELSE 0.0e0 END + CASE WHEN sector THEN 15.0e0 ELSE 0.0e0 END + imp * 2.0e0 + rel * 1.5e0', 2)} AS score, CASE WHEN {_mv} THEN 'MARKET_MOVING' ELSE 'RELATED' END AS relationship, imp, eff_at, published_at, collected_at
FROM x WHERE keywords > 0 OR place OR sector""")


def matched(t, articles=None):
    return markets.affinity(articles if articles is not None else t.articles(heavy=True), t.annotations(), t.sources(), t.article_countries())


@query("D11 D12 B32", "SELECT id, region, keywords, place, sector, score, relationship FROM affinity_all")
def market_affinity(t):
    return matched(t).select("id", "region", "keywords", "place", "sector", "score", "relationship")


_pool = f"pool AS (SELECT id FROM article WHERE (published_at IS NULL OR published_at <= {NOW}) AND (published_at >= {NOW} - INTERVAL 48 HOUR OR collected_at >= {NOW} - INTERVAL 48 HOUR) ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 100)"


@query("W22", f"""
WITH {_pool}, m AS (SELECT * FROM affinity_all WHERE id IN (SELECT id FROM pool))
SELECT 'featured' AS kind, * FROM (SELECT id, region, relationship FROM m WHERE region = 'United States' ORDER BY relationship = 'MARKET_MOVING' DESC, score DESC, eff_at DESC, id LIMIT 1)
UNION ALL SELECT 'recent', * FROM (SELECT id, region, relationship FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS r FROM m) WHERE r = 1 ORDER BY relationship = 'MARKET_MOVING' DESC, eff_at DESC, imp DESC, id LIMIT 6)""")
def market_stories(t):
    m = matched(t, markets.recent_pool(t.articles(), dates.ts(AS_OF)))
    f = markets.featured(m, "United States").select(F.lit("featured").alias("kind"), "id", "region", "relationship")
    return f.unionByName(markets.recent_stories(m).select(F.lit("recent").alias("kind"), "id", "region", "relationship"))


_ecb = next(r for r in lx.POLICY_BASKET if r[0] == "European Central Bank")


@query("E37 B37", f"""
WITH {_br}, {_pool}, m AS (SELECT count(DISTINCT id) AS k FROM affinity_all WHERE region = 'United States' AND id IN (SELECT id FROM pool))
SELECT 'GLOBAL SENTIMENT' AS topic, CASE sentiment WHEN 'RISK_OFF' THEN 'Broad risk-off session across tracked equity markets (' || down || ' of ' || n || ' indices down).' WHEN 'RISK_ON' THEN 'Positive risk-on sentiment across global benchmarks (' || up || ' of ' || n || ' indices up).'
  ELSE 'Mixed market sentiment across global regions (' || up || ' up, ' || down || ' down, ' || flat || ' flat).' END || ' US 10Y Treasury yield stands at 4.27% (+7 bp).' AS text FROM mood
UNION ALL SELECT 'MARKET FOCUS', 'Largest index movement observed in ' || top_instrument || ' (' || CASE WHEN top_change >= 0 THEN '+' ELSE '' END || {_dec(s.rnd('top_change', 2), 2)} || '% ' || top_direction || '). ECB Deposit Facility Rate stands at 3.25% (Last action: CUT).' FROM mood
UNION ALL SELECT 'COVERAGE NOTICE', CASE WHEN k > 0 THEN 'Among currently processed intelligence in the active archive window, ' || k || ' stories correlate with market sentiment.' ELSE 'Among currently processed intelligence, no explicit market-moving headlines detected in the current 48-hour window.' END FROM m""")
def market_takeaways(t):
    m = matched(t, markets.recent_pool(t.articles(), dates.ts(AS_OF))).where(F.col("region") == "United States").agg(F.count_distinct("id").alias("n"))
    return markets.takeaways(markets.breadth(snapshots(t)), baskets.yields(t.spark), baskets.policies(t.spark), m)


# --- duplicate mining ---------------------------------------------------------------------
_mk = " OR ".join(f"(contains(x.t, '{w}') AND contains(y.t, '{w}'))" for w in pairs.EVENT_MARKERS)


@query("G7", rf"""
WITH r AS (SELECT id, lower(title) AS t, list_distinct({s.words('lower(title)')}) AS w, published_at, row_number() OVER (ORDER BY eff_at, id) AS rk FROM article)
SELECT x.id AS a, y.id AS b, CAST(len(list_intersect(x.w, y.w)) AS INT) AS common FROM r x JOIN r y ON y.rk > x.rk AND y.rk < x.rk + 40
WHERE (x.published_at IS NULL OR y.published_at IS NULL OR abs(epoch_us(x.published_at) - epoch_us(y.published_at)) <= {pairs.WINDOW_US}) AND (len(list_intersect(x.w, y.w)) >= 3 OR {_mk})""")
def duplicate_candidates(t):
    a = t.articles(heavy=True).select("id", "title", F.unix_micros("published_at").alias("pub_us"), F.coalesce("published_at", "collected_at").alias("at"))
    return pairs.near_neighbours(global_rank(a, ["at", "id"]))
