"""Price series operators (long format: instrument, date, sequence, close)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions.markets import market_moving, signed_percent
from newsmart.functions.numbers import fixed, round_half_up
from newsmart.functions.text import str_array
from newsmart.operators.annotations import pick_annotation
from newsmart.operators.joins import with_source


def latest_two(prices: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest and previous valid close per instrument, with a bounded map-side aggregate."""
    valid = prices.where(F.col("close") > 0)
    rank = F.struct(*order)
    top = valid.groupBy(key).agg(F.max_by("close", rank).alias("latest"), F.max(rank).alias("at"))
    rest = valid.join(top.select(key, "at"), key).where(rank < F.col("at"))
    second = rest.groupBy(key).agg(F.max_by("close", rank).alias("previous"))
    return top.select(key, "latest").join(second, key, "left")


def daily_points(prices: DataFrame, key: str = "instrument", first: bool = True) -> DataFrame:
    """One valid point per instrument and date: the first (or last) by sequence."""
    valid = prices.where(F.col("close") > 0)
    pick = F.min_by("close", "seq") if first else F.max_by("close", "seq")
    return valid.groupBy(key, "date").agg(round_half_up(pick, 2).alias("close"))


def year_stats(points: DataFrame, key: str = "instrument", days: int = 365) -> DataFrame:
    """High, low, distance from high and change since the start of the year, per instrument, over the
    trailing year; all of it combining aggregates."""
    end = points.groupBy(key).agg(F.max("date").alias("end"), F.max_by("close", "date").alias("latest"))
    p = points.join(end, key).where(F.col("date") > F.date_sub("end", days))
    this_year = F.when(F.year("date") == F.year("end"), F.col("date"))
    g = p.groupBy(key).agg(
        F.any_value("latest").alias("latest"), F.max("close").alias("high"), F.min("close").alias("low"),
        F.min_by("close", this_year).alias("year_open"), F.min_by("close", "date").alias("first"),
    )
    base = F.coalesce("year_open", "first")
    pct = lambda b: round_half_up((F.col("latest") - b) / b * F.lit(100.0), 2)
    return g.select(key, "latest", "high", "low", pct(F.col("high")).alias("from_high_pct"), pct(base).alias("ytd_pct"))


def rolling_range(points: DataFrame, key: str = "instrument", days: int = 365) -> DataFrame:
    """Trailing high and low at every date. One row per date, so an instrument's series stays small."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(key).orderBy(day).rangeBetween(-(days - 1), 0)
    return points.select(key, "date", "close", F.max("close").over(w).alias("high"), F.min("close").over(w).alias("low"))


def breadth(snapshots: DataFrame) -> DataFrame:
    """Counts by direction, sentiment and the largest mover."""
    n = lambda d: F.count_if(F.col("direction") == d)
    g = snapshots.agg(
        F.count(F.lit(1)).alias("n"), n("UP").alias("up"), n("DOWN").alias("down"), n("FLAT").alias("flat"),
        F.max_by(F.struct("instrument", "change_percent", "direction"), F.struct(F.abs("change_percent"), -F.col("instrument"))).alias("top"),
    )
    up, down = F.col("up"), F.col("down")
    mood = F.when((down > up) & (down >= 3), F.lit("RISK_OFF")).when((up > down) & (up >= 3), F.lit("RISK_ON")).otherwise(F.lit("MIXED"))
    return g.select("n", "up", "down", "flat", mood.alias("sentiment"), F.col("top.instrument").alias("top_instrument"), F.col("top.change_percent").alias("top_change"), F.col("top.direction").alias("top_direction"))


def takeaways(breadth_row: DataFrame, yields: DataFrame, policies: DataFrame, matched: DataFrame) -> DataFrame:
    """Three short texts from breadth, the benchmark yield, one policy rate and archive coverage.

    yields: instrument_id, yield_percent, change_bp. policies: central_bank, rate, action. All one-row reads.
    """
    y = yields.where(F.col("instrument_id") == "US_10Y_TREASURY")
    p = policies.where(F.col("central_bank") == "European Central Bank")
    one = lambda df, c: df.select(c).scalar()
    s = lambda c: F.col(c).cast("string")
    mood = (
        F.when(F.col("sentiment") == "RISK_OFF", F.concat(F.lit("Broad risk-off session across tracked equity markets ("), s("down"), F.lit(" of "), s("n"), F.lit(" indices down).")))
        .when(F.col("sentiment") == "RISK_ON", F.concat(F.lit("Positive risk-on sentiment across global benchmarks ("), s("up"), F.lit(" of "), s("n"), F.lit(" indices up).")))
        .otherwise(F.concat(F.lit("Mixed market sentiment across global regions ("), s("up"), F.lit(" up, "), s("down"), F.lit(" down, "), s("flat"), F.lit(" flat).")))
    )
    x = breadth_row.select("*", one(y, "yield_percent").alias("y"), one(y, "change_bp").alias("bp"), one(p, "rate").alias("r"), one(p, "action").alias("act"), one(matched, "n").alias("m"))
    bp = F.concat(F.when(F.col("bp") > 0, F.lit("+")).otherwise(F.lit("")), F.regexp_replace(fixed(F.col("bp"), 1), r"\.0$", ""))
    sent = F.concat(mood, F.lit(" US 10Y Treasury yield stands at "), fixed(F.col("y"), 2), F.lit("% ("), bp, F.lit(" bp)."))
    focus = F.concat(
        F.lit("Largest index movement observed in "), s("top_instrument"), F.lit(" ("), signed_percent(F.col("top_change")), F.lit(" "), "top_direction", F.lit(")."),
        F.lit(" ECB Deposit Facility Rate stands at "), fixed(F.col("r"), 2), F.lit("% (Last action: "), "act", F.lit(")."),
    )
    cov = F.when(
        F.col("m") > 0, F.concat(F.lit("Among currently processed intelligence in the active archive window, "), s("m"), F.lit(" stories correlate with market sentiment."))
    ).otherwise(F.lit("Among currently processed intelligence, no explicit market-moving headlines detected in the current 48-hour window."))
    rows = F.array(*[F.struct(F.lit(t).alias("topic"), c.alias("text")) for t, c in (("GLOBAL SENTIMENT", sent), ("MARKET FOCUS", focus), ("COVERAGE NOTICE", cov))])
    return x.select(F.explode(rows).alias("t")).select("t.*")


def affinity(articles: DataFrame, annotations: DataFrame, sources: DataFrame, bridge: DataFrame) -> DataFrame:
    """(id, region, ...): every market region an article matches, with score and relationship.

    The regions ride along as a literal, so the text is scanned once per article and nothing is joined to it.
    """
    a = with_source(articles.select("id", "source_id", "title", "raw_summary", "published_at", "collected_at"), sources, ["category"])
    n = pick_annotation(annotations, "first").select(F.col("article_id").alias("id"), F.col("summary"), F.col("primary_category").alias("a_cat"), "importance_score", "relevance_score")
    regions = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(r).alias("region"), str_array(k).alias("keywords"), str_array(c).alias("codes"), str_array(g).alias("categories"))
            for i, (r, k, c, g) in enumerate(lx.MARKET_REGIONS)
        ]
    )
    codes = sorted({c for _, _, cs, _ in lx.MARKET_REGIONS for c in cs})
    c = bridge.where(F.col("country_code").isin(codes)).groupBy(F.col("article_id").alias("id")).agg(F.collect_set("country_code").alias("places"))
    r = a.join(n, "id", "left").join(c, "id", "left")
    e = lambda x: F.coalesce(F.col(x), F.lit(""))
    full = F.lower(F.concat_ws(" ", e("title"), e("raw_summary"), e("summary")))
    r = r.withColumn("txt", full).withColumn("cat", F.coalesce("a_cat", "source_category")).withColumn("places", F.coalesce("places", F.array().cast("array<string>")))
    hits = F.transform(
        regions,
        lambda g: F.struct(
            g["ord"].alias("ord"), g["region"].alias("region"), F.filter(g["keywords"], lambda k: F.col("txt").contains(k)).alias("found"),
            F.arrays_overlap(g["codes"], F.col("places")).alias("place"), F.coalesce(F.array_contains(g["categories"], F.col("cat")), F.lit(False)).alias("sector"),
        ),
    )
    x = r.select("id", "title", "summary", "published_at", "collected_at", "importance_score", "relevance_score", F.explode(hits).alias("h")).select("*", "h.*").drop("h")
    base = F.size("found") * F.lit(10.0) + F.when(F.col("place"), F.lit(25.0)).otherwise(F.lit(0.0)) + F.when(F.col("sector"), F.lit(15.0)).otherwise(F.lit(0.0))
    imp, rel = F.coalesce("importance_score", F.lit(5)), F.coalesce("relevance_score", F.lit(5))
    moving = market_moving(F.concat_ws(" ", e("title"), e("summary")))
    return x.where(base > 0).select(
        "id", "ord", "region", F.size("found").alias("keywords"), "place", "sector", round_half_up(base + imp * F.lit(2.0) + rel * F.lit(1.5), 2).alias("score"),
        moving["relationship"].alias("relationship"), imp.alias("importance"), F.coalesce("published_at", "collected_at").alias("at"),
    )


def recent_pool(articles: DataFrame, as_of: Column, hours: int = 48, n: int = 100) -> DataFrame:
    """Newest n articles published or collected in the window; the last seven days when fewer than three."""
    ok = articles.where(F.col("published_at").isNull() | (F.col("published_at") <= as_of))

    def since(h):
        cut = as_of - F.expr(f"INTERVAL {h} HOURS")
        rows = ok.where((F.col("published_at") >= cut) | (F.col("collected_at") >= cut))
        return rows.orderBy(F.col("published_at").desc_nulls_last(), F.col("id").desc()).limit(n)

    pool = since(hours)
    return pool if pool.limit(3).count() >= 3 else since(24 * 7)


def featured(matches: DataFrame, region: str) -> DataFrame:
    """Best story of a region: market moving first, then affinity, then newest."""
    moving = (F.col("relationship") == "MARKET_MOVING").cast("int")
    return matches.where(F.col("region") == region).orderBy(moving.desc(), F.desc("score"), F.desc("at"), "id").limit(1)


def recent_stories(matches: DataFrame, k: int = 6) -> DataFrame:
    """Newest k distinct stories, each under its first matching region."""
    one = matches.groupBy("id").agg(F.min_by(F.struct("region", "relationship", "at", "importance"), "ord").alias("m")).select("id", "m.*")
    moving = (F.col("relationship") == "MARKET_MOVING").cast("int")
    return one.orderBy(moving.desc(), F.desc("at"), F.desc("importance"), "id").limit(k)
