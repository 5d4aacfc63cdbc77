import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsmart.functions import dates, entities, markets, scoring, similarity, text, urls
from newsmart.operators import fulltext


def one(spark, value, fn, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://Example.COM/a/?utm_source=x&b=2#top", "https://example.com/a?b=2"),
        ("http://example.com", "http://example.com/"),
        ("http://example.com/?FBCLID=1&k=", "http://example.com/?k="),
        ("http://example.com/a//?q=a%20b&z=*~", "http://example.com/a?q=a+b&z=%2A~"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, url, urls.canonicalize_url) == want


def test_permalink(spark):
    rows = [("http://a/1", "x"), ("ftp://a", "https://b"), ("", "tag:1"), (None, None)]
    got = spark.createDataFrame(rows, "l string, g string").select(urls.permalink(F.col("l"), F.col("g")).alias("r")).collect()
    assert [r["r"] for r in got] == ["http://a/1", "https://b", None, None]


@pytest.mark.parametrize("raw, want", [("  Fed RAISES, rates! ", "fed raises rates"), ("Ökonomie – été", "ökonomie été"), ("a_b  c", "a_b c")])
def test_normalise_title(spark, raw, want):
    assert one(spark, raw, text.normalise_title) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("<p>A&nbsp;&amp; B</p><script>x()</script> tail", "A & B tail"),
        ("  \n ", None),
        ("<b>one</b><i>two</i>", "one two"),
        ("plain", "plain"),
        (None, None),
    ],
)
def test_clean_summary(spark, raw, want):
    assert one(spark, raw, text.clean_summary) == want
    assert one(spark, raw, text.clean_summary_native) == want


def test_capital_runs_break_on_foreign_letters(spark):
    assert one(spark, "New York Café Paris, Bank Of_X Éire Rome", text.capital_runs) == ["New York", "Paris", "Bank", "Rome"]


def test_token_rules(spark):
    assert one(spark, "The Fed says ECB holds rates", text.title_tokens) == ["federal", "reserve", "european", "central", "bank", "holds", "rates"]
    assert one(spark, " Acme Holdings ", text.normalize_token) == "acme"
    assert one(spark, "Bank of England", text.normalize_token) == "bank of england"
    assert set(one(spark, "Fed and Acme Corp meet in China", text.key_entities)) == {"federal reserve", "acme"}


def test_numbers(spark):
    assert sorted(one(spark, "up 25 bps to 4.5% on $1,200m and 3 items", text.numeric_markers)) == ["$1200m", "25bps", "4.5%"]
    assert "3" in one(spark, "and 3 items", text.numeric_tokens)


@pytest.mark.parametrize("day, start", [("2024-01-15", "2024-01-15 00:00:00"), ("2024-07-01", "2024-06-30 23:00:00"), ("2024-03-31", "2024-03-31 00:00:00"), ("2024-04-01", "2024-03-31 23:00:00")])
def test_local_day_start(spark, day, start):
    assert str(one(spark, dt.date.fromisoformat(day), dates.day_start, "date")) == start


def test_day_window_is_half_open(spark):
    rows = [("2024-06-30 22:59:59",), ("2024-06-30 23:00:00",), ("2024-07-01 22:59:59",), ("2024-07-01 23:00:00",)]
    df = spark.createDataFrame(rows, "s string").select(F.col("s").cast("timestamp").alias("t"))
    got = df.select(dates.in_local_day(F.col("t"), F.lit("2024-07-01").cast("date")).alias("r")).collect()
    assert [r["r"] for r in got] == [False, True, True, False]


def test_entity_rules(spark):
    assert one(spark, "Central Banking Authority", entities.normalize_type) == "CENTRAL_BANK"
    assert one(spark, "startup company", entities.normalize_type) == "COMPANY"
    assert one(spark, "Société Générale S.A. Group", lambda c: entities.normalize_name(entities.ascii_fold(c))) == "societe generale s.a."
    assert one(spark, "840", entities.iso_code) == "US" and one(spark, "zz", entities.iso_code) is None
    assert one(spark, "a", entities.is_generic_term) and not one(spark, "Acme", entities.is_generic_term)


def test_market_functions(spark):
    df = spark.createDataFrame([(102.0, 100.0), (100.0, 0.0), (100.0, 100.01)], "a double, b double")
    got = [tuple(r["r"])[2:] for r in df.select(markets.price_change(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [(2.0, 2.0, "UP"), (0.0, 0.0, "FLAT"), (-0.01, -0.01, "FLAT")]
    t = spark.createDataFrame([("2024-01-15 03:00:00",), ("2024-01-13 15:00:00",)], "s string").select(F.col("s").cast("timestamp").alias("t"))
    got = t.select(F.transform(markets.exchange_array(), lambda x: markets.session_state(F.col("t"), x)).alias("r")).collect()
    assert got[0]["r"][3] == "CLOSED" and got[0]["r"][2] == "CLOSED" and set(got[1]["r"]) == {"CLOSED"}  # lunch break, weekend


def test_source_status(spark):
    rows = [(False, "rss", "u", 5), (True, "html", "u", 5), (True, "rss", None, 5), (True, "rss", "u", 0), (True, "rss", "u", 5)]
    df = spark.createDataFrame(rows, "a boolean, t string, u string, n int")
    s = scoring.source_status(F.col("a"), F.col("t"), F.col("u"), F.lit("OK"), F.col("n"), F.lit(None).cast("timestamp"), F.current_timestamp())
    assert [r["r"] for r in df.select(s.alias("r")).collect()] == ["DISABLED", "FAILED", "FAILED", "EMPTY", "HEALTHY"]


def test_similarity_bounds_agree():
    pairs = [("oil prices rise", "oil prices fall"), ("a b c", "c b a"), ("", "x"), ("same title", "same title"), ("abcdef", "abcxyz")]
    for a, b in pairs:
        ta, tb = set(a.split()), set(b.split())
        full = max(len(ta & tb) / len(ta | tb), similarity.ratio(a, b)) if ta and tb else 0.0
        assert similarity.similar(a, b, 0.7) == (full >= 0.7)


def test_fences(spark):
    assert one(spark, '```json\n{"a": 1}\n```', text.strip_fences) == '{"a": 1}'
    assert one(spark, '"a": 1}', text.strip_fences) == '{"a": 1}'


def test_theme_and_language(spark):
    assert one(spark, "Top Tech News", text.is_generic_theme) and not one(spark, "Chip exports", text.is_generic_theme)
    assert one(spark, "Rates set to fall", text.has_predictive_language) and not one(spark, "Goodwill", text.has_predictive_language)


@pytest.mark.parametrize("raw, want", [("004", "AF"), ("616", "PL"), ("840", "US"), ("8", "AL"), ("999", None), ("Russia", "RU"), (None, None)])
def test_country_codes(spark, raw, want):
    assert one(spark, raw, entities.iso_code) == want


@pytest.mark.parametrize(
    "raw, family, tier, weight",
    [
        (None, "News & Media", "Primary", 1), ("", "News & Media", "Primary", 1), ("Institutional", "Institutional", "Institutional", 2),
        ("CENTRAL_BANK", "Central Bank", "Central_bank", 1), ("odd Kind", "Odd kind", "Odd kind", 1),
    ],
)
def test_source_labels(spark, raw, family, tier, weight):
    assert [one(spark, raw, f) for f in (entities.family_label, entities.tier_label, entities.tier_weight)] == [family, tier, weight]


MARKUP = [
    "<p>A &amp; B</p>", "x &amp;lt;b&amp;gt; y", "R&D at AT&T &amp; co", "caf&eacute; &#8211; &#x2014; &#039;q&#39;", "&#150; old dash", "&copy2024 &copy; 2024", "&hearts; &amp;hearts;", "a < b and c > d", "<a title='x>y' href=\"u\">link</a>!",
    "<!DOCTYPE html><html><body>t<br/>u</body>", "a<!-- c <b> -->b", "<script>if (a < b) { '</p>' }</script>z", "<style>p{}</style><SCRIPT src=x></SCRIPT>ok", "<template><p>no</p></template>yes", "<p>broken <b", "&nbsp; &ensp;  ", "", "plain",
    "un&zwj;known &bogus; ref", "<title>a &amp; b</title>", "<?php x ?>y", "<img alt=it's>z", "  x y \r\n z", "<!-->x-->y", "&#xD800; &#0; &#1114112;", "5 &lt 6 &gt7", "<div\nclass='a'\n>multi\nline</div>", "&AMP; &Eacute;&oelig;",
]


def test_native_cleaner_equals_the_parser(spark):
    rows = spark.createDataFrame(list(enumerate(MARKUP)), "i int, x string")
    got = rows.select("x", text.clean_summary("x").alias("want"), text.clean_markup(F.col("x")).alias("got"), text.is_plain_markup(F.col("x")).alias("plain"), text.clean_summary_native(F.col("x")).alias("native")).collect()
    assert [(r["x"], r["got"]) for r in got] == [(r["x"], r["want"]) for r in got]
    assert [(r["x"], r["native"]) for r in got if r["plain"]] == [(r["x"], r["want"]) for r in got if r["plain"]]
    assert sum(r["plain"] for r in got) >= 15


@pytest.mark.parametrize("raw, want", [("<title>a &amp;&amp</title><p>b", "a &&amp b"), ("5 &lt 6 &copy2024 &amp;gt x", "5 &lt 6 &copy2024 &gt x"), ("&notit; &not;it;", "&notit; ¬it;")])
def test_references_without_a_semicolon_stay_text(spark, raw, want):
    assert one(spark, raw, text.clean_summary) == want
    assert one(spark, raw, text.clean_markup) == want


def test_stem(spark):
    words = {"running": "run", "cities": "city", "studied": "study", "falling": "fall", "banks": "bank", "nations": "nation", "movements": "mov", "ring": "ring", "is": "is", "hopefulness": "hope", "markets": "market", "planned": "plan"}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", fulltext.stem(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == words
