import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions import dates
from newsmart.operators import annotations, archive, audits, clusters, daily, evaluate, evidence, feeds, graph, neighbours, pairs, saved, selection, signals, suppress, windows
from newsmart.session import cut_lineage
from newsmart.sources import readers, writers

T0 = dt.datetime(2024, 1, 10, 12)


def ts(h):
    return T0 + dt.timedelta(hours=h)


ART = "id long, source_id int, title string, raw_summary string, canonical_url string, published_at timestamp, collected_at timestamp, primary_category string"
SRC = "id int, name string, feed_url string, website_url string, source_type string, source_family string, category string, trust_tier string, active boolean, country_code string"
ANN = (
    "annotation_id long, article_id long, status string, is_relevant boolean, primary_category string, importance_score int, relevance_score int, summary string, "
    "topics array<string>, countries array<string>, entities array<struct<name:string,type:string,context:string>>, created_at timestamp, processed_at timestamp"
)


def articles(spark, rows):
    """rows: (id, source, title, hours, category)"""
    return spark.createDataFrame([(i, s, t, None, f"https://x/{i}", ts(h), ts(h), c) for i, s, t, h, c in rows], ART)


def sources(spark):
    return spark.createDataFrame([(i, f"s{i}", "u", "w", "rss", "news", "Energy", "useful", i != 9, "US") for i in range(1, 10)], SRC)


def no_notes(spark):
    return spark.createDataFrame([], ANN)


def test_annotation_policies(spark):
    rows = [
        (1, 1, "failed", None, 0), (2, 1, "success", True, 1), (3, 1, "success", False, 2), (4, 1, "timeout", None, 3), (5, 2, "processing", None, 0),
    ]
    a = spark.createDataFrame([(i, a, s, r, None, None, None, None, None, None, None, ts(h), ts(h)) for i, a, s, r, h in rows], ANN)
    got = {p: {r["article_id"]: r["annotation_id"] for r in annotations.pick_annotation(a, p).collect()} for p in annotations.POLICIES}
    assert got == {"latest": {1: 4, 2: 5}, "latest_success": {1: 3}, "first_relevant": {1: 2}, "first": {1: 1, 2: 5}}
    assert annotations.out_of_scope(a).count() == 0


def test_diversity_cap_fills_from_overflow(spark):
    rows = [(i, 1 if i < 6 else 2, i) for i in range(1, 8)]
    f = spark.createDataFrame(rows, "id long, source_id int, ord int")
    got = [r["id"] for r in feeds.diversity_cap(f, 2, 6).orderBy("position").collect()]
    assert got == [1, 2, 6, 7, 3, 4]


def test_pagination_is_clamped(spark):
    a = articles(spark, [(i, 1, "t", i, None) for i in range(7)])
    p = feeds.paginate(a, feeds.newest_first(), 99, 3).collect()
    assert [r["id"] for r in p] == [0] and p[0]["page"] == 3 and not p[0]["has_next"]


def test_future_rows_are_not_in_feed(spark):
    a = articles(spark, [(1, 1, "now", 0, None), (2, 1, "later", 5, None)])
    got = feeds.recent_feed(a, no_notes(spark), sources(spark), dates.ts(str(ts(1)))).collect()
    assert [r["id"] for r in got] == [1]


def test_components_on_chain_star_and_loop(spark):
    chain = [(i, i + 1) for i in range(100, 164)]
    star = [(500, 500 + i) for i in range(1, 40)]
    e = spark.createDataFrame(chain + star + [(7, 7), (9, 8)], "u long, v long")
    got = {r["id"]: r["label"] for r in graph.connected_components(e).collect()}
    assert all(got[i] == 100 for i in range(101, 165)) and all(got[500 + i] == 500 for i in range(1, 40)) and got[9] == 8 and 7 not in got


def _brute_components(feats, threshold):
    a = feats.select(F.col("id").alias("a"), F.col("at_us").alias("ta"), F.col("pub_us").alias("pa"), F.col("f").alias("fa"))
    b = feats.select(F.col("id").alias("b"), F.col("at_us").alias("tb"), F.col("pub_us").alias("pb"), F.col("f").alias("fb"))
    j = a.join(b, (F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= pairs.WINDOW_US)).where(pairs.compatible(F.col("fa.cat"), F.col("fb.cat")))
    s = pairs.once(j, "s", pairs.static_score(F.col("fa"), F.col("fb")))
    edges = s.where(pairs.is_edge(F.col("s"), pairs.proximity(F.col("pa"), F.col("pb")), threshold)).select("a", "b").collect()
    root = {r["id"]: r["id"] for r in feats.select("id").collect()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in edges:
        x, y = find(r["a"]), find(r["b"])
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_clusters_equal_brute_force(spark, monkeypatch):
    """Copies, variants, shared entities, numbers, conflicts, missing dates, category and time edges."""
    rnd = random.Random(5)
    heads = ["Acme Corp cuts rates 25 bps", "Acme Corp hikes rates 25 bps", "Fed holds rates steady", "Federal Reserve holds steady", "Oil rises 3% in London", "Oil rises 3 % London",
             "Acme", "Kushner Moscow Kiev talks", "Talks Kushner in Moscow Kiev", "Acmeland unveils phone", "Acmeland earnings q3", "the of and", "La Ré opens", "La Ré closes"]
    cats = ["Energy", "World", None, "Business"]
    rows = []
    for i in range(1, 140):
        h = rnd.choice(heads)
        extra = rnd.choice(["", "", " today", " again now", " says minister"])
        rows.append((i, rnd.randint(1, 8), h + extra, rnd.randint(0, 260), rnd.choice(cats)))
    a = articles(spark, rows).withColumn("published_at", F.when(F.col("id") % 6 != 0, F.col("published_at")))
    feats = pairs.features(a, sources(spark))
    want = _brute_components(feats, 0.70)
    got = {r["id"]: r["label"] for r in clusters.assign(feats, 0.70).collect()}
    assert got == want
    again = {r["id"]: r["label"] for r in clusters.assign(feats.repartition(3, "f.cat"), 0.70).collect()}
    assert again == want
    monkeypatch.setattr(pairs, "SUB_BLOCK", 3)  # every block is cut
    assert {r["id"]: r["label"] for r in clusters.assign(feats, 0.70).collect()} == want


def test_unlikely_pairs_are_ruled_out_inside_the_join(spark):
    """Every linked pair passes the glance on one of its common keys; hardly any other pair does, so blocks are not written out."""
    rnd = random.Random(8)
    names = ["Nation", "Nations", "Ationland", "Acme", "Acmeland", "Acme Corp", "Ouwhea", "Thouwhea", "Fed", "Le"]
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    base = [[word() for _ in range(rnd.randint(2, 14))] for _ in range(25)]
    rows = []
    for i in range(1, 260):
        w = [x if rnd.random() < 0.8 else word() for x in rnd.choice(base)]
        e = " and ".join(rnd.sample(names, rnd.randint(0, 4)))
        rows.append((i, rnd.randint(1, 8), " ".join(w) + (" at " + e if e else ""), 0, rnd.choice(["Energy", "World", "Sports", "Health"])))
    sets = pairs.nodes(pairs.features(articles(spark, rows), sources(spark)))[2].localCheckpoint()
    side = lambda p: sets.join(pairs.glances(sets), "sig").select(F.col("sig").alias(f"s{p}"), F.col("f").alias(f"f{p}"), F.col("g").alias(f"g{p}"))
    every = side(1).crossJoin(side(2)).where("s1 < s2").localCheckpoint()
    linked = every.where(pairs.compatible(F.col("f1.cat"), F.col("f2.cat")) & pairs.is_edge(pairs.static_score(F.col("f1"), F.col("f2")), F.lit(1.0), 0.70))
    keys = pairs.candidate_keys(sets.select("sig", "part", "f.*"), 0.70).localCheckpoint()
    a = keys.where("probe").select("key", "kind", "need", F.col("sig").alias("a"), F.col("size").alias("za"), F.col("rn").alias("ra"))
    b = keys.select("key", F.col("sig").alias("b"), F.col("size").alias("zb"), F.col("rn").alias("rb"))
    met = a.join(b, "key").where((F.col("a") != F.col("b")) & (F.col("za") <= F.col("zb")) & pairs.within_reach(F.col("za"), F.col("ra"), F.col("zb"), F.col("rb"), F.col("need")))
    met = met.select(F.least("a", "b").alias("s1"), F.greatest("a", "b").alias("s2"), "kind").distinct().localCheckpoint()
    kept = met.join(every, ["s1", "s2"]).where(pairs.could_link(F.col("g1"), F.col("g2"), F.col("kind"), 0.70)).select("s1", "s2").distinct()
    want, got = {tuple(r) for r in linked.select("s1", "s2").collect()}, {tuple(r) for r in kept.collect()}
    assert len(want) > 100 and want <= got
    assert len(got) < 0.5 * met.select("s1", "s2").distinct().count()


def test_features_travel_with_few_pairs_and_blocks_are_dealt_by_either_side(spark, monkeypatch):
    """Above the broadcast bound outlines rule pairs out before features are joined; no linked pair is lost, and a hot block's rows
    are repeated for the parts of the other side only, of which there are few."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    names = ["Nation", "Nations", "Acme", "Acmeland", "Acme Corp", "Fed"]
    base = [[word() for _ in range(rnd.randint(3, 14))] for _ in range(20)]
    rows = []
    for i in range(1, 200):
        w = [x if rnd.random() < 0.8 else word() for x in rnd.choice(base)]
        e = " and ".join(rnd.sample(names, rnd.randint(0, 3)))
        rows.append((i, rnd.randint(1, 8), " ".join(w) + rnd.choice(["", "", " 25 bps", " 3%"]) + (" at " + e if e else ""), rnd.randint(0, 120), rnd.choice(["Energy", "World", "Health", None])))
    feats = pairs.features(articles(spark, rows), sources(spark))
    sets = pairs.nodes(feats)[2].localCheckpoint()
    side = lambda p: sets.select(F.col("sig").alias(f"s{p}"), F.col("f").alias(f"f{p}"))
    every = side("a").crossJoin(side("b")).where("sa < sb").localCheckpoint()
    linked = every.where(pairs.compatible(F.col("fa.cat"), F.col("fb.cat")) & pairs.is_edge(pairs.static_score(F.col("fa"), F.col("fb")), F.lit(1.0), 0.70))
    kept = pairs.outlines_link(every.select("sa", "sb"), pairs.outlines(sets), 0.70)
    want, got = {(r["sa"], r["sb"]) for r in linked.collect()}, {tuple(r) for r in kept.collect()}
    assert len(want) > 50 and want <= got and len(got) < 0.2 * every.count()
    monkeypatch.setattr(pairs, "FEATURE_ROWS", 0)
    assert {r["id"]: r["label"] for r in clusters.assign(feats, 0.70).collect()} == _brute_components(feats, 0.70)
    parts = spark.createDataFrame([(1,), (2000,), (2001,), (10**9,)], "n long").select(pairs.sub_blocks(F.col("n")).alias("k"))
    assert [r["k"] for r in parts.collect()] == [1, 1, 2, pairs.MOST_SUBS]


def test_long_titles_with_common_words_are_not_written_out(spark):
    """Long titles share frequent words and their entities share pieces; the bounds inside the join leave the linked pairs and few others."""
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    common, base = [word(3) for _ in range(30)], []
    for _ in range(60):
        base.append((rnd.sample(common, 18) + [word(5) for _ in range(30)], ["Nation" + word(2) for _ in range(rnd.randint(1, 5))]))
    rows = []
    for i in range(1, 181):
        w, names = base[i % 60]
        w = [x if rnd.random() < 0.9 else word(5) for x in w]
        rows.append((i, rnd.randint(1, 8), " ".join(w) + " at " + " and ".join(names), 0, "World"))
    sets = pairs.nodes(pairs.features(articles(spark, rows), sources(spark)))[2].localCheckpoint()
    side = lambda p: sets.join(pairs.glances(sets), "sig").select(F.col("sig").alias(f"s{p}"), F.col("f").alias(f"f{p}"), F.col("g").alias(f"g{p}"))
    every = side(1).crossJoin(side(2)).where("s1 < s2").localCheckpoint()
    linked = every.where(pairs.is_edge(pairs.static_score(F.col("f1"), F.col("f2")), F.lit(1.0), 0.70))
    keys = pairs.candidate_keys(sets.select("sig", "part", "f.*"), 0.70).localCheckpoint()
    met = keys.where("probe").select("key", "kind", F.col("sig").alias("a")).join(keys.select("key", F.col("sig").alias("b")), "key").where("a <> b")
    met = met.select(F.least("a", "b").alias("s1"), F.greatest("a", "b").alias("s2"), "kind").distinct().join(every, ["s1", "s2"])
    kept = pairs.may_link(met, 0.70).select("s1", "s2").distinct()
    want, got = {tuple(r) for r in linked.select("s1", "s2").collect()}, {tuple(r) for r in kept.collect()}
    assert len(want) > 50 and want <= got
    assert len(got) < 1.2 * len(want) < 0.2 * met.select("s1", "s2").distinct().count()  # the glance alone leaves 1,004 of 1,900


def test_partner_counts_slide_no_frame(spark):
    """Counts in a window of two days on either side equal all pairs, at its very ends too, without a frame that slides over rows."""
    rnd = random.Random(5)
    cats = ["", "world", "energy", "sports", "business"]
    day, rows = 86_400_000_000, []
    for i in range(1, 200):
        at = rnd.choice([rnd.randint(0, 12) * day, rnd.randint(0, 12 * day), -day + rnd.randint(0, 3)])
        rows.append((i, at, rnd.choice(cats)))
    feats = spark.createDataFrame(rows, "id long, at_us long, cat string").select("id", "at_us", F.struct("cat").alias("f"))
    broad = {"", *lx.BROAD_CATEGORIES}
    fits = lambda a, b: a[0] != b[0] and abs(a[1] - b[1]) <= 2 * day and (a[2] == b[2] or a[2] in broad or b[2] in broad)
    counts = pairs.partner_counts(feats)
    assert {r["id"]: r["partners"] for r in counts.collect()} == {a[0]: sum(fits(a, b) for b in rows) for a in rows}
    assert "specifiedwindowframe(RangeFrame, -" not in counts._jdf.queryExecution().toString()


def test_same_title_far_apart_stays_apart(spark):
    a = articles(spark, [(1, 1, "Port of Rotterdam closes", 0, "Energy"), (2, 2, "Port of Rotterdam closes", 47, "Energy"), (3, 3, "Port of Rotterdam closes", 96, "Energy")])
    got = {r["id"]: r["label"] for r in clusters.assign_articles(a, sources(spark), None).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_action_conflict_is_not_linked(spark):
    a = articles(spark, [(1, 1, "Bank of England cuts rates", 0, "Energy"), (2, 2, "Bank of England hikes rates", 1, "Energy")])
    r = pairs.score_pairs(spark.createDataFrame([(1, 2)], "a long, b long"), pairs.features(a, sources(spark))).first()
    assert r["s"]["action"] and r["band"] != "HIGH_CONFIDENCE"


def _greedy(rows, limit, per_source, per_section, alike):
    taken, out = [], []
    for r in rows:
        if len(taken) >= limit:
            break
        if r[3] < 0.1:
            out.append((r[0], "UNFIT"))
        elif r[1] is not None and sum(t[1] == r[1] for t in taken) >= per_source:
            out.append((r[0], "SOURCE"))
        elif sum(t[2] == r[2] for t in taken) >= per_section:
            out.append((r[0], "SECTION"))
        elif any(alike(r, t) for t in taken):
            out.append((r[0], "ALIKE"))
        else:
            taken.append(r)
            out.append((r[0], "SELECTED"))
    return out


def _select(df, limit, chunk):
    return selection.capped_selection(
        df, "g", F.struct("pos"), F.struct("pos", "src", "sec", "x"), limit, [selection.Cap("SOURCE", "src", 2), selection.Cap("SECTION", "sec", 4)],
        [("UNFIT", lambda x: x["x"] < 0.1)], ("ALIKE", lambda x, t: F.abs(x["x"] - t["x"]) < 0.02), chunk,
    )


SELECT_SCHEMA = "g int, pos int, src int, sec string, x double"


@pytest.mark.parametrize("limit,sources", [(9, 6), (12, 2), (30, 40)])  # fills early, never fills, sections fill before
def test_capped_selection_equals_sequential_pass(spark, limit, sources):
    rnd = random.Random(limit)
    want, rows = {}, []
    for g in range(4):
        items = [(i, rnd.choice([None, *range(sources)]) if g else rnd.randrange(sources), rnd.choice("ABCD"), round(rnd.random(), 3)) for i in range(150)]
        want[g] = _greedy(items, limit, 2, 4, lambda r, t: abs(r[3] - t[3]) < 0.02)
        rows += [(g, *x) for x in items]
    df = spark.createDataFrame(rows, SELECT_SCHEMA).repartition(7)
    for chunk in (3, 512):
        d = {g: [] for g in range(4)}
        for r in _select(df, limit, chunk).orderBy("g", "ord").collect():
            d[r["g"]].append((r["item"]["pos"], r["outcome"]))
        assert d == want


def test_rounds_of_an_edition_that_never_fills(spark, monkeypatch):
    rounds = []
    fold = selection._fold
    monkeypatch.setattr(selection, "_fold", lambda *a: rounds.append(1) or fold(*a))
    n = 100_000
    sec = F.when(F.col("id") % 7 < 6, F.lit("A")).otherwise(F.lit("B"))
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("pos"), (F.col("id") % 3).cast("int").alias("src"), sec.alias("sec"), (F.col("id") / n + 0.2).alias("x"))
    got = {r["outcome"]: r["n"] for r in _select(df, 20, 64).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(got.values()) == n and got["SELECTED"] == 6 and len(rounds) <= 7


def _sequential(rows, threshold):
    from newsmart.functions.similarity import similar

    kept = []
    for i, t, u, s in sorted(rows, key=lambda r: (-r[3], r[0])):
        if not any(u == ku or similar(t, kt, threshold) for _, kt, ku in kept):
            kept.append((i, t, u))
    return {k[0] for k in kept}


def _scored(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, canonical_url string, x double").select(
        "id", "title", "canonical_url", F.lit("2024-01-10").cast("date").alias("edition_date"), F.struct(F.col("x").alias("score")).alias("s")
    )


def test_duplicate_suppression_equals_sequential_pass(spark):
    rnd = random.Random(8)
    words = "oil gas fed rate cut port ship grain deal talks".split()
    rows = []
    for i in range(160):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 5)))
        t = rnd.choice([t, t, t + "s", t.replace("a", "ä", 1), " ".join(reversed(t.split())), "", "  ", "\u00a0"]) if i % 4 == 0 else t
        rows.append((i, t, f"u{rnd.randint(0, 120)}", rnd.randint(0, 40) / 1.0))
    want = _sequential(rows, 0.7)
    assert 20 < len(want) < 140
    for tile in (9, 1024):  # many tiles, one tile
        assert {r["id"] for r in daily.suppress_duplicates(_scored(spark, rows), 0.7, tile).collect()} == want
    assert daily.suppress_duplicates(_scored(spark, rows[:0])).count() == 0


def test_alignment_bounds_lose_no_pair():
    from newsmart.functions.similarity import similar

    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdefgh  ") for _ in range(rnd.randint(1, 40))) + "x" for _ in range(25)]
    titles = base + ["".join(c if rnd.random() < 0.8 else rnd.choice("abcd") for c in t) for t in base] + [t[: len(t) // 2] + "zz" + t[len(t) // 2 :] for t in base] + [("long words repeat " * 15) + t for t in base[:6]]
    for threshold in (0.7, 0.9):
        got, aligned = suppress.similar_pairs(titles, titles, threshold)
        want = {(i, j) for i, a in enumerate(titles) for j, b in enumerate(titles) if similar(a, b, threshold)}
        assert {tuple(x) for x in got} == want
        assert aligned < len(titles) ** 2 / 4
    assert suppress.common_subsequence(suppress._masks("abcbdab"), 7, "bdcaba") == 4


def test_long_titles_are_ruled_out_by_runs_and_seeds(monkeypatch):
    """Long titles of common letters: hardly any pair needs the common subsequence, and the result is that of the alignment."""
    from difflib import SequenceMatcher

    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("etaoinsr" * 4 + "hldcumfp" + "zqxj") for _ in range(rnd.randint(2, 9)))
    base = [" ".join(word() for _ in range(rnd.randint(30, 90))) for _ in range(60)]
    near = ["".join(c for c in t if rnd.random() > share) for t in base[:16] for share in (0.02, 0.1, 0.2)]
    near += [t[: len(t) // 2] + base[k + 1][len(base[k + 1]) // 2 :] for k, t in enumerate(base[:20])] + ["ete" * 90, "ete" * 70 + "z" * 3, "te" * 120]
    calls, exact = [], suppress.common_subsequence
    monkeypatch.setattr(suppress, "common_subsequence", lambda *x: calls.append(1) or exact(*x))
    titles = base + near
    got, _ = suppress.similar_pairs(titles, titles, 0.70)
    token = lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
    want = {(i, j) for i, x in enumerate(titles) for j, y in enumerate(titles) if token(x, y) >= 0.70 or SequenceMatcher(None, x, y).ratio() >= 0.70}
    assert set(map(tuple, got.tolist())) == want
    assert len(calls) < 3 * len(want)


def test_rounds_of_suppression_do_not_grow_with_rows(spark, monkeypatch):
    counts = []
    for n in (60, 240):
        rnd = random.Random(n)
        rows = [(i, f"ship{rnd.randint(0, n // 6)} enters port{rnd.randint(0, n // 6)} today", f"u{i}", float(rnd.randint(0, 1000))) for i in range(n)]
        rounds = []
        monkeypatch.setattr(suppress, "cut_lineage", lambda df: rounds.append(1) or cut_lineage(df))
        assert {r["id"] for r in daily.suppress_duplicates(_scored(spark, rows), 0.7).collect()} == _sequential(rows, 0.7)
        counts.append(len(rounds))
    assert counts[1] <= counts[0] + 6


def test_global_rank_and_nearest_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), "id")
    got = windows.global_rank(df, ["v", "id"], 5).orderBy("v").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert windows.nearest_rank(df.select(F.col("v").cast("double").alias("v")), "v", 0.9).first()["v"] == 899.0


def test_next_in_group(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(30)], "id long, g string")
    got = {r["id"]: r["next"] for r in neighbours.next_in_group(df, "g", "id", width=4).collect()}
    a, b = [i for i in range(30) if i % 3], [i for i in range(30) if not i % 3]
    assert got == {**dict(zip(a, a[1:] + [None])), **dict(zip(b, b[1:] + [None]))}


def test_partner_counts_equal_brute_force(spark):
    rnd = random.Random(2)
    a = articles(spark, [(i, 1, "t", rnd.randint(0, 200), rnd.choice(["World", "Energy", "Business"])) for i in range(80)])
    f = pairs.features(a, sources(spark)).cache()
    rows = f.select("id", "at_us", "f.cat").collect()
    ok = lambda x, y: x["cat"] == y["cat"] or "world" in (x["cat"], y["cat"])
    want = {x["id"]: sum(y["id"] != x["id"] and abs(x["at_us"] - y["at_us"]) <= pairs.WINDOW_US and ok(x, y) for y in rows) for x in rows}
    assert {r["id"]: r["partners"] for r in pairs.partner_counts(f).collect()} == want


def test_saved_state(spark):
    log = [(1, 1, 1, "save"), (2, 1, 1, "read"), (3, 1, 1, "unread"), (4, 1, 2, "read"), (5, 1, 3, "unread"), (6, 1, 4, "save"), (7, 1, 4, "unsave"), (8, 1, 5, "unsave"), (9, 1, 5, "save")]
    df = spark.createDataFrame([(e, u, a, k, ts(e)) for e, u, a, k in log], "event_id long, user_id long, article_id long, action string, ts timestamp")
    got = {r["article_id"]: r["is_read"] for r in saved.fold_actions(df).collect()}
    assert got == {1: False, 2: True, 5: False}


def test_context_stats_on_empty(spark):
    r = archive.context_stats(articles(spark, []), no_notes(spark), dates.ts(str(T0))).first()
    assert r["coverage_pct"] == 0.0 and r["awaiting"] == 0


def test_grounding(spark):
    cols = "headline string, summary string, why string, watch_event string, watch_source long, ids array<long>, allowed array<long>, evidence string"
    rows = [
        ("Fed lifts rates by 25 bps", "Rates rose 25 bps.", None, None, None, [1], [1, 2], "The Fed raised rates 25 bps"),
        ("Fed lifts rates by 50 bps", "It was forced by prices.", None, "", 9, [3], [1], "The Fed raised rates 25 bps"),
        ("Shocking", "", None, None, None, [], [1], "x"),
    ]
    got = [r["errors"] for r in evidence.validate(spark.createDataFrame(rows, cols)).collect()]
    assert got[0] == []
    assert {"unknown article 3", "unsupported number 50", "unsupported number 50bps", "unsupported cause forced by", "watch event missing", "watch source not in evidence"} == set(got[1])
    assert {"summary missing", "headline length", "sensational shocking"} == set(got[2])


def test_signal_upsert(spark):
    cols = "fingerprint string, signal_type string, subject_key string, event_count long, source_count long, window_end timestamp"
    old = spark.createDataFrame([("a", "T", "k", 2, 1, ts(0)), ("b", "T", "k", 2, 1, ts(100))], cols).withColumn("status", F.lit("ACTIVE"))
    new = spark.createDataFrame([("b", "T", "k", 5, 2, ts(100)), ("c", "T", "k", 3, 1, ts(200))], cols)
    got = {r["fingerprint"]: (r["status"], r["change"], r["event_count"]) for r in signals.upsert(old, new, dates.ts(str(ts(50)))).collect()}
    assert got == {"a": ("ENDED", "EXPIRED", 2), "b": ("ACTIVE", "UPDATED", 5), "c": ("ACTIVE", "CREATED", 3)}
    ev = spark.createDataFrame([("a", "x", None), ("a", "y", "e")], "fingerprint string, cluster_id string, slug string")
    assert signals.new_evidence(ev.limit(1), ev).collect()[0]["cluster_id"] == "y"


def test_snapshot_and_upsert_writers(spark, tmp_path):
    p = str(tmp_path / "ed")
    writers.write_snapshot(spark.createDataFrame([(1, "a"), (2, "b")], "d int, v string"), p, "d")
    writers.write_snapshot(spark.createDataFrame([(2, "c")], "d int, v string"), p, "d")
    assert {(r["d"], r["v"]) for r in spark.read.parquet(p).collect()} == {(1, "a"), (2, "c")}
    old = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "key string, v int")
    new = spark.createDataFrame([("k", 9)], "key string, v int")
    assert sorted(r["v"] for r in writers.replace_keys(old, new, "key").collect()) == [3, 9]
    writers.write_report(new, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["v"] == 9


def test_feed_readers(spark, tmp_path):
    rss = tmp_path / "a.xml"
    rss.write_text(
        "<rss><channel><item><title> One </title><link>http://a/1</link><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;x&lt;/p&gt;</description></item>"
        "<item><title>Two</title><link>urn:x</link><guid>https://b/2</guid><pubDate>Mon, 15 Jan 2024 10:00:00 +0200</pubDate></item>"
        "<item><title> </title><link>http://a/3</link></item><item><title>Four</title><link>mailto:x</link></item></channel></rss>"
    )
    got = {r["title"]: (r["url"], str(r["published_at"])) for r in readers.read_rss(spark, str(rss)).collect()}
    assert got == {"One": ("http://a/1", "2024-01-15 10:00:00"), "Two": ("https://b/2", "2024-01-15 08:00:00")}
    atom = tmp_path / "b.xml"
    atom.write_text('<feed><entry><title>E</title><link href="http://s" rel="self"/><link href="http://e/1"/><id>x</id><updated>2024-01-15T10:00:00Z</updated></entry></feed>')
    r = readers.read_atom(spark, str(atom)).first()
    assert (r["url"], str(r["published_at"])) == ("http://e/1", "2024-01-15 10:00:00")


def test_registry_and_gold_readers(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"name": "A", "feed_url": "u", "active": true}, {"name": "B", "active": false}]')
    assert [r["name"] for r in readers.read_registry(spark, str(tmp_path / "s.json")).orderBy("name").collect()] == ["A", "B"]
    (tmp_path / "g.json").write_text('{"questions": [{"id": 1, "category": "c", "question": "q"}]}')
    assert readers.read_gold(spark, str(tmp_path / "g.json")).first()["question"] == "q"


def test_contract(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    got = {r["column"]: (r["present"], r["type_ok"], r["nulls"]) for r in writers.contract_gaps(df, "t", {"a": "int", "b": "int", "c": "int"}).collect()}
    assert got == {"a": (True, True, 0), "b": (True, False, 1), "c": (False, False, None)}


def test_large_ids_stay_apart_in_parts(spark):
    from newsmart.operators import pairs

    f = spark.createDataFrame([(i, 1, 0, 0, "x", "") for i in (-5, 7, (1 << 44) + 7, (1 << 62) + 7)], "id long, source_id int, at_us long, pub_us long, f string, part string")
    parts = spark.createDataFrame([(r["id"], d) for r in f.collect() for d in (dt.date(2024, 1, 1), dt.date(2024, 1, 2))], "id long, day date")
    got = pairs.by_part(f, parts, "day").select("id.part", "id.id").collect()
    assert sorted((r["part"], r["id"]) for r in got) == sorted((r["day"], r["id"]) for r in parts.collect())


def test_citations_of_articles_that_were_not_retrieved_are_invalid(spark):
    questions = spark.createDataFrame([(q, "Energy", None) for q in (1, 2, 3)], "query_id long, category string, scope string")
    gold = spark.createDataFrame([(1, 10, True)], "query_id long, id long, core boolean")
    records = spark.createDataFrame([(1, 10, "s", ts(0), "Energy"), (2, 20, "s", ts(0), "Energy")], "query_id long, id long, source string, at timestamp, category string")
    packs = spark.createDataFrame([(1, False, [(10,)]), (2, False, [(99,)]), (3, True, None)], "query_id long, insufficient_evidence boolean, citations array<struct<id:long>>")
    found = evaluate.question_metrics(questions, gold, records, packs, F.lit(T0).cast("date"))
    assert {r.query_id: r.citation_valid for r in found.collect()} == {1: True, 2: False, 3: True}


def test_pair_explanation_states_every_part(spark):
    a = articles(spark, [(1, 1, "Kushner in Moscow for Kiev talks", 0, "Energy"), (2, 2, "Kushner arrives in Moscow on Kiev", 12, "Energy")])
    scored = pairs.score_pairs(spark.createDataFrame([("x", 1, 2)], "kind string, a long, b long"), pairs.features(a, sources(spark)))
    r = audits.explained(scored).first()
    assert r["category_match"] == 1.0 and r["temporal_proximity"] == 0.75 and not r["numeric_conflict"] and not r["numeric_match"]
    want = f"Pair [1-2] Similarity: {r['final_score']:.2f} ({r['confidence_band']}) | Title Sim: {r['title_sim']:.2f} | Entity Sim: {r['entity_sim']:.2f} ({r['specific_entity_matches']} matches) | Category Match: 1.0 | Proximity: 0.75 | Numeric Conflict: False"
    assert r["explanation"] == want and r["specific_entity_matches"] >= 2


def test_gold_provenance_and_classes(spark):
    a = spark.createDataFrame([(1, "oil rises", None, "en"), (2, "gaz monte", None, "fr"), (3, "gas falls", None, "en"), (4, "tin", "oil stocks", "en"), (5, "oil again", None, "en"), (6, "oil x", None, "en")], "id long, title string, raw_summary string, language string")
    n = spark.createDataFrame([(1, 1, None, True), (2, 3, "s", False), (3, 4, None, None)], "annotation_id long, article_id long, summary string, is_relevant boolean")
    q = spark.createDataFrame([(1, ["oil"]), (2, [])], "query_id long, tokens array<string>")
    gold = spark.createDataFrame([(1, i) for i in (1, 2, 3, 4, 5, 6, 99)] + [(2, 1)], "query_id long, id long")
    ranked = spark.createDataFrame([(1, 1, 5, 2), (1, 5, 1, 11), (1, 6, 2, 4)], "query_id long, id long, ord int, rank int")
    shown = spark.createDataFrame([(1, 1)], "query_id long, id long")
    got = {(r["query_id"], r["id"]): r for r in audits.gold_provenance(gold, q, a, n, ranked, shown).collect()}
    want = {(1, 1): "SUCCESS_RETRIEVED", (1, 2): "LANGUAGE_LEXICAL_GAP", (1, 3): "FTS_LEXICAL_MISS", (1, 4): "CANDIDATE_LIMIT_MISS", (1, 5): "FINAL_TOP_K_TRUNCATION", (1, 6): "SOURCE_DIVERSITY_EFFECT", (1, 99): "GOLD_LABEL_ISSUE", (2, 1): "CANDIDATE_LIMIT_MISS"}
    assert {k: r["cause"] for k, r in got.items()} == want
    assert not got[1, 1]["manual_review"] and got[1, 2]["manual_review"] and got[1, 3]["manual_review"] and not got[1, 4]["manual_review"]
    counts = {r["cause"]: (r["n"], r["total"], r["reconciled"]) for r in audits.reconciled(audits.gold_provenance(gold, q, a, n, ranked, shown), "cause").collect()}
    assert counts["CANDIDATE_LIMIT_MISS"] == (2, 8, True) and sum(c[0] for c in counts.values()) == 8
    kinds = {r["id"]: r["class"] for r in audits.gold_classes(gold.where("query_id = 1").withColumn("core", F.col("id") != 5), a, n).collect()}
    assert kinds == {1: "VALID_GOLD", 2: "UNANALYZED", 3: "OUT_OF_SCOPE", 4: "OUT_OF_SCOPE", 5: "UNANALYZED", 6: "UNANALYZED", 99: "STALE_ID_OR_DATA_DRIFT"}


def test_coverage_funnel(spark):
    a = articles(spark, [(i, 1, f"t{i}", -24 * i, "World") for i in range(1, 41)])
    n = spark.createDataFrame([(i, "success" if i != 3 else "failed", i != 4) for i in range(1, 31)], "article_id long, status string, is_relevant boolean")
    members = spark.createDataFrame([(i, f"c{i % 5}") for i in range(1, 29) if i not in (5, 20)], "id long, cluster_id string")
    named, linked = spark.createDataFrame([(1,), (2,), (5,)], "article_id long"), spark.createDataFrame([("c1",), ("c1",), ("c2",)], "cluster_id string")
    got = {r["name"]: (r["n"], r["covered"], r["pct"]) for r in audits.coverage_funnel(a, n, members, named, linked, dates.ts(str(T0))).collect()}
    assert got["relevant_annotations"][0] == 29 and got["clustering_eligible"][0] == 28 and got["represented_articles"][0] == 24
    assert got["events"][0] == 5 and got["event_articles_with_mentions"][0] == 2 and got["events_with_entities"][0] == 2
    assert got["7D"] == (5, 4, 80.0) and got["14D"] == (12, 11, 91.67) and got["All-Time"] == (28, 24, 85.71) and got["NEEDS REVISION"][0] == 1
    full = spark.createDataFrame([(i, "c") for i in range(1, 41)], "id long, cluster_id string")
    assert "PASS" in {r["name"] for r in audits.coverage_funnel(a, n, full, named, linked, dates.ts(str(T0))).collect()}


def test_newest_slices_give_the_pool_of_the_whole_scope(spark, monkeypatch):
    """Common words are done in the newest articles, rare ones and short scopes read on; matches outside the slices are not made."""
    from newsmart.operators import search

    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, ts(-(i * 2 % 997)), " ".join(rnd.choice(["oil", "gold", "rates", "fed"]) for _ in range(3)) + (" rare" if i % 50 == 0 else ""), "") for i in range(600)],
                                 "id long, at timestamp, core string, extra string")
    asks = [(1, ["oil"], None, None), (2, ["rare"], None, None), (3, ["rare", "gold"], None, ts(-200)), (4, ["fed"], ts(-60), ts(-30)), (5, [], None, None), (6, ["absent"], None, None), (7, ["rates"], ts(-900), ts(-100))]
    q = spark.createDataFrame(asks, "query_id long, tokens array<string>, from_at timestamp, to_at timestamp")
    run = lambda: {tuple(r) for r in search.candidate_pool(q, docs, 5, False).select("query_id", "id", "ord").collect()}
    monkeypatch.setattr(search, "SLICES", ())
    want = run()
    made, real = [], search.matches
    monkeypatch.setattr(search, "matches", lambda d, w: (made.append((d.count(), {r["token"] for r in w.select("token").distinct().collect()})), real(d, w))[1])
    for slices in ((2, 8), (8,)):
        monkeypatch.setattr(search, "SLICES", slices)
        got = run()
        assert got == want and len(want) >= 22, (len(got), len(want), sorted(got ^ want)[:8])
    assert made[0][0] < 600 and all("oil" not in words for rows, words in made if rows == 600)


def test_blocks_are_paired_in_lots_and_shuffle_files_go_with_their_action(spark, monkeypatch):
    """Lots lose no link, and no shuffle file outlives the action that wrote it, however many lots there are."""
    rnd = random.Random(13)
    heads = ["Acme Corp cuts rates 25 bps", "Fed holds rates steady", "Federal Reserve holds steady", "Oil rises 3% in London", "Acmeland unveils phone", "Kushner Moscow Kiev talks", "Talks Kushner in Moscow Kiev"]
    rows = [(i, rnd.randint(1, 8), rnd.choice(heads) + rnd.choice(["", " today", " again now", " says minister"]), rnd.randint(0, 200), rnd.choice(["Energy", "World", None])) for i in range(1, 120)]
    feats = cut_lineage(pairs.features(articles(spark, rows), sources(spark)))
    want = _brute_components(feats, 0.70)
    passes, one = [], pairs._second_pass
    monkeypatch.setattr(pairs, "_second_pass", lambda *a: passes.append(1) or one(*a))
    monkeypatch.setattr(pairs, "LOT_ROWS", 100)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    written = lambda: {f for f in disk.getAllBlocks().mkString(",").split(",") if f.startswith("shuffle_")}
    before = written()
    labels = cut_lineage(clusters.assign(feats, 0.70))
    assert written() <= before
    assert len(passes) > 2 and {r["id"]: r["label"] for r in labels.collect()} == want


def test_dense_graph_is_settled_before_the_stars(spark, monkeypatch):
    """Chains of dense neighbourhoods fall into their roots at once; nothing is left for rounds over all edges."""
    rnd = random.Random(4)
    pairs_ = [(u + k, u + k + rnd.randint(1, 9)) for k in (0, 10_000) for u in range(400) for _ in range(8)]
    edges, left, stars = spark.createDataFrame(pairs_, "u long, v long"), [], graph._stars
    monkeypatch.setattr(graph, "_stars", lambda e, n: left.append(e.count()) or stars(e, n))
    root = {x: x for p in pairs_ for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in pairs_:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r["id"]: r["label"] for r in graph.connected_components(edges).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert left == [0]


def test_checkpoints_in_a_loop_of_joins_carry_no_estimates(spark):
    """The size Spark expects of a checkpoint does not gain digits with every join that led to it."""
    low = cut_lineage(spark.range(64).select(F.col("id").alias("u"), F.floor(F.col("id") / 2).alias("m")))
    for _ in range(6):
        low = cut_lineage(low.join(low.select(F.col("u").alias("m"), F.col("m").alias("next")), "m").select("u", F.col("next").alias("m")))
    plan = low._jdf.queryExecution().logical()
    assert plan.stats().sizeInBytes() < 2**63 and plan.constraints().isEmpty()
    assert {r["u"]: r["m"] for r in low.collect()} == {i: 0 for i in range(64)}


def test_feature_sets_of_a_large_archive_do_not_pass_through_the_driver(spark, monkeypatch):
    """Twelve thousand feature sets are joined by shuffle, not broadcast."""
    sides, hint = [], F.broadcast
    monkeypatch.setattr(pairs.F, "broadcast", lambda df: sides.append(df.columns) or hint(df))
    sets = spark.range(12_000).select(
        F.col("id").alias("sig"), F.lit("").alias("part"),
        F.struct(
            F.array(F.concat(F.lit("w"), "id")).alias("tokens"), F.array().cast("array<string>").alias("entities"), F.array().cast("array<string>").alias("numbers"),
            *[F.lit(False).alias(c) for c in ("hold", "cut", "hike", "earnings", "launch")], F.lit("").alias("cat"),
        ).alias("f"),
    )
    pair = spark.createDataFrame([(1, 2, 0, 0)], "sa long, sb long, ka long, kb long")
    n = spark.range(12_000).select(F.col("id").alias("sig"), F.lit(0).cast("long").alias("slot"), F.col("id").alias("node"), *[F.lit(0).cast("long").alias(c) for c in ("lo", "hi", "u_lo", "u_hi")])
    rows = spark.range(12_000).select("id", F.lit(0).cast("long").alias("at_us"), F.lit(0).cast("long").alias("pub_us"), F.col("id").alias("sig"), F.lit(0).cast("long").alias("slot"))
    edges, apart = pairs._verified(pair, rows, n, sets, pairs.outlines(sets), 0.70)
    assert edges.count() == 0 and apart.count() == 1
    assert sides == []
