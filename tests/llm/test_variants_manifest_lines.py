"""Spelling variants, Merkle manifest and line dedup against brute-force twins."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsmart.llm import linededup, merkle, spelling
from newsmart.llm.base import in_bucket

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, word string, rank long"
LOW = str.maketrans({k: k + 32 for k in range(65, 91)})


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 7) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    pool = ["".join(rng.choice(["ra", "to", "mi", "sel", "ké", "um", "Ün"]) for _ in range(rng.randint(3, 5))) for _ in range(25)]

    def mangled(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeixÉ") + w[i + 1 :], w[:i] + rng.choice("aeix") + w[i:], w.upper(), w[::-1]])

    out = []
    for i in range(90):
        ws = [rng.choice(pool[: 3 + i % 20]) if rng.random() < 0.8 else mangled(rng.choice(pool)) for _ in range(rng.randint(5, 60))]
        text = rng.choice([" ", "-", "\n", "1"]).join(ws) + rng.choice(["", "\nCommon LINE", "\n  common line\t\r\n\n", "\nrare line %d" % (i % 30)])
        out.append((i, text, rng.choice(["en", None]), rng.choice(["a", "a", "b", "", None]), len(text)))
    out += [(200, None, None, "lone", None), (201, "", "en", "a", 0), (202, "common line", "x", "a", 5), (203, "Straße " * 3000 + "\n" * 500, "de", "b", 1), (None, "common line\nNULL id", None, None, None)]
    return out + [out[0]] * 20 + [(5, "another text\nCOMMON line", "en", "a", 3), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms(rows, ratio, least, often, every):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= often}
    by = {w: [o for o in n if near(w, o)] for w in n}
    best = {w: min(by[w], key=lambda o: (-n[o], o), default=None) for w in n}
    form = {w: b if b and n[b] >= ratio * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(by[w]), n[form[w]] if form[w] else None) for w in n)


@pytest.mark.parametrize("ratio,least,often,every", [(10, 7, 2, 31), (2, 6, 1, 3)])
def test_variants(docs, rows, empty, ratio, least, often, every):
    want = forms(rows, ratio, least, often, every)
    got = spelling.variants(docs, ratio, least, often, every)
    assert sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect())) == want
    assert sum(w[1] is not None for w in want) > 3 and max(w[4] for w in want) > 3
    assert spelling.variants(empty).count() == 0


def test_signatures_meet_for_every_edit(spark):
    rng = random.Random(8)
    words = set()
    for _ in range(40):
        w = "".join(rng.choice("abcdeéß") for _ in range(rng.randint(6, 12)))
        i, c = rng.randrange(len(w)), rng.choice("abcdeéß")
        words |= {w, w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]}
    words = sorted(w for w in words if len(w) >= 6)
    got = spelling.near(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    assert len(got) == len({frozenset((r["word"], r["other"])) for r in got})
    assert {frozenset((r["word"], r["other"])) for r in got} == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_roots(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(18)] + [("x", "w3"), ("y", "z")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w18" for i in range(18)}, "x": "w18", "y": "z"}


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, low=False):
    i, text, lang, source, n = row[:5]
    text = text.translate(LOW) if low and text is not None else text
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([h("".join(x[i : i + 16])) for i in range(0, len(x), 16)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        yield "".join(run[: i % 16]), "".join(run[i % 16 + 1 :])
        i //= 16


def audited(rows):
    per = {}
    for r in rows:
        per.setdefault(r[3], []).append(r)
    order = sorted(per, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        per[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in per[s]]) for s in order]
    top = tree([t[-1][0] for t in trees])
    for k, s in enumerate(order):
        for j, r in enumerate(per[s]):
            steps = [*path(trees[k], j), *path(top, k)]
            cur = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for a, b in steps:
                cur = h(a + cur + b)
            yield r[0], leaf(r), trees[k][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), cur, cur == top[-1][0]


def test_manifest(spark, docs, rows, empty):
    got = merkle.audit(docs, in_bucket("doc_id", 5, 0)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(audited(rows), key=str)
    assert {r["verified"] for r in got} == {True, False}
    assert all(r["verified"] for r in merkle.audit(docs).collect())
    assert merkle.audit(empty).count() == 0
    lone = merkle.audit(frame(spark, rows[:1])).first()
    assert lone["leaf"] == lone["subroot"] == lone["root"] and lone["proof_sha256"] == h("")


def test_manifest_of_taller_trees_and_more_sources(spark):
    rows = [(i, f"T{i}", None, f"s{i % 300}" if i % 3 else "big", i) for i in range(900)]
    assert sorted(map(tuple, merkle.audit(frame(spark, rows), in_bucket("doc_id", 5, 0)).collect()), key=str) == sorted(audited(rows), key=str)


def test_proofs_of_some_rows(spark, docs, rows):
    m = merkle.manifest(docs)
    some = m.sources.leaves.where("doc_id % 7 = 1")
    got = merkle.prove(m, some).withColumn("folded", merkle.fold(F.col("digest"), F.col("path")))
    assert got.count() == some.count() and got.where("folded <> root").count() == 0
    want = {(r[0], r[1]): r[4] for r in audited(rows)}
    assert all(want[r["doc_id"], r["digest"]] == r["p"] for r in got.select("doc_id", "digest", merkle.proof_digest(F.col("path")).alias("p")).collect())


def dedup(rows, least=10, shortest=1, counted=None):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    n = Counter(k for r in (counted if counted is not None else rows) for k in {key(x) for x in (r[1] or "").split("\n")} if len(k) >= shortest)
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= shortest and n[key(x)] >= least)]
        yield r[0], "\n".join(kept), len(lines), len(lines) - len(kept)


@pytest.mark.parametrize("least,shortest", [(10, 1), (3, 0), (2, 12)])
def test_line_dedup(docs, rows, empty, least, shortest):
    want = sorted(dedup(rows, least, shortest), key=str)
    index = linededup.index(docs, least, shortest)
    for limit in (linededup.FILTER_BYTES, 0):  # by filters, and by a join with the exact counts
        assert sorted(map(tuple, linededup.clean(docs, index, limit).collect()), key=str) == want
    assert linededup.clean(empty, linededup.index(empty)).count() == 0 and linededup.clean(empty, index).count() == 0


def test_line_index_takes_documents_in_and_out(spark, rows, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 16)  # many shards; they outgrow their size on the way
    first, later = frame(spark, rows[:60]), frame(spark, rows[60:])
    state = lambda x: sorted(map(tuple, x.counts.select("hi", "lo", "docs").collect()))
    index = linededup.index(first, 3)
    both = linededup.update(index, inserted=later)
    assert state(both) == state(linededup.index(frame(spark, rows), 3))
    assert sorted(map(tuple, linededup.clean(frame(spark, rows), both).collect()), key=str) == sorted(dedup(rows, 3), key=str)
    back = linededup.update(both, deleted=later)
    assert state(back) == state(index)
    assert sorted(map(tuple, linededup.clean(first, back).collect()), key=str) == sorted(dedup(rows[:60], 3), key=str)
    moved = linededup.update(index, inserted=later, deleted=frame(spark, rows[:10]))
    assert sorted(map(tuple, linededup.clean(later, moved).collect()), key=str) == sorted(dedup(rows[60:], 3, counted=rows[10:]), key=str)
    with pytest.raises(ValueError):
        linededup.update(index, deleted=frame(spark, [(1, "never seen", None, None, 0)]))


def test_cuckoo_filter():
    rng = np.random.default_rng(4)
    keys = rng.integers(-(2**62), 2**62, (500, 2))
    hi, lo = keys[:, 0].copy(), keys[:, 1].copy()
    table = linededup._built(hi[:300], lo[:300])
    holds = lambda t: linededup._holds(t, 0, linededup._mask(len(t)), hi, lo)
    assert holds(table)[:300].all() and holds(table)[300:].sum() == 0
    gone, new = np.arange(500) < 100, np.arange(500) >= 350
    kept = ((np.arange(500) < 300) | new) & ~gone
    after = linededup._changed(table, hi, lo, gone, new, kept)
    assert holds(after)[kept].all() and not holds(after)[~kept].any() and (after > 0).sum() == kept.sum()
    with pytest.raises(ValueError):
        linededup._delete(after, 0xFFFFFFFF, 0, 0)
    full = linededup._built(hi[:4], lo[:4])  # it cannot take a hundred more: it is built anew
    more = np.arange(500) < 104
    grown = linededup._changed(full, hi, lo, np.zeros(500, bool), more & (np.arange(500) >= 4), more)
    assert len(grown) > len(full) and linededup._holds(grown, 0, linededup._mask(len(grown)), hi, lo)[more].all()
