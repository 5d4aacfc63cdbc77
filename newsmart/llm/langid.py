"""Language identification by prediction by partial matching.

Each language has a byte context tree of contexts of 0 to 3 bytes. A byte costs -log2 of its share in the longest known
context; a byte that is new there first pays that context's escape (distinct symbols over symbols plus distinct symbols)
and is coded one context shorter, down to 8 bits. Statistics are frozen after training, so the code length of a text is
a sum over its bytes, and the cost of every (context, byte) is worked out once. The text goes to the language with the
shortest code, ties to the first name.

Training reads at most ``sample_docs`` texts per language, of at most ``sample_bytes`` bytes each, chosen by a hash of
the id: this bounds the model, which is broadcast.

Defined results: null text or text without any letter gives ``und`` and score 0; with no labelled rows at all every text
is ``und``; null ids are never held out and never learnt from; repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmart.llm.base import chunks, text_bytes

ORDER = 3


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # byte -> symbol; 0 is the start of a text, the last symbol stands for bytes never seen in training
    n: int  # symbols
    row: np.ndarray  # code of three symbols of context -> row of cost
    cost: np.ndarray  # (row, symbol, language) -> bits


def _counts(x: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of k-symbol context plus symbol, and how often each occurs; ``x`` starts with ORDER pads per text."""
    code = np.zeros(len(x) - ORDER, np.int64)
    for j in range(ORDER - k, ORDER + 1):
        code = code * n + x[j : len(x) - ORDER + j]
    return code


def train(texts: dict[str, list[bytes]], least: int = 2) -> Model:
    """texts by language -> model. Contexts of two and three bytes seen fewer than ``least`` times are pruned."""
    langs = sorted(texts)
    seen = np.unique(np.frombuffer(b"".join(b for t in texts.values() for b in t), np.uint8))
    n = len(seen) + 2
    code = np.full(256, n - 1)
    code[seen] = np.arange(1, len(seen) + 1)
    streams = {}
    for lang in langs:
        x = [np.concatenate([np.zeros(ORDER, np.int64), code[np.frombuffer(b, np.uint8)]]) for b in texts[lang]]
        streams[lang] = np.concatenate(x or [np.zeros(ORDER, np.int64)]), np.concatenate([np.arange(len(v)) >= ORDER for v in x] or [np.zeros(ORDER, bool)])[ORDER:]
    grams = {}  # (language, order) -> (code of context and symbol, count), contexts below ``least`` pruned
    contexts: list[np.ndarray] = []
    for k in range(ORDER + 1):
        known = []
        for lang in langs:
            x, real = streams[lang]
            g, c = np.unique(_counts(x, n, k)[real], return_counts=True)
            if k >= 2:
                own, where = np.unique(g // n, return_inverse=True)
                keep = np.bincount(where, c, len(own))[where] >= least
                g, c = g[keep], c[keep]
            grams[lang, k] = g, c
            known.append(g // n)
        contexts.append(np.unique(np.concatenate(known)) if k else np.zeros(1, np.int64))
    start = np.cumsum([0, *map(len, contexts)])
    cost = np.full((start[-1], n, len(langs)), 8.0, np.float32)
    at = lambda k, ctx: start[k] + np.searchsorted(contexts[k], ctx)
    for k in range(ORDER + 1):
        ctx = contexts[k]
        if k:  # what one byte less of context costs: the longest suffix that is known
            suffix = ctx % n ** (k - 1)
            j = k - 1
            rows = np.full(len(ctx), -1, np.int64)
            while j >= 0:
                open_ = rows < 0
                part = suffix % n**j
                hit = np.isin(part, contexts[j]) & open_
                rows[hit] = at(j, part[hit])
                j -= 1
            cost[start[k] : start[k + 1]] = cost[rows]
        for i, lang in enumerate(langs):
            g, c = grams[lang, k]
            if not len(g):
                continue
            own, where = np.unique(g // n, return_inverse=True)
            total, distinct = np.bincount(where, c), np.bincount(where)
            row = at(k, own)
            cost[row, :, i] += -np.log2(distinct / (total + distinct))[:, None]
            cost[row[where], g % n, i] = -np.log2(c / (total + distinct)[where])
    longest = np.full(n**ORDER, start[0], np.int32)
    every = np.arange(n**ORDER, dtype=np.int64)
    for k in range(1, ORDER + 1):
        table = np.full(n**k, -1, np.int32)
        table[contexts[k]] = start[k] + np.arange(len(contexts[k]))
        got = table[every % n**k]
        longest = np.where(got >= 0, got, longest)
    return Model(langs, code, n, longest, cost)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray, span: int = 1 << 18) -> np.ndarray:
    """Bits of every text under every language."""
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), len(model.langs)))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(data)) + ORDER * (doc + 1)
    x = np.zeros(len(data) + ORDER * len(lengths), np.int64)
    x[place] = model.code[data]
    for i in range(0, len(data), span):  # a very long text is summed piece by piece
        p = place[i : i + span]
        ctx = (x[p - 3] * model.n + x[p - 2]) * model.n + x[p - 1]
        bits = model.cost[model.row[ctx], x[p]]
        d = doc[i : i + span]
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        out[d[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.float64)
    return out


def sample(docs: DataFrame, learn, sample_docs: int, sample_bytes: int) -> dict[str, list[bytes]]:
    """At most ``sample_docs`` texts per language; the size of the answer is bounded whatever the table's."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= sample_bytes)).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.2 * sample_docs / n))])
    picked = rows.withColumn("draw", draw).where(F.col("draw") < rate[F.col("lang")])
    out: dict[str, list[bytes]] = {lang: [] for lang in counts}
    for r in picked.orderBy("draw", "doc_id", "lang").limit(2 * sample_docs * len(counts)).collect():
        if len(out[r["lang"]]) < sample_docs:
            out[r["lang"]].append(r["text"].encode())
    return {lang: texts for lang, texts in out.items() if texts}


HELD = 5  # of the sampled texts one in so many is held out to measure code lengths; fewer held-out texts set no bound
SLACK = 16  # bytes that a short text may be longer


def most_bits(texts: dict[str, list[bytes]]) -> np.ndarray:
    """Bits a byte beyond which a text is not in a language: twice the 99 % quantile of texts that were held out."""
    held = {lang: t[:: HELD] for lang, t in texts.items()}
    rest = {lang: [x for i, x in enumerate(t) if i % HELD] for lang, t in texts.items()}
    bounds = np.full(len(texts), np.inf)
    if not texts or not all(rest.values()):
        return bounds
    model = train(rest)
    for lang, t in held.items():
        t = [x for x in t if x]
        if len(t) >= HELD:
            offsets = np.cumsum([0, *map(len, t)])
            bits = code_lengths(model, np.frombuffer(b"".join(t), np.uint8), offsets)[:, model.langs.index(lang)]
            bounds[model.langs.index(lang)] = 2 * np.quantile(bits / np.diff(offsets), 0.99)
    return bounds


def _scorer(docs: DataFrame, learn, sample_docs: int, sample_bytes: int, bounded: bool = False):
    """Function of an Arrow batch with text and letters to (language, score, whether the language explains it, if ``bounded``) of its rows."""
    texts = sample(docs, learn, sample_docs, sample_bytes)
    model = docs.sparkSession.sparkContext.broadcast(vars(train(texts)) if texts else None)  # bounded by the sample
    most = most_bits(texts) if bounded else np.full(len(texts), np.inf)

    def of(batch):
        m = Model(**model.value) if model.value else None
        data, offsets = text_bytes(batch.column("text"))
        letters = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
        lang, sure, plain = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
        for i, j in chunks(offsets) if m else []:
            off = offsets[i : j + 1] - offsets[i]
            bits = code_lengths(m, data[offsets[i] : offsets[j]], off)
            excess = (bits - bits.min(1, keepdims=True)) / np.sqrt(np.diff(off) + 1.0)[:, None]
            lang[i:j] = np.array(m.langs, object)[bits.argmin(1)]
            sure[i:j] = 1 / np.exp2(-excess).sum(1)
            plain[i:j] = bits.min(1) <= most[bits.argmin(1)] * (np.diff(off) + SLACK)
        lang[~letters], sure[~letters] = "und", 0.0
        return lang, sure, plain

    return of


def _letters():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has letters")


def identify(docs: DataFrame, learn, sample_docs: int = 150, sample_bytes: int = 20_000) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, lang_pred, score. ``learn``: condition on rows whose lang may be learnt."""
    scored = _scorer(docs, learn, sample_docs, sample_bytes)

    def work(batches):
        for batch in batches:
            lang, sure, _ = scored(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(sure)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _letters()).mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")


def in_known_language(docs: DataFrame, learn, least: float = 0.5, sample_docs: int = 150, sample_bytes: int = 20_000) -> DataFrame:
    """The documents in one of the learnt languages, with all their columns: the score is at least ``least``, and the code
    length a byte is one that texts of the language have, so other languages, program code and junk go."""
    scored = _scorer(docs, learn, sample_docs, sample_bytes, bounded=True)

    def work(batches):
        for batch in batches:
            lang, sure, plain = scored(batch)
            yield batch.drop_columns([batch.schema.names[-1]]).filter(pa.array((lang != "und") & (sure >= least) & plain))

    return docs.select("*", _letters()).mapInArrow(work, docs.schema)
