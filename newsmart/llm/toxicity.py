"""Toxicity by a subsequence string kernel and a support vector machine with Nystroem landmarks.

The kernel of two strings counts common subsequences of three characters, gaps allowed within six characters, each
weighted by a power of its extent, and is divided by the strings' lengths in the same measure: an insult with a letter
inserted or left out keeps most of its subsequences. A document's units are its white-space tokens, with runs of single
characters joined, so that spaced-out words are units too.

Training reads a bounded sample of labelled documents, cut into sentences. A toxic document has at least one toxic
sentence, which the label does not name: the sentence's witness is the unit that scores highest, first by how much more
often toxic documents hold it, then by the machine trained so far. Landmarks are drawn from witnesses and from other
units; the kernel against them, whitened, feeds a linear squared-hinge machine. The decision is linear in the kernel, so
all landmarks fold into one weight per three-character subsequence, and a text is scored in one pass over its characters.
The highest unit decides; a logistic curve fitted on the training documents turns it into a score from 0 to 1.

Defined results: null and empty texts have no units and the score of the lowest decision; a one-sided or empty training
set gives 0 for every text; null ids are not held out and never learnt from; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmart.llm.base import IS_SPACE, LOWER, chunks, text_bytes

REACH = 6  # characters that a subsequence may extend over
DECAY = 0.7
#: a-z are 1 to 26; other bytes share five codes, space is none.
SYMBOL = np.full(256, 27, np.int64)
SYMBOL[128:] = 28 + np.arange(128) % 4
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[48:58] = 27
STEPS = [(a, b) for b in range(2, REACH) for a in range(1, b)]
FEATURES = 32**3
#: A lone character between spaces is joined with a lone neighbour.
LONE = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D])[\x20](?=[^\x20\x09-\x0D](?:[\x20\x09-\x0D]|$))"
FLOOR = -4.0


def unit_norms(n: np.ndarray) -> np.ndarray:
    """Length of a unit of n characters: the root of the sum of its squared subsequence weights."""
    total = np.zeros(n.shape)
    for _, b in STEPS:
        total += np.maximum(n - b, 0) * DECAY ** (2 * (b + 1))
    return np.sqrt(np.maximum(total, DECAY**6))


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space."""
    word = ~IS_SPACE[data]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def subsequences(data: np.ndarray, limit: np.ndarray):
    """(weight, first positions, feature) of every step pattern. limit[i]: end of the unit that i is in, or i."""
    s = SYMBOL[LOWER[data]]
    for a, b in STEPS:
        if len(s) > b:
            ok = np.flatnonzero(limit[: len(s) - b] > np.arange(b, len(s)))
            yield DECAY ** (b + 1), ok, (s[ok] << 10) | (s[ok + a] << 5) | s[ok + b]


def _limits(data, starts, ends):
    out = np.zeros(len(data), np.int64)
    out[np.flatnonzero(~IS_SPACE[data])] = np.repeat(ends, ends - starts)
    return out


@dataclass
class Model:
    weight: np.ndarray  # per three-character subsequence
    bias: float
    slope: float
    offset: float


def decisions(model: Model, data: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Highest decision of each document's units."""
    best = np.full(n_docs, FLOOR)
    starts, ends = units(data)
    if not len(starts):
        return best
    at = np.zeros(len(data))
    for w, ok, f in subsequences(data, _limits(data, starts, ends)):
        at[ok] += w * model.weight[f]
    value = np.add.reduceat(at, starts) / unit_norms((ends - starts).astype(float)) + model.bias  # spaces add nothing
    owner = doc[starts]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    best[owner[first]] = np.maximum(np.maximum.reduceat(value, first), FLOOR)
    return best


def features(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse normalised kernel features of single units."""
    out = []
    for w in words:
        d = np.frombuffer(w, np.uint8)
        limit = np.full(len(d), len(d))
        got = [(f, np.full(len(f), k)) for k, _, f in subsequences(d, limit)]
        f = np.concatenate([g[0] for g in got] or [np.zeros(0, np.int64)])
        v = np.concatenate([g[1] for g in got] or [np.zeros(0)])
        out.append((f, v / unit_norms(np.array([float(len(d))]))[0]))
    return out


def _kernel(rows, landmarks: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), landmarks.shape[1]))
    for i, (f, v) in enumerate(rows):
        if len(f):
            out[i] = v @ landmarks[f]
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 20) -> np.ndarray:
    """Primal squared-hinge machine by Newton steps; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        live = y * (x @ w) < 1
        if not live.any():
            break
        c = cost[live, None] * x[live]
        new = np.linalg.solve(ridge + x[live].T @ c, c.T @ y[live])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _fit_curve(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through (decision, label), with smoothed labels."""
    up, down = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    x = np.stack([d, np.ones(len(d))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        a, b = np.array([a, b]) + np.linalg.solve(h, x.T @ (t - p))
        a, b = float(np.clip(a, 0.05, 50)), float(np.clip(b, -200, 200))
    return a, b


def train(texts: list[bytes], labels: list[int], landmarks: int = 160, rounds: int = 3, seed: int = 5) -> Model | None:
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return None
    # sentences of each document, as units
    docs = [[[w for w in s.lower().split() if len(w) > 2] for s in re.split(rb"(?<=[.!?])\s+|\n", t)] for t in texts]
    held = Counter(), Counter()
    for sentences, label in zip(docs, y):
        held[label].update({w for s in sentences for w in s})
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    odds = {w: np.log((held[1][w] + 0.1) / (n[1] + 0.2)) - np.log((held[0][w] + 0.1) / (n[0] + 0.2)) for w in held[1]}
    rng = np.random.default_rng(seed)
    clean = sorted(held[0])
    clean = [clean[i] for i in rng.permutation(len(clean))[:6000]]
    value = {w: odds[w] * (1 if held[1][w] > 1 else 0.5) for w in odds}
    model, names = None, sorted(odds)
    rows = features(names)
    for _ in range(rounds):
        found = Counter()
        for sentences, label in zip(docs, y):
            if label:
                best = max(((value[w], w) for s in sentences for w in s), default=None)
                if best and (model is None or best[0] > 0):
                    found[best[1]] += 1
        witness = sorted(found)
        if not witness:
            return model
        others = [w for w in clean if w not in found]
        top = [w for w, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[: landmarks // 2]]
        marks = top + others[: landmarks - len(top)]
        z = np.zeros((FEATURES, len(marks)))
        for j, (f, v) in enumerate(features(marks)):
            np.add.at(z[:, j], f, v)
        values, vectors = np.linalg.eigh(z.T @ z)
        keep = values > 1e-6 * values.max()
        white = vectors[:, keep] / np.sqrt(values[keep])
        own = witness + others
        x = _kernel(features(own), z) @ white
        label = np.array([1.0] * len(witness) + [-1.0] * len(others))
        cost = np.array([10.0 * found[w] / sum(found.values()) * len(own) / 2 for w in witness] + [10.0 / max(1, len(others)) * len(own) / 2] * len(others))
        w = svm(np.hstack([x, np.ones((len(x), 1))]), label, cost / 10)
        weight = z @ (white @ w[:-1])
        model = Model(weight, float(w[-1]), 1.0, 0.0)
        scores = np.array([v @ weight[f] if len(f) else 0.0 for f, v in rows]) + model.bias
        value = dict(zip(names, scores))
    data = [np.frombuffer(t, np.uint8) for t in texts]
    d = np.array([decisions(model, b, np.zeros(len(b), np.int64), 1)[0] for b in data])
    model.slope, model.offset = _fit_curve(d, y)
    return model


def sample(docs: DataFrame, labels: DataFrame, learn, per_label: int, sample_bytes: int) -> tuple[list[bytes], list[int]]:
    """At most ``per_label`` texts of each label; the size of the answer is bounded whatever the tables'."""
    marks = labels.where(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("toxic") == 1, min(1.0, 1.1 * per_label / max(1, counts.get(1, 0)))).otherwise(min(1.0, 1.1 * per_label / max(1, counts.get(0, 0))))
    few = F.broadcast(marks.withColumn("draw", draw).where(F.col("draw") < rate).orderBy("draw", "doc_id").limit(3 * per_label))  # bounded by the limit
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= sample_bytes).join(few, "doc_id").orderBy("draw", "doc_id", "text").limit(3 * per_label).collect()
    texts, out = [], []
    for r in rows:
        if out.count(r["toxic"]) < per_label:
            texts.append(r["text"].encode())
            out.append(r["toxic"])
    return texts, out


def toxicity(docs: DataFrame, labels: DataFrame, learn, per_label: int = 1500, sample_bytes: int = 6_000) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> doc_id, score. ``learn``: condition on rows that may be learnt."""
    spark = docs.sparkSession
    fitted = train(*sample(docs, labels, learn, per_label, sample_bytes))
    model = spark.sparkContext.broadcast(vars(fitted) if fitted else None)  # one weight per subsequence

    def score(batches):
        m = Model(**model.value) if model.value else None
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            out = np.zeros(batch.num_rows)
            for i, j in chunks(offsets, 1 << 19) if m else []:
                n = np.diff(offsets[i : j + 1])
                # a space between documents keeps their units apart
                place = np.arange(n.sum()) + np.repeat(np.arange(j - i), n)
                text = np.full(n.sum() + (j - i), 32, np.uint8)
                text[place] = data[offsets[i] : offsets[j]]
                d = decisions(m, text, np.repeat(np.arange(j - i), n + 1), j - i)
                out[i:j] = 1 / (1 + np.exp(-np.clip(m.slope * d + m.offset, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.regexp_replace("text", LONE, "$1").alias("text")).mapInArrow(score, f"doc_id {kind}, score double")
