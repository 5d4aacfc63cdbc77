"""Line dedup: lines that many documents hold are dropped from all of them, by an index that takes documents in and out.

The index has one shard per 2^16 line keys. A shard holds the exact reference counts (key, documents that hold it) and a
cuckoo filter of its frequent keys, those held by at least ``least`` documents. Documents that come in or go add to or
subtract from the counts; a key that crosses the threshold is put into the shard's filter or taken out of it, which cuckoo
filters allow, so an index that documents left is the index that never saw them. With every filter go its exceptions: the
counted keys that it takes for frequent though they are not. Filter and exceptions together are exact on all counted keys.

Scale: keys are 128-bit digests; each batch of documents counts its own before the shuffle, so a line that a third of the
documents hold is one row per batch. Shards are bounded groups; their number follows the count of keys. Cleaning is one map
over the documents against all filters, if these are within ``FILTER_BYTES`` (measured before they are broadcast);
beyond that the documents' keys join the exact counts, whose large keys adaptive execution splits. Both give the same rows.

Defined results: a null or empty text is one empty line; keys shorter than ``shortest`` code points (so empty ones) are never
dropped; a key counts once per row that holds it, so repeated rows and rows with a null id are documents like any other;
an empty table gives no rows; other columns are ignored. Taking out documents that are not in the index is an error.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmart.llm.base import discard, mixed, stored

SHARD_KEYS = 1 << 16
FILTER_BYTES = 64 << 20
SLOTS, KICKS = 4, 500
STRIP = b" \t\n\x0b\x0c\r"


def _line_key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()  # of bytes: A-Z only


def _digests(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit words of every key."""
    joined = b"".join(hashlib.blake2b(k, digest_size=16).digest() for k in keys)
    return np.frombuffer(joined, np.int64).reshape(-1, 2)


def _code_points(key: bytes) -> int:
    return sum(b & 0xC0 != 0x80 for b in key)


def _long_enough(key: bytes, shortest: int) -> bool:
    return len(key) >= shortest and (shortest <= 1 or _code_points(key) >= shortest)


# --- cuckoo filter: rows of four 32-bit fingerprints, 0 is free


def _place(hi: np.ndarray, lo: np.ndarray, mask) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, bucket, other bucket) of keys; the other bucket follows from either bucket and the fingerprint."""
    lo = lo.view(np.uint64)
    mark = (lo >> np.uint64(32)).astype(np.uint32)
    mark[mark == 0] = 1
    one = (lo & mask).astype(np.int64)
    return mark, one, one ^ (mixed(mark) & mask).astype(np.int64)


def _mask(n_buckets: int) -> np.uint64:
    return np.uint64(n_buckets - 1)


def _insert(table: np.ndarray, mark: int, one: int, two: int, rng: np.random.Generator) -> bool:
    for bucket in (one, two):
        free = np.flatnonzero(table[bucket] == 0)
        if len(free):
            table[bucket, free[0]] = mark
            return True
    bucket, mask = two, _mask(len(table))
    for _ in range(KICKS):
        slot = rng.integers(SLOTS)
        mark, table[bucket, slot] = int(table[bucket, slot]), mark
        bucket ^= int(mixed(np.array([mark]))[0] & mask)
        free = np.flatnonzero(table[bucket] == 0)
        if len(free):
            table[bucket, free[0]] = mark
            return True
    return False


def _delete(table: np.ndarray, mark: int, one: int, two: int) -> None:
    for bucket in (one, two):
        at = np.flatnonzero(table[bucket] == mark)
        if len(at):
            table[bucket, at[0]] = 0
            return
    raise ValueError("a key to be deleted is not in its filter")


def _built(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A filter of the keys, at most three quarters full."""
    n = 1
    while n * SLOTS * 3 < len(lo) * 4:
        n *= 2
    while True:
        table, rng = np.zeros((n, SLOTS), np.uint32), np.random.default_rng(n)
        if all(_insert(table, int(m), int(a), int(b), rng) for m, a, b in zip(*_place(hi, lo, _mask(n)))):
            return table
        n *= 2


def _changed(table: np.ndarray, hi: np.ndarray, lo: np.ndarray, gone: np.ndarray, new: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The filter after deletions and insertions (masks over the keys); built anew, larger, when it is full."""
    table, mask, rng = table.copy(), _mask(len(table)), np.random.default_rng(len(table))
    mark, one, two = _place(hi, lo, mask)
    for i in np.flatnonzero(gone):
        _delete(table, int(mark[i]), int(one[i]), int(two[i]))
    for i in np.flatnonzero(new):
        if not _insert(table, int(mark[i]), int(one[i]), int(two[i]), rng):
            return _built(hi[kept], lo[kept])
    return table


def _holds(table: np.ndarray, base, mask, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which keys the filters hold; ``base`` and ``mask`` are those of each key's shard in the joint table."""
    mark, one, two = _place(hi, lo, mask)
    return (table[base + one] == mark[:, None]).any(1) | (table[base + two] == mark[:, None]).any(1)


# --- the index


@dataclass
class LineIndex:
    """counts: shard, hi, lo, docs. filters: shard, buckets, exceptions. shards: their number, a power of two."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    least: int
    shortest: int

    def discard(self) -> None:
        discard(self.counts, self.filters)


def line_counts(docs: DataFrame, shortest: int = 1) -> DataFrame:
    """(hi, lo, docs): in how many rows each line key occurs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[bytes] = Counter()
            for text in batch.column("text"):
                n.update({k for k in map(_line_key, (text.as_py() or "").encode().split(b"\n")) if _long_enough(k, shortest)})
            d = _digests(list(n))
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(list(n.values()), pa.int64())], ["hi", "lo", "docs"])

    return docs.select("text").mapInArrow(work, "hi long, lo long, docs long").groupBy("hi", "lo").agg(F.sum("docs").alias("docs"))


def _shard(shards: int):
    return F.col("hi").bitwiseAND(F.lit(shards - 1).cast("long")).cast("int").alias("shard")


def _filters(changes: DataFrame, old: DataFrame, least: int) -> DataFrame:
    """Filters of the shards in ``changes`` (shard, hi, lo, before, docs: all keys of each), from the old ones."""

    def work(keys: pa.Table, filters: pa.Table) -> pa.Table:
        hi, lo, before, docs = (keys.column(c).to_numpy().astype(np.int64) for c in ("hi", "lo", "before", "docs"))
        was, now = before >= least, docs >= least
        if filters.num_rows:
            table = np.frombuffer(filters.column("buckets")[0].as_py(), np.uint32).reshape(-1, SLOTS)
            table = _changed(table, hi, lo, was & ~now, now & ~was, now)
        else:
            table = _built(hi[now], lo[now])
        rare = ~now & (docs > 0)
        hi, lo = hi[rare], lo[rare]
        wrong = _holds(table, 0, _mask(len(table)), hi, lo)
        exceptions = np.stack([hi[wrong], lo[wrong]], 1)
        return pa.table({"shard": keys.column("shard")[:1], "buckets": pa.array([table.tobytes()], pa.binary()), "exceptions": pa.array([exceptions.tobytes()], pa.binary())})

    return changes.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(work, "shard int, buckets binary, exceptions binary")


def _no_filters(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], "shard int, buckets binary, exceptions binary")


def index(docs: DataFrame, least: int = 10, shortest: int = 1) -> LineIndex:
    """The index of a first set of documents."""
    counts = stored(line_counts(docs, shortest))
    return _indexed(counts, least, shortest)


def _indexed(counts: DataFrame, least: int, shortest: int) -> LineIndex:
    shards = 1
    while shards * SHARD_KEYS < counts.count():
        shards *= 2
    placed = counts.select(_shard(shards), "hi", "lo", "docs")
    placed.stored_at = counts.stored_at
    made = _filters(placed.withColumn("before", F.lit(0).cast("long")), _no_filters(counts), least)
    return LineIndex(placed, stored(made), shards, least, shortest)


def update(index: LineIndex, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> LineIndex:
    """The index after documents came in and others went. The given one stays valid; discard() it when nothing reads it."""
    sides = [(inserted, 1), (deleted, -1)]
    moves = [line_counts(d, index.shortest).select("hi", "lo", F.lit(0).cast("long").alias("before"), (sign * F.col("docs")).alias("more")) for d, sign in sides if d is not None]
    rows = index.counts.select("hi", "lo", F.col("docs").alias("before"), F.lit(0).cast("long").alias("more"))
    for m in moves:
        rows = rows.unionByName(m)
    both = stored(rows.groupBy("hi", "lo").agg(F.sum("before").alias("before"), (F.sum("before") + F.sum("more")).alias("docs")))
    if not both.where("docs < 0").isEmpty():
        raise ValueError("documents to be taken out are not in the index")
    counts = stored(both.where("docs > 0").select("hi", "lo", "docs"))
    if counts.count() > 2 * index.shards * SHARD_KEYS:
        discard(both)
        return _indexed(counts, index.least, index.shortest)  # shards have outgrown their size
    all_keys = both.select(_shard(index.shards), "hi", "lo", "before", "docs")
    touched = all_keys.where("before <> docs").select("shard").distinct()
    made = _filters(all_keys.join(touched, "shard", "left_semi"), index.filters.join(touched, "shard", "left_semi"), index.least)
    filters = stored(index.filters.join(touched, "shard", "left_anti").unionByName(made))
    discard(both)
    placed = counts.select(_shard(index.shards), "hi", "lo", "docs")
    placed.stored_at = counts.stored_at
    return LineIndex(placed, filters, index.shards, index.least, index.shortest)


# --- cleaning


def _cleaned(texts: list[str | None], frequent, shortest: int) -> list[tuple[str, int, int]]:
    """(what is left, lines, dropped lines) per text. ``frequent`` tells for pairs (text number, key) which keys are dropped."""
    lines = [(t or "").encode().split(b"\n") for t in texts]
    keys = [(i, _line_key(x)) for i, own in enumerate(lines) for x in own]
    drop = iter(frequent(keys) & np.fromiter((_long_enough(k, shortest) for _, k in keys), bool, len(keys)))
    out = []
    for own in lines:
        left = [x for x in own if not next(drop)]
        out.append((b"\n".join(left).decode(), len(own), len(own) - len(left)))
    return out


OUT = "doc_id long, text string, n_lines long, n_dropped long"


def _batch(ids: pa.Array, rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])


def clean(docs: DataFrame, index: LineIndex, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, text without frequent lines, n_lines (before), n_dropped. The documents must be in the index."""
    size = index.filters.agg(F.sum(F.length("buckets") + F.length("exceptions"))).first()[0] or 0
    return _by_filters(docs, index) if size <= filter_bytes else _by_join(docs, index)


def _by_filters(docs: DataFrame, index: LineIndex) -> DataFrame:
    parts = sorted(index.filters.collect())  # clean() has checked their size
    tables = {r["shard"]: np.frombuffer(bytes(r["buckets"]), np.uint32).reshape(-1, SLOTS) for r in parts}
    free = np.zeros((1, SLOTS), np.uint32)
    sizes = np.array([len(tables.get(s, free)) for s in range(index.shards)])
    joint = np.concatenate([tables.get(s, free) for s in range(index.shards)])
    wrong = frozenset(x for r in parts for x in map(tuple, np.frombuffer(bytes(r["exceptions"]), np.int64).reshape(-1, 2).tolist()))
    sent = docs.sparkSession.sparkContext.broadcast((joint, np.cumsum(sizes) - sizes, (sizes - 1).astype(np.uint64), wrong))
    shards, shortest = index.shards, index.shortest

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base, mask, exceptions = sent.value

        def frequent(keys: list[tuple[int, bytes]]) -> np.ndarray:
            d = _digests([k for _, k in keys])
            shard = d[:, 0] & (shards - 1)
            found = _holds(table, base[shard], mask[shard], d[:, 0].copy(), d[:, 1].copy())
            if exceptions:
                for i in np.flatnonzero(found):
                    found[i] = (int(d[i, 0]), int(d[i, 1])) not in exceptions
            return found

        for batch in batches:
            yield _batch(batch.column("doc_id"), _cleaned(batch.column("text").to_pylist(), frequent, shortest))

    return docs.select("doc_id", "text").mapInArrow(work, OUT)


def _by_join(docs: DataFrame, index: LineIndex) -> DataFrame:
    """Keys of every distinct text meet the exact counts; what is frequent comes back to the rows that hold the text."""
    shortest, digest = index.shortest, F.sha2(F.coalesce("text", F.lit("")), 256).alias("t")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, t in zip(batch.column("text"), batch.column("t")):
                d = _digests(list({k for k in map(_line_key, (text.as_py() or "").encode().split(b"\n")) if _long_enough(k, shortest)}))
                yield pa.RecordBatch.from_arrays([pa.array([t.as_py()] * len(d), pa.string()), pa.array(d[:, 0]), pa.array(d[:, 1])], ["t", "hi", "lo"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = {(i, x["hi"], x["lo"]) for i, drop in enumerate(batch.column("drop").to_pylist()) for x in drop or ()}

            def frequent(keys: list[tuple[int, bytes]]) -> np.ndarray:
                return np.array([(i, *d) in gone for (i, _), d in zip(keys, _digests([k for _, k in keys]).tolist())], bool)

            yield _batch(batch.column("doc_id"), _cleaned(batch.column("text").to_pylist(), frequent, shortest))

    d = docs.select("doc_id", "text", digest)
    often = index.counts.where(F.col("docs") >= index.least).select("hi", "lo")
    pairs = d.select("text", "t").mapInArrow(keys, "t string, hi long, lo long").distinct()
    drops = pairs.join(often, ["hi", "lo"]).groupBy("t").agg(F.collect_list(F.struct("hi", "lo")).alias("drop"))
    return d.join(drops, "t", "left").select("doc_id", "text", "drop").mapInArrow(work, OUT)
