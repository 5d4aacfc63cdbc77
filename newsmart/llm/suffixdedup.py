"""Exact substring dedup by a hash-compared suffix sort.

Bytes covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id are removed. Suffixes are
compared by prefix polynomial hashes: a binary search over the length finds the common extension of two suffixes in a
few steps, whatever their length, and a bottom-up mergesort merges runs by rank with such comparisons. Suffixes that come
out equal are compared byte by byte, and a group with a hash collision is sorted by its bytes.

Not every suffix needs to be sorted. Each window of ``LENGTH`` bytes has an anchor, the ``GRAM``-byte string in it with the
smallest hash (the leftmost of equals), so equal windows have equal anchors at equal offsets. Neighbouring windows share
anchors, about one per 18 bytes.

1. Documents are dealt into blocks of bounded size. A block sends the distinct hashes of its anchors to hash buckets, once
   each however often it holds them; buckets answer which occur in more than one document.
2. For these, a block sorts the suffixes that start at the windows of each anchor, merges equal ones into classes with
   their smallest document, and sends each class once to its bucket.
3. A bucket sorts the classes of each anchor; where they differ, it sorts the suffixes at every window offset. Equal
   windows get the smallest document of all. The answer goes back to the blocks that asked.
   Neither sorts a string whose hash no other of its group has, as that equals none.
4. A block applies the answers to its documents.

A passage that a third of all documents hold thus costs one row per block. Tasks hold one block or one bucket.

Defined results: null texts are empty; texts shorter than ``LENGTH`` are left whole; rows with a null id neither remove nor
lose anything; repeated rows of one id do not affect one another; an empty table gives no rows.
"""

from __future__ import annotations

import copy
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmart.llm.base import BASE, INVERSE, chunks, mixed, powers, prefix_hash, release, stored, text_bytes

LENGTH = 50
GRAM = 16
WINDOW = LENGTH - GRAM + 1  # anchor places in a window
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 6 << 20
PIECE = 1 << 17
PLACE = np.uint64((1 << 24) - 1)
LEAST_ID = np.iinfo(np.int64).min

_forward = powers(PIECE + LENGTH)
_backward = powers(PIECE + LENGTH, INVERSE)


def _anchors_of(data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of the anchors of a piece. stop[j]: end of the document at j."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    total = prefix_hash(data, _forward)
    gram = mixed((total[GRAM:] - total[:-GRAM]) * _backward[: n - GRAM + 1])
    key = (gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64)
    low = key
    for step in (1, 2, 4, 8, 16):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: len(low) - (WINDOW - 32)], low[WINDOW - 32 :])
    window = np.flatnonzero(stop[: len(low)] >= np.arange(LENGTH, len(low) + LENGTH))
    place = (low[window] & PLACE).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    return gram[place[first]], place[first], window[first], window[last]


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Anchors of all documents of a block, in places of the block's bytes."""
    out = []
    for i, j in chunks(offsets, PIECE):
        begin, end = offsets[i], offsets[j]
        stop = np.repeat(offsets[i + 1 : j + 1], np.diff(offsets[i : j + 1]))
        for s in range(begin, max(begin + 1, end - LENGTH + 1), PIECE):  # more than one step only in a very long document
            e = min(end, s + PIECE + LENGTH - 1)
            h, a, first, last = _anchors_of(data[s:e], np.minimum(stop[s - begin : e - begin], e) - s)
            out.append((h, a + s, first + s, last + s))
    return [np.concatenate(c) for c in zip(*out)] if out else list(_anchors_of(data[:0], data[:0]))


class Suffixes:
    """Substrings of one byte array, compared through prefix hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.data, self.start, self.length = data, start, length
        self.power = powers(len(data) + 1)
        self.total = prefix_hash(data, self.power)

    def at(self, start: np.ndarray, length: np.ndarray) -> Suffixes:
        """Other substrings of the same bytes."""
        out = copy.copy(self)
        out.start, out.length = start, length
        return out

    def whole(self) -> np.ndarray:
        """A hash of every substring; equal ones have equal hashes."""
        return (self.total[self.start + self.length] - self.total[self.start]) * self.power[len(self.data) - self.start]

    def classes(self, *group: np.ndarray) -> np.ndarray:
        """Number of each substring's class: equal bytes and groups. Numbers follow from the contents, whatever the order of rows.

        A substring whose hash nobody in its group has equals none; only the others are sorted.
        """
        key = self.whole()
        for g in (self.length, *group):
            key = mixed(key ^ mixed(g.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        twin = np.zeros(len(key) + 1, bool)
        twin[1:-1] = key[order[1:]] == key[order[:-1]]
        some = order[twin[1:] | twin[:-1]]
        by_bytes, equal = self.at(self.start[some], self.length[some]).sorted_groups(_ids(*(g[some] for g in group), self.length[some]))
        rank = np.zeros(len(key), np.int64)
        rank[some[by_bytes]] = np.cumsum(~equal)
        new = np.ones(len(key), bool)
        new[1:] = ~twin[1:-1]
        if np.any(twin[1:-1] & (rank[order[1:]] != rank[order[:-1]])):  # a hash collision
            order = np.lexsort((rank, key))
            new[1:] |= rank[order[1:]] != rank[order[:-1]]
        number = np.empty(len(key), np.int64)
        number[order] = np.cumsum(new) - 1
        return number

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, by binary search over prefix hashes."""
        p, q = self.start[a], self.start[b]
        left, right = np.minimum(p, q), np.maximum(p, q)
        lift = self.power[right - left]
        most = np.minimum(self.length[a], self.length[b])
        open_ = np.flatnonzero((self.total[left + most] - self.total[left]) * lift != self.total[right + most] - self.total[right])
        left, right, lift = left[open_], right[open_], lift[open_]
        base_l, base_r = self.total[left], self.total[right]
        low, high = np.zeros(len(open_), np.int64), most[open_] - 1
        step = 1 << int(high.max(initial=0)).bit_length()
        while step > 1:  # low is a common length, and the common extension is less than low + 2 * step
            step >>= 1
            mid = np.minimum(low + step, high)
            same = (self.total[left + mid] - base_l) * lift == self.total[right + mid] - base_r
            np.copyto(low, mid, where=same)
        most[open_] = low
        return most

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.extension(a, b)
        end_a, end_b = n >= self.length[a], n >= self.length[b]
        last = len(self.data) - 1
        smaller = self.data[np.minimum(self.start[a] + n, last)] < self.data[np.minimum(self.start[b] + n, last)]
        return np.where(end_a & end_b, or_equal, np.where(end_a, True, np.where(end_b, False, smaller)))

    def sorted_groups(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, equal): suffixes by group and then by bytes; equal[i]: the i-th equals the one before, in its group."""
        order = np.argsort(group, kind="stable")
        g = group[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(g)))
        begin, count = np.repeat(first, size), np.repeat(size, size)
        # groups of one hash are in order as they stand: they are equal, or sorted by bytes below
        whole, length = self.whole()[order], self.length[order]
        apart = (whole != whole[begin]) | (length != length[begin])
        to_merge = np.where(np.logical_or.reduceat(apart, first), size, 1) if len(size) else size
        in_runs = np.repeat(to_merge, size)
        width = 1
        while len(size) and width < to_merge.max():
            at = np.flatnonzero(in_runs > width)
            inside = at - begin[at]
            run = inside // (2 * width) * (2 * width)
            right = inside - run >= width
            other = begin[at] + run + np.where(right, 0, width)  # the sibling run
            other_n = np.clip(begin[at] + count[at] - other, 0, width)
            low, high = np.zeros(len(at), np.int64), other_n.copy()
            while (low < high).any():
                live = np.flatnonzero(low < high)
                mid = (low[live] + high[live]) >> 1
                # a right element goes after equal left ones
                before = self.less(order[other[live] + mid], order[at[live]], right[live])
                low[live] = np.where(before, mid + 1, low[live])
                high[live] = np.where(before, high[live], mid)
            to = begin[at] + run + (inside - run - np.where(right, width, 0)) + low
            merged = order.copy()
            merged[to] = order[at]
            order, width = merged, 2 * width
        equal = np.zeros(len(g), bool)
        near = np.flatnonzero(~new)
        if len(near):
            a, b = order[near - 1], order[near]
            same = (self.length[a] == self.length[b]) & (self.extension(a, b) == self.length[a])
            near, a, b = near[same], a[same], b[same]
            true = self._same_bytes(a, b)
            equal[near[true]] = True
            for start in np.unique(begin[near[~true]]):  # a hash collision: this group is sorted by its bytes
                own = slice(start, start + count[start])
                text = {i: self.data[self.start[i] : self.start[i] + self.length[i]].tobytes() for i in order[own]}
                order[own] = sorted(order[own], key=text.__getitem__)
                equal[own] = [False] + [text[x] == text[y] for x, y in zip(order[own], order[own][1:])]
        return order, equal

    def _same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for i in range(0, len(a), 50_000):
            n = self.length[a[i : i + 50_000]]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            apart = self.data[np.repeat(self.start[a[i : i + 50_000]], n) + step] != self.data[np.repeat(self.start[b[i : i + 50_000]], n) + step]
            out[i + np.repeat(np.arange(len(n)), n)[apart]] = False
        return out


def _ids(*keys: np.ndarray) -> np.ndarray:
    """Number of each distinct combination of keys, in sorted order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def classes(data: np.ndarray, h, a, first, last):
    """(class of each anchor, a member of each class): anchors with equal surroundings. The same in any order of the rows."""
    number = Suffixes(data, first, last - first + LENGTH).classes(h, a - first)
    member = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
    member[number] = np.arange(len(number))
    return number, member


def _lists(values: np.ndarray, count: np.ndarray, kind=None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(values, kind))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each run, length) of a sorted key."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(key)))


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _sizes(table: pa.Table, name: str) -> np.ndarray:
    return np.diff(table.column(name).combine_chunks().offsets.to_numpy())


def _block(table: pa.Table):
    data, offsets = text_bytes(table.column("text"))
    known = table.column("doc_id").is_valid().to_numpy()
    ids = table.column("doc_id").fill_null(0).to_numpy()
    h, a, first, last = anchors(data, offsets)
    row = np.searchsorted(offsets, a, "right") - 1
    keep = known[row]
    return data, offsets, ids, *(x[keep] for x in (h, a, first, last, row))


HASHES = "bucket long, block long, hashes array<long>, often array<boolean>"


def _ask(buckets: int):
    def work(table: pa.Table) -> pa.Table:
        _, _, ids, h, _, _, _, row = _block(table)
        doc = ids[row]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        first, n = _runs(h)
        many = doc[first] != doc[first + n - 1] if len(first) else np.zeros(0, bool)
        h = h[first]
        bucket = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first, n = _runs(bucket[order])
        block = np.full(len(first), table.column("block")[0].as_py(), np.int64)
        return pa.table([pa.array(bucket[order][first]), pa.array(block), _lists(h[order].view(np.int64), n), _lists(many[order], n, pa.bool_())], ["bucket", "block", "hashes", "often"])

    return work


ANSWER = "block long, kind int, x array<long>, k0 array<int>, k1 array<int>, least array<long>"


def _answer_table(block, kind, x, k0, k1, least) -> pa.Table:
    """One row per block; inputs sorted by block."""
    first, n = _runs(block)
    lists = [_lists(x, n, pa.int64()), _lists(k0, n, pa.int32()), _lists(k1, n, pa.int32()), _lists(least, n, pa.int64())]
    return pa.table([pa.array(block[first], pa.int64()), pa.array(np.full(len(first), kind), pa.int32()), *lists], ["block", "kind", "x", "k0", "k1", "least"])


def _repeated(table: pa.Table) -> pa.Table:
    """Which hashes of a bucket occur in two blocks, or in two documents of one."""
    h, often = _flat(table, "hashes").view(np.uint64), _flat(table, "often")
    block = np.repeat(table.column("block").to_numpy(), _sizes(table, "hashes"))
    order = np.argsort(h, kind="stable")
    first, n = _runs(h[order])
    yes = np.repeat((n > 1) | (np.logical_or.reduceat(often[order], first) if len(first) else np.zeros(0, bool)), n)
    keep = order[yes]
    keep = keep[np.argsort(block[keep], kind="stable")]
    none = np.zeros(len(keep), np.int32)
    return _answer_table(block[keep], 0, h[keep].view(np.int64), none, none, none.astype(np.int64))


CONTEXTS = "bucket long, block long, hash array<long>, anchor array<int>, size array<int>, number array<long>, least array<long>, many array<boolean>, data binary"


def _candidates(table: pa.Table, answers: pa.Table):
    """A block's anchors that occur in more than one document, and their classes."""
    data, offsets, ids, h, a, first, last, row = _block(table)
    own = answers.filter(pa.compute.equal(answers.column("kind"), 0))
    asked = np.sort(_flat(own, "x").view(np.uint64)) if own.num_rows else np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(asked, h), max(0, len(asked) - 1))
    keep = asked[at] == h if len(asked) else np.zeros(len(h), bool)
    h, a, first, last, row = (x[keep] for x in (h, a, first, last, row))
    number, member = classes(data, h, a, first, last)
    return data, offsets, ids, h, a, first, last, row, number, member


def _contexts(buckets: int):
    def work(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in CONTEXT_TYPES], CONTEXT_NAMES)
        data, _, ids, h, a, first, last, row, number, member = _candidates(table, answers)
        doc = ids[row]
        least, most = np.full(len(member), np.iinfo(np.int64).max), np.full(len(member), LEAST_ID)
        np.minimum.at(least, number, doc)
        np.maximum.at(most, number, doc)
        key = h[member]
        bucket = ((key >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        m = member[order]
        size = last[m] - first[m] + LENGTH
        runs, n = _runs(bucket[order])
        ends = np.cumsum(size)
        text = data[np.arange(size.sum()) + np.repeat(first[m] - (ends - size), size)].tobytes()
        cuts = np.concatenate([[0], ends])
        blobs = [text[cuts[i] : cuts[i + k]] for i, k in zip(runs, n)]
        block = np.full(len(runs), table.column("block")[0].as_py(), np.int64)
        return pa.table(
            [pa.array(bucket[order][runs]), pa.array(block), _lists(key[order].view(np.int64), n), _lists((a[m] - first[m]).astype(np.int32), n), _lists(size.astype(np.int32), n), _lists(order, n, pa.int64()), _lists(least[order], n), _lists((most != least)[order], n, pa.bool_()), pa.array(blobs, pa.binary())],
            CONTEXT_NAMES,
        )

    return work


CONTEXT_NAMES = ["bucket", "block", "hash", "anchor", "size", "number", "least", "many", "data"]
CONTEXT_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary()]


def _settle(table: pa.Table) -> pa.Table:
    """The smallest document of every window of a bucket's classes."""
    data, _ = text_bytes(table.column("data"))
    h = _flat(table, "hash").view(np.uint64)
    anchor, size = _flat(table, "anchor").astype(np.int64), _flat(table, "size").astype(np.int64)
    number, least, many = _flat(table, "number"), _flat(table, "least"), _flat(table, "many")
    block = np.repeat(table.column("block").to_numpy(), _sizes(table, "hash"))
    start = np.cumsum(size) - size
    # classes that different blocks share
    text = Suffixes(data, start, size)
    same = text.classes(h, anchor)
    n = int(same.max(initial=-1)) + 1
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, same, least)
    rep = np.zeros(n, np.int64)
    rep[same] = np.arange(len(same))
    # where an anchor has several classes, window by window
    group = _ids(h[rep])
    open_ = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
    count = size[rep] - LENGTH + 1
    of = np.repeat(open_, count[open_])
    k = np.arange(len(of)) - np.repeat(np.cumsum(count[open_]) - count[open_], count[open_])
    best = low[of]
    if len(of):
        run = text.at(start[rep[of]] + k, np.full(len(of), LENGTH)).classes(group[of], anchor[rep[of]] - k)
        lowest = np.full(run.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, run, best)
        best = lowest[run]
    single = np.setdiff1d(np.arange(n), open_)
    # runs of windows with one smallest document
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (best[1:] != best[:-1])
    r = np.flatnonzero(new)
    ends = np.append(r[1:], len(of)) - 1
    cls = np.concatenate([single, of[r]])
    k0, k1 = np.concatenate([np.zeros(len(single), np.int64), k[r]]), np.concatenate([count[single] - 1, k[ends]])
    value = np.concatenate([low[single], best[r]])
    by = np.argsort(cls, kind="stable")
    cls, k0, k1, value = cls[by], k0[by], k1[by], value[by]
    # back to every class that was sent; drop what can remove nothing
    runs_of = np.bincount(cls, minlength=n)
    at = np.repeat(np.arange(len(same)), runs_of[same])
    pick = np.arange(len(at)) - np.repeat(np.cumsum(runs_of[same]) - runs_of[same], runs_of[same]) + np.repeat((np.cumsum(runs_of) - runs_of)[same], runs_of[same])
    use = (value[pick] < least[at]) | many[at]
    at, pick = at[use], pick[use]
    o = np.argsort(block[at], kind="stable")
    at, pick = at[o], pick[o]
    return _answer_table(block[at], 1, number[at], k0[pick].astype(np.int32), k1[pick].astype(np.int32), value[pick])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed(table: pa.Table, answers: pa.Table):
    """(data, offsets, covered) of a block: which bytes go."""
    data, offsets, ids, h, a, first, last, row, number, member = _candidates(table, answers)
    own = answers.filter(pa.compute.equal(answers.column("kind"), 1))
    change = np.zeros(len(data) + 1, np.int32)
    if own.num_rows and len(number):
        x, k0, k1, least = (_flat(own, c) for c in ("x", "k0", "k1", "least"))
        order = np.argsort(x, kind="stable")
        x, k0, k1, least = x[order], k0[order], k1[order], least[order]
        per = np.bincount(x, minlength=len(member))
        n = per[number]
        at = np.repeat(np.arange(len(number)), n)
        pick = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(per) - per)[number], n)
        use = least[pick] < ids[row[at]]
        at, pick = at[use], pick[use]
        np.add.at(change, first[at] + k0[pick], 1)
        np.add.at(change, first[at] + k1[pick] + LENGTH, -1)
    return data, offsets, np.cumsum(change[:-1]) > 0


def _apply(table: pa.Table, answers: pa.Table) -> pa.Table:
    if not table.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(),) * 4 + (pa.string(),)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    data, offsets, gone = removed(table, answers)
    total = np.concatenate([[0], np.cumsum(gone)])
    rises = gone.copy()
    inner = np.ones(len(gone), bool)
    inner[offsets[:-1][offsets[:-1] < len(gone)]] = False
    rises[1:] &= ~(gone[:-1] & inner[1:])
    spans = np.concatenate([[0], np.cumsum(rises)])
    n_removed = total[offsets[1:]] - total[offsets[:-1]]
    kept = data[~gone].tobytes()
    cut = offsets - total[offsets]
    view = memoryview(kept)
    digest = [hashlib.sha256(view[i:j]).hexdigest() for i, j in zip(cut[:-1], cut[1:])]
    return pa.table([table.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_removed), pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), pa.array(digest)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)))
    by_block = lambda df: df.groupBy("block")
    repeats = stored(by_block(dealt).applyInArrow(_ask(buckets), HASHES).groupBy("bucket").applyInArrow(_repeated, ANSWER))
    release(spark)
    settled = stored(by_block(dealt).cogroup(by_block(repeats)).applyInArrow(_contexts(buckets), CONTEXTS).groupBy("bucket").applyInArrow(_settle, ANSWER))
    release(spark)
    return by_block(dealt).cogroup(by_block(repeats.unionByName(settled))).applyInArrow(_apply, RESULT)
