"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows are documents, columns are hashed n-grams. Equal rows are one row. Two sets of n and m n-grams reach similarity t
only if their sizes are within a factor t and they differ in at most d = (1 - t) / (1 + t) * (n + m) columns. The columns
of a size class are therefore cut into d + 1 and some more blocks by hash: two linked rows agree exactly on more blocks
than any document may leave empty, so on a block that is not empty. Row blocks are what shares such a column block.

What shares such a block with its first row, directly or not, is a family. Rows first meet the first rows of their column
blocks; what that links needs no product any more. The rest of a family is cut into tiles of bounded size, and every pair
of tiles is multiplied column block by column block, accumulating overlaps and dropping pairs that can no longer reach
the bound set by their sizes. A task emits fewer links than it has rows; pairs never become rows.

Shuffled: one (block key, row) per column block, and the sets of rows that share any. Hot blocks combine before the
shuffle, and joins are left to adaptive execution, which splits large keys.

Defined results: null or word-free texts have the empty set and no links; texts of fewer than n words have their whole
sequence as one n-gram; ties and repeated rows are rows with equal sets; rows with a null id are given as their own
component with a null id; an empty table gives no rows. Rows that repeat an id are one document, linked by any of its texts.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsmart.llm.base import BASE, BYTE_CODE, INVERSE, IS_SPACE, LOWER, chunks, discard, mixed, powers, release, stored, text_bytes
from newsmart.operators.graph import connected_components

CLASS_RATIO = 1.4  # sizes of one class differ by at most this factor
PIECE = 1 << 19
WORDED = r"[^\x20\x09-\x0D]"


_TABLES: dict[int, np.ndarray] = {}  # a worker's own: empty when functions are sent


def _powers(n: int, base: int) -> np.ndarray:
    """The first n powers; tables are kept for pieces of the usual size."""
    if n > 2 * PIECE:
        return powers(n, base)[:n]
    if base not in _TABLES:
        _TABLES[base] = powers(2 * PIECE, base)
    return _TABLES[base][:n]


def shingles(data: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every distinct n-gram, sorted. ``doc``: document of each byte; documents are kept apart by a space."""
    low = LOWER[data]
    word = ~IS_SPACE[low]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(BYTE_CODE[low] * _powers(len(low), BASE), out=total[1:])
    words = mixed((total[ends] - total[starts]) * _powers(len(low), INVERSE)[starts] + (ends - starts).astype(np.uint64))
    owner = doc[starts]
    count = np.bincount(owner, minlength=n_docs)
    first = np.cumsum(count) - count
    full = len(words) - n + 1
    grams, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if full > 0:
        grams = np.zeros(full, np.uint64)
        for k in range(n):
            grams = mixed(grams + words[k : k + full])
        same = owner[:full] == owner[n - 1 :]
        grams, own = grams[same], owner[:full][same]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            whole[has] = mixed(whole[has] + words[first[short[has]] + k])
        own, grams = np.concatenate([own, short]), np.concatenate([grams, mixed(whole ^ count[short].astype(np.uint64))])
    order = np.lexsort((grams, own))
    own, grams = own[order], grams[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (grams[1:] != grams[:-1])
    return own[new], grams[new]


def most_different(lo: int, hi: int, threshold: Fraction) -> int:
    """Columns in which two linked rows may differ, the smaller one having lo to hi n-grams."""
    apart = lambda n, m: n + m - 2 * math.ceil(threshold / (1 + threshold) * (n + m))
    if hi <= 400:
        return max(apart(n, m) for n in range(lo, hi + 1) for m in range(n, math.floor(n / threshold) + 1))
    return apart(hi, math.floor(hi / threshold)) + 2  # rounding moves it by less than 2


def layout(threshold: Fraction) -> list[tuple[int, int, int, int, int]]:
    """(least size, greatest size, column blocks, empty blocks allowed, number) of every size class up to 2^31.

    A pair is found in the class of its smaller size, so a class also takes the greater sizes that a partner may have.
    There are so many blocks that rows with too few filled ones are six standard deviations off; these show their empty
    blocks as well, so no pair is lost. Classes in which only equal rows are linked need no blocks.
    """
    out, lo, k = [], 1, 0
    while lo < 1 << 31:
        hi = max(lo, math.floor(lo * CLASS_RATIO))
        differ = most_different(lo, hi, threshold)
        blocks = differ + 1
        while blocks < 8 * lo:
            load = lo / blocks
            filled = blocks * (1 - math.exp(-load))
            spread = math.sqrt(max(blocks * (math.exp(-load) - (1 + load) * math.exp(-2 * load)), 0))
            if filled - 6 * spread >= differ + 1:
                break
            blocks += max(1, blocks // 50)
        if differ > 0:
            out.append((lo, math.floor(hi / threshold), blocks, blocks - differ - 1, k))
        lo, k = hi + 1, k + 1
    return out


CLASS_BITS = 7  # the first bits of a key are its class; there are fewer than 128 up to sets of 2^31


def block_keys(own: np.ndarray, grams: np.ndarray, sizes: np.ndarray, classes) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, key) of every column block that a document enters, and (document, class, spare). Keys tell class, block and content.

    spare: so many of the document's keys of this class may be left out, whichever, as linked rows agree on more.
    """
    out, spares = [], []
    first = np.cumsum(sizes) - sizes
    for lo, most, blocks, empty_allowed, k in classes:
        at = np.flatnonzero((sizes >= max(lo, 2)) & (sizes <= most))
        if not len(at):
            continue
        index = np.repeat(np.arange(len(at)), sizes[at])
        take = np.arange(len(index)) - np.repeat(np.cumsum(sizes[at]) - sizes[at], sizes[at]) + np.repeat(first[at], sizes[at])
        g = grams[take]
        cell = index * blocks + (mixed(g ^ np.uint64(0x51ED)) >> np.uint64(33)).astype(np.int64) % blocks
        total = np.zeros(len(at) * blocks, np.uint64)
        np.add.at(total, cell, mixed(g))
        filled = np.bincount(cell, minlength=len(total))
        empty = (filled.reshape(-1, blocks) == 0).sum(1)
        use = (filled > 0) | np.repeat(empty > empty_allowed, blocks)  # a document with too many empty blocks shows them too
        cells = np.flatnonzero(use)
        key = mixed(mixed(total[cells] + filled[cells].astype(np.uint64)) + np.uint64(k << 40) + (cells % blocks).astype(np.uint64))
        out.append((at[cells // blocks], key >> np.uint64(CLASS_BITS) | np.uint64(k << 64 - CLASS_BITS)))
        spares.append((at, np.full(len(at), k), np.maximum(empty_allowed - empty, 0)))
    none = np.zeros(0, np.int64)
    join = lambda rows, empty: tuple(np.concatenate(c) for c in zip(*rows)) if rows else empty
    return join(out, (none, none.view(np.uint64))), join(spares, (none, none, none))


def _pieces(batch, n: int):
    """(first row, last row, document of every set entry, n-grams) of slices of a batch."""
    data, offsets = text_bytes(batch.column("text"))
    for i, j in chunks(offsets, PIECE):
        size = np.diff(offsets[i : j + 1])
        doc = np.repeat(np.arange(j - i), size)
        text = np.full(size.sum() + (j - i), 32, np.uint8)
        text[np.arange(len(doc)) + doc] = data[offsets[i] : offsets[j]]
        yield i, j, *shingles(text, np.repeat(np.arange(j - i), size + 1), j - i, n)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    count = np.bincount(owner, minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(values.view(np.int64)))


def sketches(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """doc_id, t, n_shingles, h1 and h2 (of the whole set), keys of its column blocks, and its classes with their spares."""
    classes = layout(threshold)

    def work(batches):
        for batch in batches:
            for i, j, own, grams in _pieces(batch, n):
                sizes = np.bincount(own, minlength=j - i)
                sums = np.zeros((2, j - i), np.uint64)
                np.add.at(sums[0], own, mixed(grams))
                np.add.at(sums[1], own, mixed(grams ^ np.uint64(0xA5A5A5A5A5A5)))
                (doc, keys), (of, size_class, spare) = block_keys(own, grams, sizes, classes)
                order, by = np.argsort(doc, kind="stable"), np.argsort(of, kind="stable")
                parts = [_lists(keys[order], doc[order], j - i), _lists(size_class[by], of[by], j - i), _lists(spare[by], of[by], j - i)]
                same = [batch.column(c).slice(i, j - i) for c in ("doc_id", "t")]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(sizes.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), *parts],
                    ["doc_id", "t", "n_shingles", "h1", "h2", "keys", "classes", "spare"],
                )

    return docs.select("doc_id", "t", "text").mapInArrow(work, "doc_id long, t long, n_shingles long, h1 long, h2 long, keys array<long>, classes array<long>, spare array<long>")


def whole_sets(docs: DataFrame, n: int) -> DataFrame:
    """docs (id, text) -> id, grams (sorted distinct hashes)."""

    def work(batches):
        for batch in batches:
            for i, j, own, grams in _pieces(batch, n):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), _lists(grams, own, j - i)], ["id", "grams"])

    return docs.select("id", "text").mapInArrow(work, "id long, grams array<long>")


def linked(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    one, other = (sets.select(F.col("id").alias(c), F.col("grams").alias(f"_{c}")) for c in "ab")
    both = pairs.join(other, "b").join(one, "a")
    common = F.size(F.array_intersect("_a", "_b")).cast("long")
    union = F.size("_a") + F.size("_b") - common
    return both.select("a", "b", common.alias("common"), union.alias("total")).where(F.col("common") * threshold.denominator >= F.col("total") * threshold.numerator).select("a", "b")


TILE_GRAMS = 400_000
TILE = "fam long, tile long, ids array<long>, labels array<long>, sizes array<long>, grams array<long>"


def _pack(table: pa.Table) -> pa.Table:
    """The rows of one tile as one row."""
    one = lambda x: pa.array([x], pa.list_(pa.int64()))
    grams = table.column("grams").combine_chunks()
    columns = [table.column(c)[:1].combine_chunks() for c in ("fam", "tile")]
    columns += [one(table.column(c).to_numpy()) for c in ("id", "label")] + [one(np.diff(grams.offsets.to_numpy()).astype(np.int64)), one(grams.flatten().to_numpy())]
    return pa.table(columns, ["fam", "tile", "ids", "labels", "sizes", "grams"])


def product(left, right, num: int, den: int, dense: int = 16, width: int = 1024) -> np.ndarray:
    """Linked (row, row) of two tiles with different labels. A tile: (labels, sizes, grams).

    Overlaps are accumulated over blocks of columns, rare columns first. A pair is dropped as soon as what it has and the
    columns still open to the smaller of both cannot reach the bound that its sizes set.
    """
    (la, na, ga), (lb, nb, gb) = left, right
    total = na[:, None] + nb[None, :]
    need = -(-num * total // (num + den))  # least overlap for the similarity
    alive = (np.minimum(na[:, None], nb[None, :]) >= need) & (la[:, None] != lb[None, :])
    out = np.zeros((0, 2), np.int64)
    if not alive.any():
        return out
    common = np.intersect1d(ga, gb)
    if not len(common):
        return out

    def entries(n, g):
        row = np.repeat(np.arange(len(n)), n)
        col = np.minimum(np.searchsorted(common, g), len(common) - 1)
        hit = common[col] == g
        row, col = row[hit], col[hit]
        order = np.argsort(col, kind="stable")
        return row[order], col[order], np.bincount(col, minlength=len(common))

    (ra, ca, fa), (rb, cb, fb) = entries(na, ga), entries(nb, gb)
    count = np.zeros(total.shape, np.float32)
    open_a, open_b = np.bincount(ra, minlength=len(na)), np.bincount(rb, minlength=len(nb))
    often = fa * fb > dense * dense
    # rare columns: the few pairs of each
    at = np.flatnonzero(~often[ca])
    first = np.cumsum(fb) - fb
    n = fb[ca[at]]
    i = np.repeat(ra[at], n)
    j = rb[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[ca[at]], n)]
    np.add.at(count, (i, j), 1)
    open_a = open_a - np.bincount(ra[at], minlength=len(na))
    open_b = open_b - np.bincount(rb[~often[cb]], minlength=len(nb))
    place = np.cumsum(often) - 1
    ka, kb = often[ca], often[cb]
    ra, ca, rb, cb = ra[ka], place[ca[ka]], rb[kb], place[cb[kb]]
    for c in range(0, int(often.sum()), width):
        alive &= count + np.minimum(open_a[:, None], open_b[None, :]) >= need
        rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows):
            return out
        x, y = np.zeros((len(na), width), np.float32), np.zeros((len(nb), width), np.float32)
        ia, ib = slice(*np.searchsorted(ca, (c, c + width))), slice(*np.searchsorted(cb, (c, c + width)))
        x[ra[ia], ca[ia] - c] = 1
        y[rb[ib], cb[ib] - c] = 1
        count[np.ix_(rows, cols)] += x[rows] @ y[cols].T
        open_a, open_b = open_a - np.bincount(ra[ia], minlength=len(na)), open_b - np.bincount(rb[ib], minlength=len(nb))
    alive &= count * den >= num * (total - count)
    return np.argwhere(alive)


def _multiply(num: int, den: int):
    def work(table: pa.Table) -> pa.Table:
        tiles = []
        for r in range(table.num_rows):
            tiles.append([table.column(c)[r].values.to_numpy() for c in ("ids", "labels", "sizes", "grams")])
        one, other = tiles[0], tiles[-1]
        links = product(one[1:], other[1:], num, den)
        a, b = one[0][links[:, 0]], other[0][links[:, 1]]
        # links that join what the tile's own links have not joined yet: fewer than rows
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        keep = []
        label_a, label_b = one[1][links[:, 0]], other[1][links[:, 1]]
        for k, (x, y) in enumerate(zip(label_a.tolist(), label_b.tolist())):
            x, y = root(x), root(y)
            if x != y:
                parent[x] = y
                keep.append(k)
        return pa.table([pa.array(np.minimum(a[keep], b[keep]), pa.int64()), pa.array(np.maximum(a[keep], b[keep]), pa.int64())], ["a", "b"])

    return work


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every row that has a link, the smallest of a component included."""
    found = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return stored(found.unionByName(found.select("label", F.col("label").alias("id")).distinct()))


def tile_links(rows: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """rows (id, n, fam, label) -> links (a, b) that join different labels of one family.

    A family is cut into tiles of about ``TILE_GRAMS`` n-grams, rows of its largest label apart: those need no product
    among themselves. Every other pair of tiles is one task's product.
    """
    counts = rows.groupBy("fam", "label").agg(F.count(F.lit(1)).alias("m"))
    big = counts.groupBy("fam").agg(F.max_by("label", F.struct("m", "label")).alias("big"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    open_rows = stored(rows.join(big, "fam").withColumn("rest", (F.col("label") != F.col("big")).cast("long")).drop("big"))
    sized = open_rows.groupBy("fam", "rest").agg(F.ceil(F.sum("n") / TILE_GRAMS).alias("tiles"))
    dealt = open_rows.join(sized, ["fam", "rest"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")) * 2 + F.col("rest"))
    packed = dealt.join(sets, "id").select("fam", "tile", "id", "label", "grams").groupBy("fam", "tile").applyInArrow(_pack, TILE)
    packed = stored(packed)
    ends = packed.select("fam", F.col("tile").alias("t1")).join(packed.select("fam", F.col("tile").alias("t2")), "fam").where("t1 <= t2 and (t1 % 2 = 1 or t2 % 2 = 1)")
    sides = ends.withColumn("tile", F.explode(F.array_distinct(F.array("t1", "t2"))))
    return sides.join(packed, ["fam", "tile"]).groupBy("fam", "t1", "t2").applyInArrow(_multiply(threshold.numerator, threshold.denominator), "a long, b long")


def _sketched(texts: DataFrame, n: int, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """member: doc_id, t, n_shingles and the node of every row (null without a set or an id). nodes: a row per distinct set.

    Nodes are numbered, so rows that repeat an id with other texts are nodes of their own.
    """
    all_rows = stored(sketches(texts, n, threshold))
    same = ["n_shingles", "h1", "h2"]
    nodes = all_rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).dropDuplicates(same)
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()))
    member = stored(all_rows.select("doc_id", "t", *same).join(nodes.select(*same, "id"), same, "left").withColumn("id", F.when(F.col("doc_id").isNotNull(), F.col("id"))).drop("h1", "h2"))
    discard(all_rows)
    return member, nodes


def _shared(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b): each node with the first node of every column block that it shares.

    A node leaves out its most frequent blocks, as many as it can spare: two linked nodes agree on more blocks than either
    leaves out, so the rarest block that both hold is kept by both. Passages that many documents share drop out here.
    """
    spark = nodes.sparkSession
    keyed = nodes.select("id", F.explode("keys").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1"))
    release(spark)
    spare = nodes.select("id", F.explode(F.arrays_zip("classes", "spare")).alias("c")).select("id", F.col("c.classes").alias("class"), "c.spare")
    hit = keyed.join(shared, "key").withColumn("class", F.shiftrightunsigned("key", 64 - CLASS_BITS)).join(spare, ["id", "class"])
    place = F.row_number().over(Window.partitionBy("id", "class").orderBy(F.desc("often"), F.desc("key")))
    held = stored(hit.withColumn("place", place).where("place > spare").select("id", "key"))
    release(spark)
    first = held.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").drop("last")
    pairs = stored(held.join(first, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct())
    discard(shared, held)
    return pairs


def _linked_nodes(docs: DataFrame, n: int, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """member (doc_id, t, n_shingles, id: the row's node) and every link (a, b) between nodes that components need."""
    spark = docs.sparkSession
    member, nodes = _sketched(docs, n, threshold)
    release(spark)
    pairs = _shared(nodes)
    sizes = stored(nodes.select("id", F.col("n_shingles").alias("n"), "doc_id", "t"))
    discard(nodes)
    release(spark)
    if pairs.isEmpty():
        return member, pairs
    family = components(pairs).withColumnRenamed("label", "fam")
    wanted = sizes.join(family, "id").select("id", "doc_id", "t")
    sets = stored(whole_sets(docs.join(wanted, ["doc_id", "t"]), n).dropDuplicates(["id"]))  # rows that repeat are one text
    release(spark)
    edges = stored(linked(pairs, sets, threshold))
    release(spark)
    rows = sizes.select("id", "n").join(family, "id").join(components(edges), "id", "left").withColumn("label", F.coalesce("label", "id"))
    edges = edges.unionByName(stored(tile_links(rows, sets, threshold)))
    discard(sets)
    release(spark)
    return member, edges


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and t: rows of one id are told apart by the hash of their text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))


def _repeated_ids(member: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that hold one doc_id."""
    of = member.where("id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last")
    return member.join(of, "doc_id").where("id > a").select("a", F.col("id").alias("b")).distinct()


def join(docs: DataFrame, n: int = 3, threshold: Fraction = Fraction(9, 10)) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id. Rows of one id are one document, whatever their texts."""
    member, edges = _linked_nodes(_texts(docs), n, threshold)
    edges = stored(edges.unionByName(_repeated_ids(member)))
    least = member.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("least"))
    labelled = least if edges.isEmpty() else least.join(components(edges), "id", "left")
    label = F.col("id") if edges.isEmpty() else F.coalesce("label", "id")
    labelled = stored(labelled.select("id", label.alias("label"), "least"))
    named = labelled.join(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("id", "component_id")
    return member.join(named, "id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_each(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """The documents without near copies, with all columns: of each group of linked texts the smallest id stays.

    Rows of one id with texts that are not linked are in different groups. Of rows equal in id and text one stays; rows
    without an id or without words all stay.
    """
    member, edges = _linked_nodes(_texts(docs), n, threshold)
    first = F.min(F.struct("doc_id", "t")).alias("first")
    of = member.where("id is not null")
    if not edges.isEmpty():
        of = of.join(components(edges), "id", "left").withColumn("id", F.coalesce("label", "id"))
    of = of.select("doc_id", "t", "id")
    gone = of.join(of.groupBy("id").agg(first), "id").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("t") != F.col("first.t")))
    gone = stored(gone.select(F.col("doc_id").alias("_doc"), F.col("t").alias("_t")).distinct())
    whole = docs.select(F.struct("*").alias("row"))  # so that no name of theirs can clash
    doc, t = F.col("row.doc_id").cast("long"), F.xxhash64(F.coalesce("row.text", F.lit("")))
    kept = whole.join(gone, (doc == F.col("_doc")) & (t == F.col("_t")), "left_anti")
    if not of.groupBy("doc_id", "t").count().where("count > 1").isEmpty():
        keyed = kept.withColumn("_doc", doc).withColumn("_t", t).withColumn("_own", F.when(F.col("_doc").isNull() | ~F.coalesce(F.col("row.text").rlike(WORDED), F.lit(False)), F.monotonically_increasing_id()))
        kept = keyed.dropDuplicates(["_doc", "_t", "_own"])
    return kept.select("row.*")
