"""Spelling variants: words that differ by one code point, and the frequent form that each of them stands for.

Words are maximal runs of letters, counted over all documents. Two words that differ by one replaced letter have letter
multisets of one size at Hamming distance 2; those that differ by one letter more or less have sizes that differ by 1 and
multisets at distance 1. A multiset is a binary vector: dimension (letter, k) is set if the letter occurs more than k times.
PartEnum cuts the dimensions into parts. For distance 2 it signs every choice of all but two parts, for distance 1 every
choice of all but one; two vectors within that distance agree on a choice untouched by their differences, so an equi-join
on signatures finds every pair. Sizes go into the signatures (a word signs distance 1 as the shorter and as the longer one).
The join itself verifies: one edit leaves the first three or the last three letters alone, which rejects most candidates,
then the edit distance decides; what a signature brings together never becomes rows unless it is a pair.

Scale: words are combined before the shuffle; each is 23 narrow rows on signatures, whose groups adaptive execution splits.
Forms point to words at least ``ratio`` times as frequent, so paths are at most log(largest count) long and pointer jumping
ends after a few rounds.

Defined results: null, empty and letterless texts have no words; a null doc_id counts as the empty string in the hash that
chooses deletions; repeated rows count like any others; ties of counts go to the word first in code-point order; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmart.llm.base import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[A-Za-zÀ-ÿ]"
END = 3  # letters at either end of which one edit leaves one alone; words have at least twice as many
#: Letters dealt to the parts in turn, so that frequent ones part. Any order is right; others go to the first part.
DEALT = "enaitorhsludcgbfmzwqyxvpkjéóèñüöäßçêíàáâìòùúôîû"
FAR, CLOSE = 6, 4  # parts for distance 2 and for distance 1


def words(docs: DataFrame, least: int = 7, often: int = 2, every: int = 31) -> DataFrame:
    """(word, n) of words of at least ``least`` letters that occur ``often`` times. One run in ``every``, chosen by hash, loses a letter."""
    run = F.translate("run", UPPER, LOWER)
    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{least},}})"), 1)).alias("run"))
    d = d.select("id", run.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    d = d.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least)
    return d.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


def _parts(elements: Column, n: int) -> Column:
    """An order-free hash of the multiset's elements in each of n parts of the dimensions."""
    inside = lambda p: F.filter(elements, lambda e: F.pmod(e["d"], F.lit(n)) == p)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.aggregate(inside(p), F.lit(0).cast("long"), lambda a, e: a.bitwiseXOR(e["h"])))


def _choices(parts: str, n: int, but: int, size: Column, role: int) -> list[Column]:
    """(signature, role) of every choice of all but ``but`` of n parts."""
    return [
        F.struct(F.xxhash64(F.lit(but), F.lit(i), size, *[F.col(parts)[p] for p in chosen]).alias("sig"), F.lit(role).cast("byte").alias("role"))
        for i, chosen in enumerate(combinations(range(n), n - but))
    ]


def signatures(vocabulary: DataFrame) -> DataFrame:
    """(sig, role, word, n). Role 0: distance 2 within one size; 1 and 2: the shorter and the longer word at distance 1."""
    w = vocabulary.select("word", "n", F.array_sort(F.split("word", "")).alias("letters"))
    nth = lambda c, i: i - F.array_position("letters", c).cast("int") + 1
    element = lambda c, i: F.struct(F.xxhash64(c, nth(c, i)).alias("h"), (F.position(c, F.lit(DEALT)) + nth(c, i)).alias("d"))
    w = w.select("word", "n", F.size("letters").alias("size"), F.transform("letters", element).alias("elements"))
    w = w.select("word", "n", "size", _parts(F.col("elements"), FAR).alias("far"), _parts(F.col("elements"), CLOSE).alias("close"))
    size = F.col("size")
    every = _choices("far", FAR, 2, size, 0) + _choices("close", CLOSE, 1, size, 1) + _choices("close", CLOSE, 1, size - 1, 2)
    return w.select("word", "n", F.explode(F.array(*every)).alias("s")).select("s.sig", "s.role", "word", "n")


def near(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each unordered pair of words one inserted, deleted or replaced code point apart, once."""
    s = signatures(vocabulary)
    a, b = s.alias("a"), s.alias("b")
    word, other = F.col("a.word"), F.col("b.word")
    roles = ((F.col("a.role") == 0) & (F.col("b.role") == 0) & (word < other)) | ((F.col("a.role") == 1) & (F.col("b.role") == 2))
    first = lambda w: F.substring(w, 1, END)
    last = lambda w: F.substring(w, -END, END)
    same_end = (first(word) == first(other)) | (last(word) == last(other))
    pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & roles & same_end & (F.levenshtein(word, other, 1) == 1))
    return pairs.select(word.alias("word"), F.col("a.n").alias("n"), other.alias("other"), F.col("b.n").alias("other_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of the path of forms, by pointer jumping. Paths must not turn back."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        moved = stored(at.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def variants(docs: DataFrame, ratio: int = 10, least: int = 7, often: int = 2, every: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    form: the most frequent near word, if ``ratio`` times as frequent. ``least`` must be at least 6: the ends must not overlap.
    """
    if least < 2 * END:
        raise ValueError(f"words need {2 * END} letters")
    vocabulary = stored(words(docs, least, often, every))
    pairs = stored(near(vocabulary))
    back = pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    both = pairs.select("word", "other", "other_n").unionByName(back)
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    out = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    out = stored(out)
    ends = roots(out.where(F.col("form").isNotNull()))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
