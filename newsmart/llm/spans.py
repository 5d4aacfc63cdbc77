"""Regular-expression matches with code-point positions, as DataFrame columns only.

``split`` and ``regexp_extract_all`` visit the same leftmost non-overlapping matches, so the text between matches and the
matches themselves line up; a running sum of their lengths gives every position. Only matches are shuffled, never texts.
Rows are told apart by (doc_id, hash of the text): equal rows share their result, null ids are ids.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_id", "h"]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text) with null text as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))


TAIL = 200


def lexical(text: Column) -> Column:
    """Lower-case words, without those that stand in a token with a digit or @."""
    plain = F.regexp_replace(F.lower(text), r"\S*[0-9@]\S*", " ")
    return F.filter(F.split(plain, r"[^\p{L}]+"), lambda w: w != "")


def last_words(gap: Column) -> Column:
    """The last two lexical words of a text, last one last. The end is tried first; what it cuts in two is not a word."""
    words = lexical(F.regexp_replace(F.substring(gap, -TAIL, TAIL), r"^\S+", ""))
    return F.slice(F.reverse(F.when((F.length(gap) <= TAIL) | (F.size(words) < 2), lexical(gap)).otherwise(words)), 1, 2)


def matches(docs: DataFrame, kinds: Iterable[tuple[str, str, Column]], context: bool = False) -> DataFrame:
    """kinds: (name, pattern, cheap condition a text must meet) -> doc_id, h, kind, value, start, end[, near, far].

    ``docs`` comes from ``keyed``. The condition must hold for every text with a match. With ``context``: the last word left of
    the match (near) and the one before it (far), whatever matches stand between; null where there are none.
    """
    none = F.expr("cast(array() as array<struct<kind:string,gap:int,value:string,left:array<string>>>)")
    found = []
    for name, pattern, possible in kinds:
        pairs = F.arrays_zip(F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), 0))
        left = (lambda z: last_words(z["0"])) if context else (lambda z: F.array().cast("array<string>"))
        rows = F.transform(pairs, lambda z: F.struct(F.lit(name).alias("kind"), F.length(z["0"]).alias("gap"), z["1"].alias("value"), left(z).alias("left")))  # noqa: B023 (called at once)
        found.append(F.when(possible & F.col("text").rlike(pattern), F.filter(rows, lambda r: r["value"].isNotNull())).otherwise(none))
    hit = docs.select(*KEY, F.posexplode(F.concat(*found)).alias("at", "m")).select(*KEY, "at", "m.kind", "m.gap", "m.value", "m.left").dropDuplicates([*KEY, "kind", "at"])
    line = Window.partitionBy(*KEY, "kind").orderBy("at")
    before, upto = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("value")
    start = F.coalesce(F.sum(F.col("gap") + size).over(before), F.lit(0)) + F.col("gap")
    out = hit.withColumn("start", start).withColumn("end", F.col("start") + size)
    if not context:
        return out.select(*KEY, "kind", "value", "start", "end")
    last = F.get("left", 0)
    far = F.coalesce(F.get("left", 1), F.last(last, ignorenulls=True).over(before))  # of a gap with one word: the word before that gap
    out = out.withColumn("pair", F.when(last.isNotNull(), F.struct(last.alias("near"), far.alias("far"))))
    return out.withColumn("pair", F.last("pair", ignorenulls=True).over(upto)).select(*KEY, "kind", "value", "start", "end", "pair.near", "pair.far")


def digits(column: Column) -> Column:
    return F.regexp_replace(column, "[^0-9]", "")


def joined(order: list[str], only: Column | None = None) -> Column:
    """kind:start:end of a group's spans in the given order, comma-joined; a kind's place is its ``rank``."""
    name = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    item = F.struct(*[F.col(c) for c in order], name.alias("name"))
    return F.concat_ws(",", F.transform(F.array_sort(F.collect_list(item if only is None else F.when(only, item))), lambda x: x["name"]))


def per_document(docs: DataFrame, spans: DataFrame, base_kinds: list[str], order: list[str]) -> DataFrame:
    """One row per input row: doc_id, n_<kind> per base kind, base_sha256 and spans. spans: KEY, kind, start, end, base."""
    rank = F.create_map(*[F.lit(v) for i, k in enumerate(base_kinds) for v in (k, i)])
    ranked = spans.withColumn("rank", F.coalesce(F.try_element_at(rank, F.col("kind")), F.lit(len(base_kinds))))
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in base_kinds]
    per = ranked.groupBy(*KEY).agg(*counts, joined(order, F.col("base")).alias("_base"), joined(order).alias("_all"))
    rows = docs.select(*KEY).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.h") == F.col("p.h"))
    out = rows.join(per.alias("p"), same, "left")
    zero = [F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in base_kinds]
    base, every = (F.coalesce(F.col(c), F.lit("")) for c in ("_base", "_all"))
    return out.select("d.doc_id", *zero, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def uncovered(extra: DataFrame, base: DataFrame) -> DataFrame:
    """Rows of ``extra`` that no span of ``base`` of the same document overlaps."""
    b = base.select(*[F.col(c).alias(f"_{c}") for c in (*KEY, "start", "end")])
    hit = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h")) & (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end"))
    return extra.join(b, hit, "left_anti")


def remainders(extra: DataFrame, base: DataFrame, trim: str) -> DataFrame:
    """Rows of ``extra`` without what spans of ``base`` of the same document cover: whole, or a row per piece left.

    Pieces lose characters of the class ``trim`` at their ends.
    """
    b = base.select(*[F.col(c).alias(f"_{c}") for c in (*KEY, "start", "end")])
    hit = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h")) & (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end"))
    cut = extra.join(b, hit).groupBy(*KEY, "kind", "value", "start", "end").agg(F.array_sort(F.collect_set(F.struct(F.col("_start").alias("start"), F.col("_end").alias("end")))).alias("_cuts"))
    begins = F.transform("_cuts", lambda c, i: F.greatest(F.col("start"), F.array_max(F.transform(F.slice("_cuts", 1, i), lambda x: x["end"]))))
    last = F.array_max(F.transform("_cuts", lambda c: c["end"]))
    pieces = F.concat(F.transform(F.arrays_zip(begins.alias("from"), F.col("_cuts")), lambda z: F.struct(z["from"].alias("from"), z["_cuts"]["start"].alias("to"))), F.array(F.struct(last.alias("from"), F.col("end").alias("to"))))
    rows = cut.select(*KEY, "kind", "value", "start", F.explode(pieces).alias("p")).where("p.to > p.from")
    rows = rows.select(*KEY, "kind", F.substring(F.col("value"), (F.col("p.from") - F.col("start") + 1).cast("int"), (F.col("p.to") - F.col("p.from")).cast("int")).alias("value"), F.col("p.from").alias("start"))
    rows = rows.withColumn("start", F.col("start") + F.length(F.regexp_extract("value", f"^{trim}+", 0))).withColumn("value", F.regexp_replace("value", f"^{trim}+|{trim}+$", "")).where("value <> ''")
    rows = rows.withColumn("end", F.col("start") + F.length("value"))
    return extra.join(b, hit, "left_anti").unionByName(rows.select(extra.columns))
