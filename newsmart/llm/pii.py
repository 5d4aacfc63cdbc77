"""Personal data: fixed patterns, and bootstrapped contextual extraction.

The fixed patterns give seed entities. Words left of an entity form lexical patterns (one word, two words); identifier-like
tokens elsewhere in the corpus are the other instances. In each round a pattern's confidence for a kind is the mass of its
instances of that kind (seeds count 1, discovered ones their score) over that mass, its seeds of other kinds and its
instances whose length is not the kind's (beside half to twice the seeds' mean). Unseen instances that could be of the kind
do not count against it, so what there is to discover does not keep it from being discovered. An instance scores
1 - product(1 - confidence) over its accepted patterns. After the last round, tokens of the kind's length that stand in
an accepted pattern and score high are new spans ``like_<kind>``.
The graph grows with the identifiers of the corpus, and each round is two grouped sums over it.

Defined results: null and empty texts have no spans; equal rows have equal results; null ids are kept. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmart.llm.base import stored
from newsmart.llm.spans import KEY, digits, keyed, matches, per_document, uncovered

# Possessive and anchored at the start of a run (or where the last match ended): the same matches as the plain
# patterns, in time linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"


def luhn(number: Column) -> Column:
    """Every second digit from the right is doubled; the digit sum of all must be a multiple of ten."""
    numbers = F.transform(F.split(F.reverse(number), ""), lambda c: F.ascii(c) - 48)
    worth = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_matches(docs: DataFrame, context: bool = False) -> DataFrame:
    text = F.col("text")
    digit = text.rlike("[0-9]")
    found = matches(docs, [("email", EMAIL, text.contains("@")), ("ip", IP, digit & text.contains(".")), ("card", CARD, digit), ("phone", PHONE, text.contains("+"))], context)
    value, kind = F.col("value"), F.col("kind")
    count = F.length(digits(value))
    byte = F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    good = F.when(kind == "ip", byte).when(kind == "card", F.when(count.between(16, 19), luhn(digits(value))).otherwise(False)).when(kind == "phone", count.between(8, 15)).otherwise(True)
    return found.where(good)


def _contexts(rows: DataFrame) -> DataFrame:
    """A row per lexical pattern of an occurrence: the last word to its left, and the last two."""
    two = F.when(F.col("far").isNotNull(), F.concat_ws(" ", "far", "near"))
    return rows.withColumn("pattern", F.explode(F.array_compact(F.array("near", two)))).drop("near", "far")


def bootstrap(base: DataFrame, tokens: DataFrame, rounds: int = 3, bar: float = 0.8, support: int = 5) -> DataFrame:
    """Spans of identifiers that high-confidence patterns discover. Both inputs carry ``near`` and ``far``."""
    token = F.regexp_replace("value", r"^[^\p{L}\p{N}+@]+|[^\p{L}\p{N}]+$", "")
    lead = F.length(F.regexp_extract("value", r"^[^\p{L}\p{N}+@]+", 0))
    other = uncovered(tokens, base).withColumn("start", F.col("start") + lead).withColumn("value", token).withColumn("end", F.col("start") + F.length("value")).where("value <> ''")
    seen = stored(_contexts(base.withColumn("seed", F.col("kind")).unionByName(other.withColumn("seed", F.lit(None).cast("string")))))
    edges = seen.groupBy("pattern", "value").agg(F.max("seed").alias("seed")).withColumn("len", F.length("value"))
    lengths = edges.where("seed is not null").select("value", "seed", "len").distinct().groupBy("seed").agg(F.avg("len").alias("usual")).collect()  # one row per kind
    each = [F.struct(F.lit(r["seed"]).alias("kind"), F.col("len").between(r["usual"] / 2, r["usual"] * 2).alias("fits")) for r in sorted(lengths)]
    each = F.array(*each) if each else F.expr("cast(array() as array<struct<kind:string,fits:boolean>>)")
    # what speaks for and against (pattern, kind), for patterns with a seed of any kind
    seeds = edges.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count(F.lit(1)).cast("double").alias("seeds"))
    known = seeds.groupBy("pattern").agg(F.sum("seeds").alias("all_seeds"))
    unseen = stored(edges.where("seed is null").select("pattern", "value", F.explode(each).alias("k")).select("pattern", "value", "k.kind", "k.fits"))
    against = unseen.where("not fits").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("odd"))
    score, good = None, None
    for _ in range(rounds):
        mass = seeds
        if score is not None:
            found = unseen.where("fits").join(score, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("seeds"))
            mass = mass.unionByName(found).groupBy("pattern", "kind").agg(F.sum("seeds").alias("seeds"))
        own = seeds.withColumnRenamed("seeds", "own")
        x = mass.join(own, ["pattern", "kind"], "left").join(known, "pattern", "left").join(against, ["pattern", "kind"], "left")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        contrary = zero(F.col("all_seeds")) - zero(F.col("own")) + zero(F.col("odd"))
        good = stored(x.where((F.col("seeds") >= support) & (F.col("seeds") / (F.col("seeds") + contrary) >= bar)).select("pattern", "kind", (F.col("seeds") / (F.col("seeds") + contrary + 1)).alias("conf")))
        score = stored(unseen.where("fits").join(good, ["pattern", "kind"]).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score")))
    like = F.col("kind").alias("like")
    best = seen.where("seed is null").drop("kind").join(good.select("pattern", like), "pattern").join(score.where(F.col("score") >= bar).select("value", like), ["value", "like"])
    return best.select(*KEY, F.concat(F.lit("like_"), "like").alias("kind"), "value", "start", "end").distinct()


def personal_data(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> keyed texts, and spans: doc_id, h, kind, value, start, end, base."""
    texts = keyed(docs)
    base = base_matches(texts, context=True)
    tokens = matches(texts, [("token", TOKEN, F.col("text").rlike("[0-9@]"))], context=True)
    base = stored(base)
    extra = bootstrap(base, tokens)
    return texts, base.drop("near", "far").withColumn("base", F.lit(True)).unionByName(extra.withColumn("base", F.lit(False)))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the fixed kinds, digest of their spans, and all spans."""
    texts, spans = personal_data(docs)
    return per_document(texts, spans, KINDS, ["rank", "start", "kind", "end"])
