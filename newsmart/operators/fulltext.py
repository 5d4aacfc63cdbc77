"""Stemmed boolean matching over an inverted index built by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmart.functions.text import WORD
from newsmart.operators.joins import broadcast_if_small

# --- fixed values: English endings removed by the light stemmer, longest first ---
_ENDINGS = ["ational", "ization", "fulness", "ousness", "iveness", "tional", "ements", "ments", "ingly", "edly", "ement", "ness", "ment", "ing", "ies", "ied", "ion", "ed", "ly", "es", "s"]


def stem(word: Column) -> Column:
    """Drop the first ending that leaves at least three letters: -ies and -ied become -y, -ing and -ed undo a doubled consonant."""
    out = word
    for e in reversed(_ENDINGS):
        left = F.substr(word, F.lit(1), F.length(word) - len(e))
        if e in ("ies", "ied"):
            left = F.concat(left, F.lit("y"))
        elif e in ("ing", "ed"):
            left = F.regexp_replace(left, r"([bdfgmnprt])\1$", "$1")
        out = F.when(word.endswith(F.lit(e)) & (F.length(word) - len(e) >= 3), left).otherwise(out)
    return out


def _word_rows(df: DataFrame, column: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(rf"[{WORD}]+"), F.lit(0)))
    return df.select(*[c for c in df.columns if c != column], F.explode(found).alias("word"))


def fulltext(queries: DataFrame, articles: DataFrame, annotations: DataFrame) -> DataFrame:
    """(query_id, id, field): all rule words stem-match one text field, or any expansion term does.

    Stems are computed once per distinct word, the postings keep only stems some query asks for,
    and a match is a count over (query, group of words that must all occur).
    """
    must = queries.where(F.size("rule_words") > 0).select("query_id", F.lit("must").alias("clause"), F.array_distinct("rule_words").alias("ws"))
    may = queries.select("query_id", F.explode("expanded").alias("clause")).withColumn("ws", F.split("clause", "[ -]"))
    asked = must.unionByName(may).select("query_id", "clause", F.explode("ws").alias("word"))
    terms = asked.select("word").distinct().withColumn("stem", stem(F.col("word")))
    asked = asked.join(terms, "word").select("query_id", "clause", "stem").distinct()
    need = asked.groupBy("query_id", "clause").agg(F.count(F.lit(1)).alias("need"))
    text = articles.select("id", F.lit("article").alias("field"), F.concat_ws(" ", "title", "raw_summary").alias("txt")).unionByName(
        annotations.where(F.col("summary").isNotNull()).join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi").select(
            F.col("article_id").alias("id"), F.lit("annotation").alias("field"), F.col("summary").alias("txt")
        )
    )
    posted = _word_rows(text, "txt")
    vocab = posted.select("word").distinct().withColumn("stem", stem(F.col("word")))
    wanted = vocab.join(broadcast_if_small(asked.select("stem").distinct()), "stem")
    index = posted.join(broadcast_if_small(wanted), "word").select("id", "field", "stem").distinct()
    hits = index.join(asked, "stem").groupBy("query_id", "clause", "id", "field").agg(F.count_distinct("stem").alias("got"))
    return hits.join(need, ["query_id", "clause"]).where(F.col("got") >= F.col("need")).select("query_id", "id", "field").distinct()
