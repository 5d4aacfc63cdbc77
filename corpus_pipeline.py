"""A training corpus from ``documents``: language, near copies, benchmark leaks, secrets, mix.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last returns the manifest of the mixed corpus (shard, slot, source, doc_id, first_word, n_words).
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmart.llm import decontam, jaccard, langid, mixing, secretscan
from newsmart.llm.base import in_bucket, stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or that no learnt language explains, go."""
    return langid.in_known_language(docs, ~in_bucket("doc_id", 4, 2) & F.col("doc_id").isNotNull())


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word 5-grams at Jaccard 0.8 the one with the smallest id stays."""
    return jaccard.one_each(docs, 5, Fraction(4, 5))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return secretscan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights."""
    return mixing.mix(docs).manifest()


STAGES = [("language", known_language), ("near copies", one_of_near_copies), ("benchmark", without_benchmark), ("secrets", without_secrets), ("mix", mixed)]

#: The first and the last stage have no SQL; tests hold the whole against a brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
