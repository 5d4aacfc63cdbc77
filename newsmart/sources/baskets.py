"""Reference baskets as small frames; their size is fixed by the lists themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmart import lexicon as lx
from newsmart.functions import markets


def instrument_rows() -> list[tuple]:
    """(canonical_id, region, asset_class, display_name, currency)"""
    index = [(symbol, region, "EQUITY_INDEX", name, cur) for region, name, symbol, cur in lx.INDEX_BASKET]
    return index + [(cid, cat, cls, name, cur) for cid, cat, cls, name, cur in lx.CROSS_ASSET_BASKET]


def instruments(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(instrument_rows())]
    return spark.createDataFrame(rows, "k INT, canonical_id STRING, region STRING, asset_class STRING, display_name STRING, currency STRING")


def yields(spark: SparkSession) -> DataFrame:
    y = spark.createDataFrame(lx.YIELD_BASKET, "instrument_id STRING, country STRING, y DOUBLE, prev DOUBLE")
    return y.select("instrument_id", "country", markets.yield_change(F.col("y"), F.col("prev")).alias("r")).select("instrument_id", "country", "r.*")


def policies(spark: SparkSession) -> DataFrame:
    p = spark.createDataFrame(lx.POLICY_BASKET, "central_bank STRING, rate DOUBLE, prev DOUBLE, lower DOUBLE, upper DOUBLE, prev_lower DOUBLE")
    act = markets.policy_action(F.col("rate"), F.col("prev"), F.col("lower"), F.col("upper"), F.col("prev_lower"))
    return p.select("central_bank", "rate", "lower", "upper", act.alias("r")).select("central_bank", "rate", "lower", "upper", "r.*")
