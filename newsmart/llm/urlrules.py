"""URL filters: pattern rules found by their rarest literal token.

A rule is a host, a path prefix and an action, or a pattern over ``host + path`` with an action. Its literal
tokens (runs of letters and digits) are looked up among the tokens of all URLs, and the rule is filed under its rarest
one. A URL's tokens fetch the rules filed under them, and only those run their regular expressions. The longest rule
wins, ties to the smaller text; blocking wins over allowing for equal texts.

Each distinct URL is judged once, so a hot host costs one row per URL. Rule tables up to ``BROADCAST_RULES`` rows are
broadcast, larger ones are joined by token.

Defined results: a null URL, or one without ``://``, has empty host and path and no candidate rules, so the default
action; null page ids and repeated rows are kept. DataFrame functions only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 20_000
SEPARATORS = "[^a-z0-9]+"

#: The contract's rules: action, host, path.
HOST_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The library's own patterns, for URLs that no host rule fits: action and pattern over host + path.
PATTERN_RULES = [("block", "^spam-farm^"), ("block", "^cheap-pills^"), ("block", "^casino^"), ("block", "/login^"), ("block", "/cart^"), ("block", "^download^*.exe^")]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL as the contract states them."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def pattern_regex(pattern: str) -> str:
    """``*`` stands for any characters, ``^`` for a separator or an end; letters match in either case."""
    signs = {"*": ".*", "^": "(?:^|[^a-z0-9]|$)"}
    return "(?i)" + "".join(signs.get(c) or re.escape(c) for c in pattern)


def pattern_tokens(pattern: str) -> list[str]:
    """Tokens that every match of the pattern holds as whole tokens: those between two separators of the pattern."""
    low = pattern.lower()
    return [m[0] for m in re.finditer("[a-z0-9]+", low) if 0 < m.start() and m.end() < len(low) and "*" not in (low[m.start() - 1], low[m.end()])]


def rules_table(spark: SparkSession, host_rules: Iterable[tuple[str, str, str]] = (), pattern_rules: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """rule (text shown, null for patterns), action, regex over host + path, weight, tokens of which every match has all."""
    rows = []
    for action, host, path in host_rules:
        # every label of the host is a whole token; of the path, each token that a separator follows
        tokens = [t for t in re.split(SEPARATORS, host.lower()) if t] + [m for m in re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())]
        rows.append((host + path, action, "^(?:[^/]*\\.)?" + re.escape(host) + re.escape(path), 1_000_000 + len(host + path), tokens))
    for action, pattern in pattern_rules:
        rows.append((None, action, pattern_regex(pattern), len(pattern), pattern_tokens(pattern)))
    return spark.createDataFrame(rows, "rule string, action string, regex string, weight int, tokens array<string>")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict."""
    host, path = parts(F.col("url"))
    urls = pages.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    target = F.concat("host", "path")
    tokens = F.array_distinct(F.filter(F.split(F.lower(target), SEPARATORS), lambda t: t != ""))
    spelled = urls.select("url", target.alias("target"), F.explode(F.array_append(tokens, F.lit(""))).alias("token"))

    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    sized = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    asked = rules.select(F.explode("tokens").alias("token")).distinct()
    often = spelled.join(sized(asked), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = rules.withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))))  # no literal: tried on every URL
    rarest = filed.join(often, "token", "left").groupBy("rule", "action", "regex", "weight").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    candidates = spelled.join(sized(rarest), "token").where(F.expr("target rlike regex"))
    order = F.struct("weight", F.when(F.col("action") == "block", 1).otherwise(0).alias("firm"))
    best = candidates.groupBy("url").agg(F.max_by(F.struct("rule", "action"), order).alias("best"))
    host, path = parts(F.col("url"))
    out = pages.select("page_id", "url").join(best.withColumnRenamed("url", "_url"), F.col("url").eqNullSafe(F.col("_url")), "left")
    return out.select("page_id", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
