"""Entity names, types, slugs and country codes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmart import lexicon as lx
from newsmart.functions.text import contains_any, str_map, strip, words


@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Compatibility decomposition with everything outside ASCII dropped."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())


def normalize_name(folded: Column) -> Column:
    """Matching form of an already ASCII-folded name."""
    n = F.regexp_replace(strip(F.lower(folded)), r"[^\w\s\-&.+]", "")
    w = words(n)
    kept = F.when((F.size(w) > 1) & F.element_at(w, -1).isin(lx.NAME_SUFFIXES), F.slice(w, 1, F.size(w) - 1)).otherwise(w)
    clean = F.array_join(kept, " ")
    return F.when(clean != "", clean).otherwise(strip(n))


def slug(normalized: Column, entity_type: Column) -> Column:
    s = F.replace(F.replace(F.lower(normalized), F.lit("+"), F.lit("-plus")), F.lit("&"), F.lit("and"))
    base = F.replace(strip(F.regexp_replace(s, r"[^\w\s\-]", "")), F.lit(" "), F.lit("-"))
    return F.concat(base, F.lit("-"), F.replace(F.lower(entity_type), F.lit("_"), F.lit("-")))


def normalize_type(raw: Column) -> Column:
    """Ten-type ontology: fixed map first, then ordered keyword rules."""
    r = F.lower(strip(raw))
    return (
        F.when(raw.isNull() | (raw == ""), F.lit("ORGANIZATION"))
        .otherwise(
            F.coalesce(
                F.element_at(str_map(lx.RAW_TYPE_MAP), r),
                F.when(contains_any(r, ["company", "corp"]), F.lit("COMPANY"))
                .when(r.contains("bank"), F.when(r.contains("central"), F.lit("CENTRAL_BANK")).otherwise(F.lit("COMPANY")))
                .when(contains_any(r, ["government", "ministry"]), F.lit("GOVERNMENT_BODY"))
                .when(contains_any(r, ["person", "official", "executive", "minister"]), F.lit("PERSON"))
                .when(contains_any(r, ["model", "product"]), F.lit("PRODUCT"))
                .when(contains_any(r, ["tech", "software"]), F.lit("TECHNOLOGY"))
                .when(r.contains("country"), F.lit("COUNTRY"))
                .when(r.contains("region"), F.lit("REGION"))
                .otherwise(F.lit("ORGANIZATION")),
            )
        )
    )


def _capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def family_label(c: Column) -> Column:
    """Label of a source family in any case; news when missing, the capitalised word when unknown."""
    family = F.coalesce(F.when(c != "", c), F.lit("news"))
    return F.coalesce(F.element_at(str_map(lx.FAMILY_LABELS), F.lower(family)), _capitalised(family))


def tier_label(c: Column) -> Column:
    """Label of a trust tier in any case; primary when missing, the capitalised word when unknown."""
    tier = F.coalesce(F.when(c != "", c), F.lit("primary"))
    return F.coalesce(F.element_at(str_map({k: v[0] for k, v in lx.TIER_LABELS.items()}), F.lower(tier)), _capitalised(tier))


def tier_weight(c: Column) -> Column:
    return F.coalesce(F.element_at(str_map({k: v[1] for k, v in lx.TIER_LABELS.items()}), F.lower(c)), F.lit(1))


def country_alias(c: Column) -> Column:
    return F.element_at(str_map(lx.COUNTRY_ALIASES), F.lower(strip(c)))


def is_generic_term(c: Column) -> Column:
    t = F.lower(strip(c))
    return c.isNull() | t.isin(lx.GENERIC_TERMS) | (F.length(t) <= 1)


def iso_code(c: Column, numeric: dict | None = None) -> Column:
    """ISO alpha-2 from a numeric code, a two-letter code or a name; unknown stays null."""
    s = strip(c.cast("string"))
    names = {v.lower(): k for k, v in lx.COUNTRY_NAMES.items()} | lx.COUNTRY_NAME_ALIASES
    return (
        F.when(s.rlike("^[0-9]+$"), F.element_at(str_map(numeric or lx.ISO_NUMERIC), F.lpad(s, 3, "0")))
        .when((F.length(s) == 2) & F.upper(s).isin(list(lx.COUNTRY_NAMES)), F.upper(s))
        .otherwise(F.element_at(str_map(names), F.lower(s)))
    )


def country_info(c: Column) -> Column:
    """Code and display name with the fallbacks of an unknown place."""
    s = strip(c)
    names = {v.lower(): k for k, v in lx.COUNTRY_NAMES.items()} | lx.COUNTRY_NAME_ALIASES
    by_code = F.element_at(str_map(lx.COUNTRY_NAMES), F.upper(s))
    named = F.element_at(str_map(names), F.lower(s))
    blank = c.isNull() | (c == "")
    return F.struct(
        F.when(blank, F.lit(""))
        .when(by_code.isNotNull(), F.upper(s))
        .when(named.isNotNull(), named)
        .when(F.length(s) == 2, F.upper(s))
        .otherwise(F.lit(""))
        .alias("code"),
        F.when(blank, F.lit("Global / Unknown"))
        .when(by_code.isNotNull(), by_code)
        .when(named.isNotNull(), F.element_at(str_map(lx.COUNTRY_NAMES), named))
        .when(F.length(s) > 2, F.initcap(F.lower(s)))
        .otherwise(F.upper(s))
        .alias("name"),
    )


def evidence_class(title_hit: Column, primary_hit: Column, articles: Column, sources: Column) -> Column:
    return (
        F.when(title_hit | primary_hit, F.lit("PRIMARY_EXPLICIT"))
        .when((articles >= 2) | (sources >= 2), F.lit("MULTI_ARTICLE"))
        .otherwise(F.lit("INCIDENTAL"))
    )


def entity_role(entity_type: Column, title_hit: Column, primary_hit: Column) -> Column:
    t, hit = F.upper(entity_type), title_hit | primary_hit
    return (
        F.when(t == "CENTRAL_BANK", F.lit("ISSUER"))
        .when(t.isin("COUNTRY", "REGION"), F.lit("LOCATION"))
        .when(t.isin("COMMODITY", "PRODUCT", "TECHNOLOGY"), F.lit("SUBJECT"))
        .when((t == "GOVERNMENT_BODY") & hit, F.lit("ISSUER"))
        .when(t.isin("COMPANY", "PERSON") & hit, F.lit("ACTOR"))
        .otherwise(F.lit("MENTIONED"))
    )


def link_method(title_hit: Column, primary_hit: Column, articles: Column, methods: Column) -> Column:
    return (
        F.when(title_hit, F.lit("TITLE_MATCH"))
        .when(primary_hit, F.lit("PRIMARY_ARTICLE_EXPLICIT"))
        .when(articles >= 2, F.lit("MULTI_ARTICLE_CORROBORATED"))
        .when(F.array_contains(methods, "CURATED_ALIAS"), F.lit("MANUAL_ALIAS_RESOLVED"))
        .otherwise(F.lit("STRUCTURED_ROLE"))
    )
