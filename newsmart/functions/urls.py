"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmart import lexicon as lx

# RFC 3986 appendix B split: scheme, authority, path, query, fragment
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _encode(c: Column) -> Column:
    """Percent-encode as form data; the star is encoded and the tilde is left as is."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def canonicalize_url(url: Column) -> Column:
    """Lower scheme and host, drop tracking keys and fragment, strip trailing slashes."""
    u = F.trim(url)

    def part(i: int) -> Column:
        return F.regexp_extract(u, _SPLIT, i)

    pairs = F.filter(F.split(part(4), "&"), lambda p: p != "")
    decoded = F.transform(
        pairs,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))).alias("v"),
        ),
    )
    kept = F.filter(decoded, lambda p: ~F.lower(p["k"]).isin(lx.TRACKING_KEYS))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    path = F.regexp_replace(part(3), "/+$", "")
    return F.concat(
        F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit(":"))).otherwise(F.lit("")),
        F.when((part(2) != "") | u.rlike("^[^/?#]*://"), F.concat(F.lit("//"), F.lower(part(2)))).otherwise(F.lit("")),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


def permalink(link: Column, guid: Column) -> Column:
    """The link when it is http(s), else the guid when it is, else null."""
    link, guid = F.trim(F.coalesce(link, F.lit(""))), F.trim(F.coalesce(guid, F.lit("")))
    return F.coalesce(F.when(link.rlike("^https?://"), link), F.when(guid.rlike("^https?://"), guid))
