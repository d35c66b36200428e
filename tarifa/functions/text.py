"""Column functions over text, URLs and times (STR-*, URL-*, DTE-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_tr(x: Column) -> Column:
    """STR-05: Turkish letters to ASCII, then lower case."""
    return F.lower(F.translate(x, "İIışŞçÇğĞüÜöÖ", "iiissccgguuoo"))


def tr_lower(x: Column) -> Column:
    """STR-07: lower case of the Turkish locale."""
    return F.lower(F.translate(x, "Iİ", "ıi"))


def collapse_ws(x: Column) -> Column:
    """STR-06."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def tokens(x: Column, least: int = 3) -> Column:
    """STR-08: folded runs of letters and digits with at least `least` characters."""
    return F.filter(F.split(fold_tr(x), "[^a-z0-9]+"), lambda t: F.char_length(t) >= least)


def truncate_title(x: Column) -> Column:
    """STR-12: more than seven words become the first six."""
    w = F.split(F.trim(x), r"\s+")
    return F.when(F.size(w) > 7, F.array_join(F.slice(w, 1, 6), " ")).otherwise(F.trim(x))


def csv_escape(x: Column) -> Column:
    """STR-17, SNK-01: quoted only where a comma, quote or line break asks for it; null is empty."""
    s = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def norm_url(u: Column) -> Column:
    """URL-02."""
    return F.lower(F.regexp_replace(u, "/$", ""))


def url_match_key(u: Column) -> Column:
    """URL-01: host without www. and path without its last slash; an invalid URL keeps its lower case."""
    def key(x: Column) -> Column:
        path = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(x, F.lit("PATH")), F.lit(""))), "/+$", "")
        host = F.regexp_replace(F.lower(F.try_parse_url(x, F.lit("HOST"))), r"^www\.", "")
        return F.coalesce(F.concat(host, path), norm_url(x))  # null only without a host

    return bind(u, key)


def short_hash(x: Column) -> Column:
    """URL-05: first 12 of MD5."""
    return F.substring(F.md5(x), 1, 12)


def hours_between(earlier: Column, later: Column) -> Column:
    """DTE-01."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 3.6e9


def freshness(hours: Column, missing: Column) -> Column:
    """CSE-01: no data first, then unknown, fresh to 24 h, ageing to 72 h, stale."""
    return F.when(missing, "no-data").when(hours.isNull(), "unknown").when(hours <= 24, "fresh").when(hours <= 72, "ageing").otherwise("stale")


def bind(value: Column, body) -> Column:
    """`body` of a value that is evaluated once and stands in the plan once, however often `body` names it.

    An aggregate over nothing, whose finish is `body`: an element of a transform would derive the type of the whole body
    for every value.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)
