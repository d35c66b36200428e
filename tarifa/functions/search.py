"""Search queries from titles, tolerant JSON, arrays (STR-09..18, SET-05/06, ARR-01, JSN-01..03)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import linkage
from .text import bind, collapse_ws, fold_tr, truncate_title

# Fixed values of the policies
NOISE = [
    "hediye", "hediyeli", "hediyeniz", "ucretsiz", "bedava", "kargo", "hizli", "indirim", "indirimde", "indirimli", "indirimi", "kampanya", "kampanyali",
    "firsat", "firsati", "outlet", "garanti", "garantili", "garantisi", "fatura", "faturali", "orijinal", "orjinal", "stokta", "stoklarda",
]
MARKETPLACE_WORDS = [
    "trendyol", "hepsiburada", "amazon", "tr", "n11", "pazarama", "teknosa", "vatan", "mediamarkt", "media", "markt", "decathlon", "ptt", "avm",
    "pttavm", "ciceksepeti", "akakce", "cimri", "epey", "boyner", "gratis", "watsons", "kitapyurdu", "sephora", "koctas", "itopya", "diger",
]
FILLER_WORDS = [
    "urun", "urunu", "urunler", "urunleri", "product", "products", "marka", "markasi", "model", "modeller", "modelleri", "fiyat", "fiyati", "fiyatlar", "fiyatlari",
]
_EMPTY = "array<string>"


def words(x: Column) -> Column:
    """STR-09: runs of letters and digits of any script."""
    return F.filter(F.split(x, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def strip_noise(name: Column) -> Column:
    """STR-10: the name without marketing words; the trimmed name where less than three characters would stay."""
    bare = lambda w: fold_tr(F.regexp_replace(w, r"[^\p{L}\p{N}]+", ""))
    found = F.trim(F.array_join(F.filter(F.split(name, r"\s+"), lambda w: ~bare(w).isin(NOISE)), " "))
    return bind(found, lambda kept: F.when(F.char_length(kept) >= 3, kept).otherwise(F.trim(name)))


# Placeholder names, written in one or several words
PLACEHOLDER = (
    r"(?iu)^(trendyol|hepsiburada|amazon(\s*tr)?|n11|pazarama|teknosa|vatan|media\s*markt|mediamarkt|decathlon|ptt\s*avm|çiçeksepeti|ciceksepeti|akakçe|akakce|cimri|epey|boyner|gratis|watsons|kitapyurdu|sephora|koçtaş|koctas|itopya|diğer|diger)"
    r"\s*(ürünü|urunu|product)?$"
)


def is_generic(query: Column) -> Column:
    """STR-11: too short, a placeholder, or made of names of marketplaces and filler words alone."""
    q = F.trim(query)
    return (F.char_length(q) < 3) | q.rlike(PLACEHOLDER) | F.forall(words(q), lambda w: fold_tr(w).isin(MARKETPLACE_WORDS + FILLER_WORDS))


def meaningful(x: Column) -> Column:
    return F.filter(words(fold_tr(x)), lambda w: F.char_length(w) >= 3)


def keywords(metadata: Column) -> Column:
    """JSN-02: non-blank texts of searchKeywords, or else of analysis.searchKeywords."""
    at = lambda path: F.try_variant_get(F.try_parse_json(metadata), path, "array<variant>")
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    found = F.transform(F.coalesce(at("$.searchKeywords"), at("$.analysis.searchKeywords")), text)
    return F.coalesce(F.filter(found, lambda k: F.trim(k) != ""), F.array().cast(_EMPTY))


def search_queries(name: Column, fallback: Column, metadata: Column) -> Column:
    """STR-13: at most three queries: the name without noise, brand and longest code, keywords that share a token."""
    def coded(clean: Column, codes: Column) -> Column:
        brand = F.filter(F.split(clean, r"\s+"), lambda w: (F.char_length(w) >= 2) & ~F.exists(codes, lambda c: F.lower(c) == F.lower(w)))
        return F.when(F.size(codes) > 0, F.trim(F.concat(F.array_join(F.slice(brand, 1, 2), " "), F.lit(" "), F.get(codes, F.lit(0)))))

    def of(live: Column) -> Column:
        named = bind(strip_noise(live), lambda clean: bind(linkage.codes(live), lambda codes: F.array(clean, coded(clean, codes))))
        tokens = F.when(is_generic(live), F.array().cast(_EMPTY)).otherwise(meaningful(live))
        shared = bind(tokens, lambda own: F.filter(keywords(metadata), lambda k: (F.size(own) == 0) | F.arrays_overlap(meaningful(k), own)))
        every = F.transform(F.array_compact(F.concat(named, shared)), lambda q: truncate_title(F.trim(q)))
        return F.filter(every, lambda q: ~is_generic(q))

    def first(good: Column) -> Column:
        return bind(F.transform(good, F.lower), lambda low: F.slice(F.filter(good, lambda q, i: F.array_position(low, F.lower(q)) == i + 1), 1, 3))

    # what a lambda names from outside is bound, else it would be found again for each element
    return bind(bind(F.trim(F.coalesce(F.nullif(name, F.lit("")), fallback, F.lit(""))), of), first)


def search_variations(query: Column) -> Column:
    """STR-14: the query, it without its model, the model, and first with last two words; at most four."""
    model = r"(?<![A-Za-z0-9_])([A-Za-z0-9][A-Za-z0-9/-]{4,}[A-Za-z0-9])(?![A-Za-z0-9_])"

    def without(found: Column) -> Column:
        place = F.instr(query, found)
        return F.trim(F.regexp_replace(F.concat(F.substring(query, F.lit(1), place - 1), F.substring(query, place + F.char_length(found), F.char_length(query))), r"\s{2,}", " "))

    def first(found: Column) -> Column:
        return bind(without(found), lambda x: F.array_compact(F.array(query, F.when((F.char_length(x) >= 5) & (x != query), x), found)))

    def ends(w: Column) -> Column:
        return F.when(F.size(w) >= 4, F.array_join(F.concat(F.slice(w, 1, 1), F.slice(w, -2, 2)), " "))

    def every(first: Column) -> Column:
        last = bind(F.filter(F.split(query, r"\s+"), lambda x: F.char_length(x) > 1), ends)
        return bind(last, lambda e: F.slice(F.concat(first, F.when(e.isNotNull() & ~F.array_contains(first, e), F.array(e)).otherwise(F.array().cast(_EMPTY))), 1, 4))

    return bind(bind(F.nullif(F.regexp_extract(query, model, 1), F.lit("")), first), every)


def short_title(name: Column) -> Column:
    """STR-15, DSC-10's fallback: the first 80 characters without hanging punctuation."""
    return F.regexp_replace(F.trim(F.substring(name, 1, 80)), r"[\s,;:·|/-]+$", "")


def escape_html(x: Column) -> Column:
    """STR-16."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def text_or(x: Column, default: str) -> Column:
    """STR-16: trimmed, or the default where nothing is left."""
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(default))


def clean_site_title(title: Column) -> Column:
    """STR-18: without what follows the last " - " or " | "."""
    return collapse_ws(F.regexp_replace(title, r"\s+[|-]\s+[^|-]*$", ""))


def slug_title(url: Column) -> Column:
    """STR-18: a title from the last part of a URL's path."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/([^/]+)/?$", 1)
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(last, r"-p-?\d+$", ""), "[-_]+", " ")))


def first_text(x: Column) -> Column:
    """ARR-01, EXT-14: the first text of an array that isn't blank, trimmed."""
    return F.trim(F.get(F.filter(x, lambda v: F.trim(v) != ""), F.lit(0)))


def image_of(json: Column) -> Column:
    """ARR-01: an image from a text, an object (contentUrl, url, src) or the first of an array of either."""
    v = F.try_parse_json(json)
    part = lambda path: F.try_variant_get(v, path, "string")
    is_text = F.schema_of_variant(v) == "STRING"
    paths = [p + f for p in ("$", "$[0]") for f in (".contentUrl", ".url", ".src")]
    plain = F.when(F.schema_of_variant(F.try_variant_get(v, "$[0]", "variant")) == "STRING", part("$[0]"))
    return F.coalesce(F.when(is_text, part("$")), plain, part("$.contentUrl[0]"), *[F.nullif(F.trim(part(p)), F.lit("")) for p in paths])


def not_allowed(wanted: Column, allowed: Column) -> Column:
    """SET-05, SET-06: wanted channels without the allowed ones, each once, in order."""
    return F.array_except(F.array_distinct(wanted), allowed)
