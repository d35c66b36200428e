"""Column functions that compare listing titles: product codes, specs, counts, packaging, accessories (COD-*, SPC-*, QUA-04..07, MAT-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .prices import positive, within_price_band
from .text import bind, collapse_ws, fold_tr, tr_lower

# Fixed values of the policies
SHARED_HARDWARE = [
    r"^I[3579]\d{3,5}[A-Z]{0,3}$",
    r"^(RTX|GTX|GT|MX|RX|ARC)\d{3,4}[A-Z]{0,3}$",
    r"^R[3579]\d{3,4}[A-Z]{0,3}$",
    r"^\d{3,5}(U|H|HS|HX|K|KF|KS|F|G|GE|T|X3D|XT|TI|SUPER)$",
    r"^(LP)?DDR\d[A-Z]?$",
    r"^GDDR\d[A-Z]?$",
    r"^WIFI\d[A-Z]?$",
    r"^USB\d+$",
    r"^HDMI\d+$",
    r"^(BT|NFC|IP)\d{1,2}[A-Z]?$",
    r"^\d+(HZ|FPS|RPM|MAH|MHZ|GHZ|NITS?|DPI|PPI|INC|INCH|CM|MM|GB|TB|MB|ML|LT|KG|GR|W|WATT|V|A|AH|BAR|PSI|TL|P|K)$",
    r"^\d+X\d+(X\d+)?$",
]
UNITS = {"tb": ("gb", 1024), "gb": ("gb", 1), "ml": ("ml", 1), "lt": ("ml", 1000), "l": ("ml", 1000), "kg": ("g", 1000), "gr": ("g", 1), "g": ("g", 1), "w": ("w", 1), "watt": ("w", 1)}
COUNT_WORDS = ["fincan", "kisilik", "katli", "parcali", "parca", "dilim", "goz", "cekmece", "raf", "hazneli", "hazne", "tepsili", "tepsi"]
COUNT_ALIASES = {"parcali": "parca", "hazneli": "hazne", "tepsili": "tepsi"}
PACKAGING_PARTS = ["koli", "ambalaj", "mukavva", "jelatin", "paketleme", "baloncuklu", "shrink", "şirink"]
PACKAGING_NOT = ["brokoli"]
PACKAGING_PHRASES = ["kargo kutusu", "kargo poşeti", "koli bandı", "streç film", "stretch film", "e-ticaret kutusu", "ambalaj kutusu", "desi kutu"]
BOX_SIZE = r"\d+(?:[.,]\d+)?\s*[x×*]\s*\d+(?:[.,]\d+)?\s*[x×*]\s*\d+(?:[.,]\d+)?"
ACCESSORIES = [
    "cezve", "cezvesi", "kilif", "kilifi", "kapak", "kapagi", "filtre", "filtresi", "hazne", "haznesi", "yedek", "aksesuar", "aksesuari", "aksesuarlari", "adaptor",
    "adaptoru", "kablo", "kablosu", "sarj", "stand", "standi", "tutacak", "tutacagi", "firca", "fircasi", "canta", "cantasi", "koruyucu", "temperli",
]
STRONG_CODE, MIN_SCORE = 10, 70
PURGE_LOW, PURGE_HIGH = 0.2, 5.0


def _norm(code: Column) -> Column:
    return F.upper(F.replace(code, F.lit("-")))


def _coded(title: Column) -> Column:
    """COD-01: (c, n): barcodes and part numbers as written and in normal form, the longest normal form first (then by place), one of each."""
    numbers = F.regexp_extract_all(title, F.lit(r"(?<![A-Za-z0-9_])(\d{8,14})(?![A-Za-z0-9_])"), F.lit(1))
    # a part number has a digit and a letter: words without are passed over at their start
    parts = F.regexp_extract_all(title, F.lit(r"(?<![A-Za-z0-9_])(?=[A-Za-z-]*\d)(?=[0-9-]*[A-Za-z])([A-Za-z0-9][A-Za-z0-9-]{3,}[A-Za-z0-9])(?![A-Za-z0-9_])"), F.lit(1))
    named = lambda found, at: F.transform(found, lambda c, i: F.struct(c.alias("c"), _norm(c).alias("n"), (i + at).alias("i")))
    mixed = lambda n: (F.char_length(n) >= 5) & n.rlike("[A-Z]") & n.rlike(r"\d") & ~n.rlike("|".join(SHARED_HARDWARE))
    found = F.concat(named(numbers, 0), F.filter(named(parts, 1 << 20), lambda x: mixed(x["n"])))
    ranked = F.array_sort(F.transform(found, lambda x: F.struct((-F.char_length(x["n"])).alias("l"), x["i"].alias("i"), x["c"].alias("c"), x["n"].alias("n"))))
    # the first of equal normal forms stays
    first = bind(ranked, lambda r: F.when(F.size(r) < 2, r).otherwise(F.filter(r, lambda x: ~F.exists(r, lambda y: (y["n"] == x["n"]) & (y["i"] < x["i"])))))
    return F.transform(first, lambda x: F.struct(x["c"].alias("c"), x["n"].alias("n")))


def codes(title: Column) -> Column:
    """COD-01: barcodes and part numbers as written, longest normal form first (then by place), one of each normal form."""
    return F.transform(_coded(title), lambda x: x["c"])


def norms(found: Column) -> Column:
    return F.transform(found, _norm)


def _suffixes(title: Column, code: Column) -> Column:
    """Zero-led sub-numbers that follow a code in its title."""
    pattern = F.concat(F.lit(r"(?i)\Q"), code, F.lit(r"\E[\s\-–—/]+(0\d{1,3})(?![\d.,])"))
    none = F.array().cast("array<string>")
    # a pattern for each code is built only for titles that hold such a number at all
    return F.when(title.rlike(r"[\s\-–—/]0\d"), F.array_sort(F.array_distinct(F.regexp_extract_all(title, pattern, F.lit(1))))).otherwise(none)


def shares_strong_code(a: Column, b: Column) -> Column:
    """COD-02, over the codes of two titles: a common normal form of ten characters or more."""
    return F.exists(a, lambda x: (F.char_length(x["n"]) >= STRONG_CODE) & F.exists(b, lambda y: x["n"] == y["n"]))


def compare_codes(a: Column, b: Column) -> Column:
    """COD-03: config-variant, exact, color-variant or none (in this order of precedence), over the codes of two titles."""
    any_pair = lambda f: F.exists(a, lambda x: F.exists(b, lambda y: f(x, y)))
    longer = lambda m, n: F.when(F.startswith(m, n), F.substring(m, F.char_length(n) + 1, F.char_length(m))).when(
        F.startswith(n, m), F.substring(n, F.char_length(m) + 1, F.char_length(n))
    )
    grown = lambda test: any_pair(lambda x, y: (x["n"] != y["n"]) & test(longer(x["n"], y["n"])))
    return (
        F.when(any_pair(lambda x, y: (x["n"] == y["n"]) & (x["suffixes"] != y["suffixes"])) | grown(lambda e: e.rlike(r"\d")), "config-variant")
        .when(any_pair(lambda x, y: x["n"] == y["n"]), "exact").when(grown(lambda e: F.char_length(e) <= 2), "color-variant").otherwise("none")
    )


def _axes(found: Column, axis_of: dict[str, tuple[str, int]], number: str) -> Column:
    """(axis, value) of matches `number unit`; the axis of a unit and its factor by table."""
    unit = lambda m: F.regexp_extract(m, r"([a-z]+)$", 1)
    value = lambda m: F.replace(F.regexp_extract(m, number, 0), F.lit(","), F.lit(".")).try_cast("double")
    known = F.create_map(*[x for u, (axis, k) in axis_of.items() for x in (F.lit(u), F.struct(F.lit(axis).alias("axis"), F.lit(float(k)).alias("k")))])
    rows = F.transform(found, lambda m: bind(F.element_at(known, unit(m)), lambda u: F.struct(u["axis"].alias("axis"), (value(m) * u["k"]).alias("v"))))
    return F.when(F.size(found) > 0, F.array_sort(F.array_distinct(F.filter(rows, lambda r: r["v"] > 0)))).when(found.isNotNull(), F.array().cast("array<struct<axis:string,v:double>>"))


def spec_axes(title: Column) -> Column:
    """SPC-01: sorted (axis, value) of storage, volume, weight and power; values of 0 don't count."""
    units = "|".join(UNITS)
    found = F.regexp_extract_all(F.lower(title), F.lit(rf"(\d+(?:[.,]\d+)?\s*(?:{units})(?![a-z0-9_]))"), F.lit(1))
    return bind(found, lambda x: _axes(x, UNITS, r"^\d+(?:[.,]\d+)?"))


def _count_axes(folded: Column) -> Column:
    """SPC-03: sorted (axis, value) of counted parts, on folded text."""
    found = F.regexp_extract_all(folded, F.lit(rf"(\d+\s*(?:{'|'.join(COUNT_WORDS)})(?![a-z0-9_]))"), F.lit(1))
    return bind(found, lambda x: _axes(x, {w: (COUNT_ALIASES.get(w, w), 1) for w in COUNT_WORDS}, r"^\d+"))


def conflict(a: Column, b: Column) -> Column:
    """SPC-02, SET-04, over axes: one that both have with different sets of values; an axis of one side alone is none."""
    lacks = lambda x, y: F.exists(x, lambda r: F.exists(y, lambda q: q["axis"] == r["axis"]) & ~F.exists(y, lambda q: q == r))
    return (a != b) & (lacks(a, b) | lacks(b, a))


def packaging_signal(title: Column) -> Column:
    """QUA-04: a phrase, a word with a part of one (but for names of other things), or a box with its size."""
    word = rf"(?<![\p{{L}}\p{{N}}])(?![\p{{L}}\p{{N}}]*(?:{'|'.join(PACKAGING_NOT)}))[\p{{L}}\p{{N}}]*(?:{'|'.join(PACKAGING_PARTS)})"
    # most titles hold nothing of the kind, which one plain search tells
    hint = "|".join(dict.fromkeys([*PACKAGING_PARTS, *(p.split(" ")[0] for p in PACKAGING_PHRASES), "kutu"]))

    def signal(t: Column) -> Column:
        return t.rlike("|".join([*PACKAGING_PHRASES, word])) | (t.rlike(BOX_SIZE) & t.rlike(r"(^|[^\p{L}])kutu"))

    return bind(tr_lower(title), lambda low: F.when(low.rlike(hint), bind(collapse_ws(low), signal)).when(low.isNotNull(), False))


def is_packaging(candidate: Column, source: Column) -> Column:
    """QUA-04: the candidate looks like packaging and the source doesn't."""
    return packaging_signal(candidate) & ~F.coalesce(packaging_signal(source), F.lit(False))


def _accessory_words(words: Column) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in ["icin", *ACCESSORIES]]))


def _words(folded: Column) -> Column:
    return F.split(folded, "[^a-z0-9]+")


def accessory_signal(title: Column) -> Column:
    return _accessory_words(_words(fold_tr(title)))


def is_accessory(candidate: Column, source: Column) -> Column:
    """QUA-05: the candidate names a part or "for", and the source doesn't."""
    return accessory_signal(candidate) & ~F.coalesce(accessory_signal(source), F.lit(False))


def should_purge(packaging: Column, price: Column, score: Column, own: Column) -> Column:
    """QUA-06: why a stored listing goes (null: it stays); a strong score keeps a price out of the wide band."""
    weak = score.isNull() | (score < MIN_SCORE)
    out = (price < own * PURGE_LOW) | (price > own * PURGE_HIGH)
    return F.when(packaging, "packaging").when(weak & (own > 0) & (price > 0) & out, "price-out-of-band")


def healed_score(score: Column, accessory: Column, relation: Column, strong: Column, conflicting: Column) -> Column:
    """QUA-07, DSC-03: a stored strong score falls to 40 for a part and to 55 for another configuration; it never rises."""
    lower = F.when(accessory, 40).when((relation == "config-variant") | (strong & conflicting), 55)
    return F.when(score >= MIN_SCORE, F.coalesce(lower, score)).otherwise(score)


def overlap(source: Column, candidate: Column) -> Column:
    """SET-03: share of the source's tokens (repeats counted) that the candidate has; arrays of tokens."""
    return F.coalesce(F.try_divide(F.size(F.filter(source, lambda t: F.array_contains(candidate, t))), F.size(source)), F.lit(0.0))


def decide(packaging: Column, relation: Column, accessory: Column, conflicting: Column, specs: Column, strong: Column, brand: Column, price_ok: Column, share: Column) -> Column:
    """MAT-01, MAT-02: (is_match, score, reason) by the decision list; without a classifier the fallback by tokens decides."""
    verdict = lambda ok, score, why: F.struct(F.lit(ok).alias("is_match"), F.lit(score).alias("score"), F.lit(why).alias("reason"))
    coded = relation.isin("exact", "color-variant") & ~accessory
    return (
        F.when(packaging, verdict(False, 0, "packaging"))
        .when(relation == "config-variant", verdict(False, 55, "config-variant"))
        .when(coded & conflicting, verdict(False, 55, "spec-conflict"))
        .when(coded & strong, verdict(True, 95, "strong-code"))
        .when(coded & brand & price_ok, verdict(True, 90, "code-and-brand"))
        .when(brand & (share >= 0.5) & ~specs, verdict(True, MIN_SCORE - 1, "fallback"))
        .otherwise(verdict(False, 0, "no-match"))
    )


def facts(title: Column, prefix: str) -> list[Column]:
    """What the comparisons need of one title, each found once: columns to be bound before titles are compared."""
    coded = F.transform(_coded(title), lambda x: F.struct(x["n"].alias("n"), _suffixes(title, x["c"]).alias("suffixes")))
    of_words = lambda f, w: F.struct(_count_axes(f).alias("counts"), _accessory_words(w).alias("accessory"), F.filter(w, lambda x: F.char_length(x) >= 3).alias("tokens"))
    folded = bind(fold_tr(title), lambda f: bind(_words(f), lambda w: of_words(f, w)))
    return [c.alias(prefix + n) for n, c in {"codes": coded, "specs": spec_axes(title), "packaging": packaging_signal(title), "folded": folded}.items()]


def compared(a: dict[str, Column], b: dict[str, Column], price_a: Column, price_b: Column) -> list[Column]:
    """The columns that `decide`, `should_purge` and `healed_score` take, for the facts of a source and a candidate title with their prices."""
    ta, tb = a["folded"]["tokens"], b["folded"]["tokens"]
    known = positive(price_a).isNotNull() & positive(price_b).isNotNull()
    specs = conflict(a["specs"], b["specs"])
    other = lambda name: b[name] & ~F.coalesce(a[name], F.lit(False))
    in_words = lambda x: x["folded"]["accessory"]
    return [
        compare_codes(a["codes"], b["codes"]).alias("relation"), shares_strong_code(a["codes"], b["codes"]).alias("strong"),
        other("packaging").alias("packaging"), (in_words(b) & ~F.coalesce(in_words(a), F.lit(False))).alias("accessory"), specs.alias("specs"),
        (specs | conflict(a["folded"]["counts"], b["folded"]["counts"])).alias("conflicting"),
        F.coalesce(F.array_contains(tb, F.get(ta, F.lit(0))), F.lit(False)).alias("brand"), overlap(ta, tb).alias("share"),
        (~known | within_price_band(price_a, price_b)).alias("price_ok"),
    ]
