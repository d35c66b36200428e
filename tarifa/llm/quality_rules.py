"""Operator 1: quality rules by distribution divergence, in built-in functions only.

Every text gives exact base counts and two histograms: character classes and common function words. Each
histogram is held against the mean histogram of its language by Jensen-Shannon distance (base 2, 0 to 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, settle, words

#: Function words of the reference languages. Languages outside the list share one reference.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "with"],
    "fr": ["le", "la", "les", "des", "et", "un", "pour", "par", "que", "du"],
    "de": ["der", "die", "das", "und", "ein", "nicht", "mit", "von", "den", "auf"],
    "es": ["el", "los", "las", "y", "una", "con", "del", "se", "por", "al"],
}
#: Character classes, as patterns of runs to remove; white space and the rest follow by subtraction.
CLASSES = {
    "upper": "[A-Z]+",
    "lower": "[a-z]+",
    "digit": "[0-9]+",
    "symbol": r"[#*$%&|<>]+",
    "mark": r"""[!"'()+,\-./:;=?@\[\\\]^_`{}~]+""",
}
_INDEX_BITS = 26  # a text holds fewer than 2**26 words


def _removed(text: Column, pattern: str) -> Column:
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeat_words(ws: Column, hash_bits: int = 64 - _INDEX_BITS) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text.

    Window hashes and positions are packed in one long and sorted, so equal windows become neighbours; equal hashes
    are confirmed on the words themselves. In a text where two different windows share a hash, neighbours do not show
    all equal windows, so its windows are sorted by their words instead. Fewer `hash_bits` force that (tests).
    """
    mask = (1 << _INDEX_BITS) - 1
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")

    def alike(w: Column, a: Column, b: Column) -> Column:
        equal = F.get(w, a) == F.get(w, b)
        for k in (1, 2):
            equal = equal & (F.get(w, a + k) == F.get(w, b + k))
        return equal

    def same(w: Column, a: Column, b: Column) -> Column:
        return (F.shiftright(a, _INDEX_BITS) == F.shiftright(b, _INDEX_BITS)) & alike(w, place(a), place(b))

    def packed(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        if hash_bits < 64 - _INDEX_BITS:
            full, window = window, lambda i: full(i).bitwiseAND(F.lit((1 << hash_bits) - 1))
        return F.sort_array(F.transform(at, lambda i: F.shiftleft(window(i), _INDEX_BITS).bitwiseOR(i.cast("long"))))

    def by_words(w: Column) -> Column:
        """Places of the windows that occur again, all windows sorted by their words."""
        entry = lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("long").alias("i"))
        equal = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
        again = lambda s: F.filter(s, lambda x, i: equal(x, F.get(s, i + 1)) | equal(x, F.get(s, i - 1)))
        return let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), entry)), lambda s: F.transform(again(s), lambda x: x["i"]))

    def by_hash(w: Column, s: Column) -> Column:
        """Places of the windows that occur again, or null where two different windows share a hash."""
        before = lambda i: F.get(s, i - 1)
        clash = F.filter(s, lambda x, i: (
            (F.shiftright(x, _INDEX_BITS) == F.shiftright(before(i), _INDEX_BITS)) & ~alike(w, place(x), place(before(i)))
        ))
        again = F.filter(
            s,
            lambda x, i: F.coalesce(same(w, x, F.get(s, i + 1)), F.lit(False))
            | F.coalesce(same(w, x, F.get(s, i - 1)), F.lit(False)),
        )
        return F.when(F.size(clash) == 0, F.transform(again, lambda x: x.bitwiseAND(F.lit(mask))))

    def covered(places: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
        step = lambda a, x: F.struct((a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n"), x.alias("last"))
        return F.aggregate(F.sort_array(places), zero, step, lambda a: a["n"])

    found = lambda w: F.coalesce(let(packed(w), lambda s: by_hash(w, s)), by_words(w))
    return let(ws, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(covered(found(w))))


def _shares(counts: list[Column]) -> Column:
    total = sum(counts[1:], counts[0])
    return F.array(*[F.when(total > 0, c / total).otherwise(F.lit(0.0)) for c in counts])


def features(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Base counts and histograms of every row (`keep` columns pass through; nulls count as empty text)."""
    t = F.coalesce(F.col(text), F.lit(""))
    ws = words(t)
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = [F.col(c) for c in keep or []]
    one = docs.select(*kept, t.alias("_t"), F.when(F.col(lang).isin(*COMMON), F.col(lang)).otherwise("*").alias("_lang"), ws.alias("_w"))
    classes = [_removed(F.col("_t"), p) for p in CLASSES.values()]
    word_chars = F.char_length(F.regexp_replace("_t", SPACE, "")).cast("long")
    names = [w for ws_ in COMMON.values() for w in ws_]
    # how often each common word occurs: what array_remove takes away from the array of common words
    hits = let(
        F.filter(F.transform("_w", lambda w: F.lower(w)), lambda w: w.isin(*names)),
        lambda c: F.array(*[(F.size(c) - F.size(F.array_remove(c, n))).cast("long") for n in names]),
    )
    two = one.select(
        *[F.col(c) for c in keep or []],
        "_lang",
        F.size("_w").cast("long").alias("n_words"),
        word_chars.alias("word_chars"),
        F.char_length("_t").cast("long").alias("_chars"),
        F.array(*classes).alias("_classes"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
        hits.alias("_hits"),
    )
    seen = F.aggregate("_hits", F.lit(0).cast("long"), lambda a, x: a + x)
    known = F.aggregate("_classes", F.lit(0).cast("long"), lambda a, x: a + x)
    cls = [F.get("_classes", F.lit(i)) for i in range(len(CLASSES))]
    return two.select(
        *[F.col(c) for c in keep or []],
        "_lang", "n_words", "word_chars",
        F.get("_classes", F.lit(list(CLASSES).index("symbol"))).alias("n_symbols"),
        "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        _shares([*cls, F.col("_chars") - F.col("word_chars"), F.col("word_chars") - known]).alias("_class_share"),
        F.when(F.col("n_words") > 0, F.transform(F.concat("_hits", F.array(F.col("n_words") - seen)), lambda x: x / F.col("n_words"))).alias("_word_share"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of two share arrays."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    both = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2))


def judge(
    docs: DataFrame,
    keep: list[str],
    text: str = "text",
    lang: str = "lang",
    max_class: float = 0.3,
    max_word: float = 0.35,
    min_words: int = 50,
) -> DataFrame:
    """Verdict of every row: base counts, `base_failed`, both distances and `kept`.

    The references are the mean shares of all rows of a language that pass the base rules: one row a language of
    COMMON and one for the others, so the broadcast table has a fixed size. Texts under `min_words` words are not
    compared. Null text counts as empty (base_failed); null or unknown languages share one reference; repeated
    rows are judged each; an empty table gives an empty result. `keep` names the columns passed through.
    """
    f = settle(features(docs, text, lang, keep), "quality")
    n_class, n_word = len(CLASSES) + 2, sum(map(len, COMMON.values())) + 1
    mean = lambda c, n: F.array(*[F.avg(F.get(c, F.lit(i))) for i in range(n)])
    refs = f.where(~F.col("base_failed")).groupBy(F.col("_lang").alias("_ref_lang")).agg(
        mean("_class_share", n_class).alias("_class_ref"), mean("_word_share", n_word).alias("_word_ref")
    )
    j = f.join(F.broadcast(refs), F.col("_lang") == F.col("_ref_lang"), "left")
    long_enough = F.col("n_words") >= min_words
    j = j.withColumn("class_distance", F.when(long_enough, distance(F.col("_class_share"), F.col("_class_ref"))))
    j = j.withColumn("word_distance", F.when(long_enough, distance(F.col("_word_share"), F.col("_word_ref"))))
    odd = F.coalesce(F.col("class_distance") > max_class, F.lit(False)) | F.coalesce(F.col("word_distance") > max_word, F.lit(False))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return j.select(*keep, *cols, "class_distance", "word_distance", (~F.col("base_failed") & ~odd).alias("kept"))
