"""Operator 2: personal data under format-preserving Feistel pseudonyms, in built-in functions only.

A value found by pattern and validated (Luhn, octets, calendar, number plans, lengths of addresses) is permuted by a
keyed Feistel network within its own format: digits stay digits, letters stay letters of their case, separators stay.
Where a permuted value would not be valid, it is permuted again until it is, so the permutation is one of the valid
values: equal values get equal pseudonyms in every document, different values of one kind and format different ones.
Texts are cut at the matches, the matches are replaced, and the parts are joined again. Patterns are possessive or
bounded, and none starts within a run of its own characters, so a search takes time in proportion to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Patterns of the kinds, tried in this order at each place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?<![0-9a-f])[0-9a-f]{32,64}(?![0-9a-f])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)",
    "date": r"(?<![\d-])(?:19|20)\d\d-\d\d-\d\d(?![\d-]*\d)",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<!\d)\+\d{1,3}[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
_SETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_HEX = ["0123456789abcdef"]
_ROUNDS = 8
_LOCAL, _HOST = 64, 253  # longest parts of a mail address
_WALK = 32  # a permuted value is valid with a chance of 0.64 at least, so no walk of any practical number fails
_DAY0, _SIDE = "1900-01-01", 283  # 200 years of days (73,049) fit in 283 * 283, with few walks outside


def _noise(*parts: Column) -> Column:
    """A number of 52 bits drawn from the keyed digest of `parts`."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 13), 16, 10).cast("long")


def _shift(ch: Column, by: Column, sets: list[str]) -> Column:
    """Move a character within its own alphabet; other characters stay."""
    out = ch
    for s in reversed(sets):
        at = F.instr(F.lit(s), ch) - 1
        out = F.when(at >= 0, F.substring(F.lit(s), F.pmod(at + by, F.lit(len(s))).cast("int") + 1, F.lit(1))).otherwise(out)
    return out


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(s)), lambda i: F.substring(s, i, F.lit(1)))


def permute(s: Column, key: str, kind: str, sets: list[str] = _SETS) -> Column:
    """Feistel network on the two halves of a string: each round moves one half's characters by the other's digest."""
    half = F.floor((F.char_length(s) + 1) / 2).cast("int")

    def keyed(part: Column, other: Column, r: Column) -> Column:
        moved = F.transform(_chars(part), lambda c, i: _shift(c, _noise(F.lit(key), F.lit(kind), r, i.cast("string"), other), sets))
        return F.when(F.char_length(part) > 0, F.array_join(moved, "")).otherwise(part)

    def step(a: Column, r: Column) -> Column:
        left = F.pmod(r, F.lit(2)) == 0
        return F.struct(
            F.when(left, keyed(a["l"], a["r"], r.cast("string"))).otherwise(a["l"]).alias("l"),
            F.when(left, a["r"]).otherwise(keyed(a["r"], a["l"], r.cast("string"))).alias("r"),
        )

    start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.char_length(s)).alias("r"))
    rounds = F.array(*[F.lit(i) for i in range(_ROUNDS)])
    return F.aggregate(rounds, start, step, lambda a: F.concat(a["l"], a["r"]))


def _walked(s: Column, key: str, kind: str, valid) -> Column:
    """Digits permuted until they are `valid` again."""
    once = lambda x: permute(x, key, kind, _SETS[:1])
    return F.aggregate(F.array_repeat(F.lit(0), _WALK), once(s), lambda a, _: F.when(valid(a), a).otherwise(once(a)))


def _plan(national: Column) -> Column:
    """Whether ten digits fit the North American plan: area and exchange start with 2 to 9."""
    return national.rlike("^[2-9][0-9]{2}[2-9]")


def _social(digits: Column) -> Column:
    """Whether nine digits are a social security number: no area 000, 666 or 9xx, group 00 or serial 0000."""
    return digits.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def _phone(m: Column, digits: Column, key: str) -> Column:
    """The last ten digits are permuted, the country's stay; numbers of +1 or of no country keep to their plan."""
    country, national = F.substring(digits, F.lit(1), F.char_length(digits) - 10), F.right(digits, F.lit(10))
    own = country.isin("", "1")
    moved = F.when(own, _walked(national, key, "phone", _plan)).otherwise(permute(national, key, "phone", _SETS[:1]))
    return F.when(own & ~_plan(national), m).otherwise(let(moved, lambda d: _refill(m, F.concat(country, d))))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit counted once."""
    n = F.char_length(digits)

    def digit(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), digit), F.lit(0), lambda a, x: a + x)


def _refill(shape: Column, digits: Column) -> Column:
    """Put `digits` where `shape` has digits, its separators staying."""
    step = lambda a, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(a["s"], F.substring(digits, a["n"] + 1, F.lit(1))).alias("s"), (a["n"] + 1).alias("n"))
    ).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["n"].alias("n")))
    return F.aggregate(_chars(shape), F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), step, lambda a: a["s"])


def _card(m: Column, key: str) -> Column:
    """Permute all digits but the last and set the last so that the Luhn sum stays right."""

    def put(d: Column) -> Column:
        body = permute(F.substring(d, F.lit(1), F.char_length(d) - 1), key, "card", _SETS[:1])
        return let(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))

    return let(F.regexp_replace(m, "[^0-9]", ""), lambda d: _refill(m, put(d)))


def _ip(m: Column, key: str) -> Column:
    """Feistel network over two halves of two octets each."""
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    o = lambda x, i: F.get(x, F.lit(i))

    def step(x: Column, r: Column) -> Column:
        other = F.concat_ws(".", o(x, 2).cast("string"), o(x, 3).cast("string"))
        move = lambda i: F.pmod(o(x, i) + _noise(F.lit(key), F.lit("ip"), r.cast("string"), F.lit(str(i)), other), F.lit(256))
        return F.array(o(x, 2), o(x, 3), move(0), move(1))

    return F.aggregate(F.array(*[F.lit(i) for i in range(_ROUNDS)]), octets, step, lambda x: F.array_join(x.cast("array<string>"), "."))


def _date(m: Column, key: str) -> Column:
    """Feistel network over the day's number in mixed radix, walked on until it lands in the 200 years again."""
    days = F.datediff(F.lit("2100-01-01").cast("date"), F.lit(_DAY0).cast("date"))

    def once(x: Column) -> Column:
        def step(a: Column, r: Column) -> Column:
            move = _noise(F.lit(key), F.lit("date"), r.cast("string"), a["r"].cast("string"))
            return F.struct(a["r"].alias("l"), F.pmod(a["l"] + move, F.lit(_SIDE)).alias("r"))

        start = F.struct(F.floor(x / _SIDE).alias("l"), F.pmod(x, F.lit(_SIDE)).alias("r"))
        return F.aggregate(F.array(*[F.lit(i) for i in range(_ROUNDS)]), start, step, lambda a: a["l"] * _SIDE + a["r"])

    first = F.datediff(F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date"), F.lit(_DAY0).cast("date")).cast("long")
    # each walk lands outside with probability 9 %; 32 walks leave no case of any practical number of dates
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(32)), once(first), lambda a, _: F.when(a >= days, once(a)).otherwise(a))
    return F.date_format(F.date_add(F.lit(_DAY0).cast("date"), walk.cast("int")), "yyyy-MM-dd")


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match, or the match itself where validation fails."""
    octets = m.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|$)){4}")
    full = lambda k: m.rlike(f"^(?:{KINDS[k]})$")
    at = F.instr(m, "@")
    host = F.regexp_extract(m, r"@(.*)\.([^.]+)$", 1)
    mail = F.concat(permute(F.substring(m, F.lit(1), at - 1), key, "email"), F.lit("@"), permute(host, key, "host"), F.lit("."), F.regexp_extract(m, r"\.([^.]+)$", 1))
    digits = F.regexp_replace(m, "[^0-9]", "")
    return (
        F.when(full("email"), F.when((at <= _LOCAL + 1) & (F.char_length(m) - at <= _HOST), mail).otherwise(m))
        .when(full("secret") & m.rlike("[a-f]"), permute(m, key, "secret", _HEX))
        .when(full("ip"), F.when(octets, _ip(m, key)).otherwise(m))
        .when(full("date"), F.when(F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).isNotNull(), _date(m, key)).otherwise(m))
        .when(full("phone"), let(digits, lambda d: _phone(m, d, key)))
        .when(full("ssn"), let(digits, lambda d: F.when(_social(d), _refill(m, _walked(d, key, "ssn", _social))).otherwise(m)))
        .when(full("card"), F.when(F.pmod(luhn_sum(digits), F.lit(10)) == 0, _card(m, key)).otherwise(m))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, keep: list[str], text: str = "text") -> DataFrame:
    """One row per row of `docs`: `keep`, text (null stays null) with its values replaced, n_replaced.

    Values that fail validation stay: a wrong Luhn digit, an octet over 255 or with a leading zero, a day that no
    calendar has, a social security number with area 000, 666 or 9xx, group 00 or serial 0000, a phone number of +1 or
    of no country whose area or exchange starts with 0 or 1, a mail address with over 64 characters before or 253
    after its sign, and runs of over 64 hexadecimal digits. The key decides the permutation; without it pseudonyms
    can't be undone. Empty texts and tables pass unchanged, repeated rows get the same result. Texts may have any length.
    """
    t = F.col(text)
    # a match needs a digit or an at sign; texts without either skip the search
    found = F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(f"({PATTERN})"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    one = docs.select(*keep, t.alias("_t"), found.alias("_m"))
    two = one.select(*keep, "_t", "_m", F.transform("_m", lambda m: pseudonym(m, key)).alias("_p"))
    gaps = F.split("_t", f"(?:{PATTERN})", -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.col("_p"), lambda g, p: F.array(g, F.coalesce(p, F.lit(""))))), "")
    changed = F.aggregate(F.zip_with("_m", "_p", lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return two.select(*keep, F.when(F.size("_m") > 0, joined).otherwise(F.col("_t")).alias("text"), F.when(F.col("_t").isNull(), 0).otherwise(changed).alias("n_replaced"))
