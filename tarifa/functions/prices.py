"""Column functions over prices (NUM-*, STR-01..03)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the policies
BAND_LOW, BAND_HIGH = 0.3, 3.0
MAX_CHANGE_PCT = 90.0
MARGIN_BANDS = ((0.0, "loss"), (10.0, "thin"), (25.0, "healthy"))


def positive(x: Column) -> Column:
    """FLT-12, NUM-10: a finite value above 0, or null."""
    return F.when(~F.isnan(x) & (x > 0) & (x < float("inf")), x)


def pct_change(previous: Column, current: Column) -> Column:
    """NUM-01: null unless the previous price is above 0."""
    return F.when(previous > 0, (current - previous) / previous * 100)


def is_plausible_change(previous: Column, new: Column) -> Column:
    """NUM-02: true without a baseline; otherwise at most 90 % either way."""
    base, n = positive(previous), positive(new)
    return F.when(base.isNull() | n.isNull(), True).otherwise(F.abs((n - base) / base * 100) <= MAX_CHANGE_PCT)


def within_price_band(source: Column, candidate: Column) -> Column:
    """NUM-03: 0.3 to 3 times the source; an unknown source accepts, an unknown candidate doesn't."""
    s, c = positive(source), positive(candidate)
    return F.when(s.isNull(), True).when(c.isNull(), False).otherwise((c >= s * BAND_LOW) & (c <= s * BAND_HIGH))


def margin_band(pct: Column) -> Column:
    """NUM-05."""
    out = F.lit("strong")
    for limit, name in reversed(MARGIN_BANDS):
        out = F.when(pct < limit, name).otherwise(out)
    return F.when(pct.isNotNull(), out)


def margin_pct(price: Column, cost: Column) -> Column:
    """NUM-04: null for a price of 0 or less, a negative cost or a missing value."""
    return F.when((positive(price) > 0) & (cost >= 0) & ~F.isnan(cost), (price - cost) / price * 100)


def price_for_margin(cost: Column, pct: Column) -> Column:
    """NUM-06."""
    return F.when((cost >= 0) & (pct < 100), cost / (1 - pct / 100))


def undercut(cheapest: Column) -> Column:
    """NUM-07: one unit below the cheapest competitor, if anything is left."""
    return F.when(cheapest > 1, cheapest - 1)


def to_fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value, the larger one on ties; null stays null.

    The fraction is a whole number of 2^-52, so the rounding is done in integers; for amounts below 1e14 and two digits at most.
    """
    unit, size = 10**digits, F.abs(x)
    whole = F.floor(size)
    bits = ((size - whole) * float(1 << 52)).cast("long")
    part = F.shiftright(bits * (2 * unit) + (1 << 52), 53)
    total = (whole * unit + part).cast("long")
    tail = F.concat(F.lit("."), F.lpad((total % unit).cast("string"), digits, "0")) if digits else F.lit("")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(total / unit).cast("string"), tail)


def _last_sign(x: Column) -> Column:
    """Number text with both signs, the last of which is the decimal one."""
    return F.when(x.rlike(r",[^.]*$"), F.regexp_replace(F.replace(x, F.lit(".")), "^([^,]*),", "$1.")).otherwise(F.replace(x, F.lit(",")))


def _both_signs(x: Column) -> Column:
    return F.contains(x, F.lit(",")) & F.contains(x, F.lit("."))


def parse_price_page(text: Column) -> Column:
    """STR-02: a price label of a page, 0 when there is none. A first comma without a dot is the decimal sign."""
    x = F.regexp_replace(text, r"[^0-9.,]", "")
    comma = F.regexp_replace(x, "^([^,]*),", "$1.")
    dot = F.when(x.rlike(r"^\d*\.\d{0,2}$"), x).otherwise(F.replace(x, F.lit(".")))
    number = F.when(_both_signs(x), _last_sign(x)).when(F.contains(x, F.lit(",")), comma).otherwise(dot)
    return F.coalesce(F.regexp_extract(number, r"^\d*(?:\.\d*)?", 0).try_cast("double"), F.lit(0.0))


def parse_price_web(text: Column) -> Column:
    """STR-03: as STR-02, null when there is none."""
    return F.nullif(parse_price_page(text), F.lit(0.0))


def parse_price_search(text: Column) -> Column:
    """STR-01: the first amount beside a currency mark, else the first grouped, else the first of two digits or with decimals."""
    mark, cents = "(?:TL|TRY|₺)", r"(?:[.,]\d{1,2})?"
    grouped = rf"\d{{1,3}}(?:[.,]\d{{3}})+{cents}"
    amount = rf"(?:{grouped}|\d{{2,}}{cents})"
    beside = F.regexp_extract(text, rf"(?i)({amount}\s*{mark}|{mark}\s*{amount})", 1)
    picks = [F.regexp_extract(beside, f"({amount})", 1), F.regexp_extract(text, f"({grouped})", 1), F.regexp_extract(text, rf"(\d{{2,}}{cents}|\d+[.,]\d{{1,2}})", 1)]
    x = F.coalesce(*[F.nullif(p, F.lit("")) for p in picks])
    plain = F.when(x.rlike(r"^\d+[.,]\d{1,2}$"), F.replace(x, F.lit(","), F.lit("."))).otherwise(F.regexp_replace(x, "[.,]", ""))
    return F.when(_both_signs(x), _last_sign(x)).otherwise(plain).try_cast("double")
