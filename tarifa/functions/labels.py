"""Labels, lookups and formats (CSE-*, DTE-02..05, FMT-01, URL-03..05, VAL-01, SET-07, SNK-11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .prices import positive
from .text import bind, hours_between

# Marketplaces by a part of the URL, in order of precedence
MARKETPLACES = {
    "trendyol.com": "TRENDYOL", "hepsiburada.com": "HEPSIBURADA", "amazon.com.tr": "AMAZON_TR", "n11.com": "N11", "pazarama.com": "PAZARAMA", "mediamarkt.com.tr": "MEDIAMARKT",
    "teknosa.com": "TEKNOSA", "vatanbilgisayar.com": "VATAN", "decathlon.com.tr": "DECATHLON", "pttavm.com": "PTTAVM", "ciceksepeti.com": "CICEKSEPETI", "akakce.com": "AKAKCE",
    "cimri.com": "CIMRI", "epey.com": "EPEY", "boyner.com.tr": "BOYNER", "watsons.com.tr": "WATSONS", "kitapyurdu.com": "KITAPYURDU", "sephora.com.tr": "SEPHORA",
    "koctas.com.tr": "KOCTAS", "itopya.com": "ITOPYA", "gratis.com": "GRATIS",
}
RETAILERS = {
    "trendyol.com": "Trendyol", "hepsiburada.com": "Hepsiburada", "amazon.com.tr": "Amazon TR", "n11.com": "N11", "pazarama.com": "Pazarama", "mediamarkt.com.tr": "MediaMarkt",
    "teknosa.com": "Teknosa", "vatanbilgisayar.com": "Vatan", "decathlon.com.tr": "Decathlon", "pttavm.com": "PTT AVM", "ciceksepeti.com": "Çiçeksepeti", "akakce.com": "Akakçe",
    "cimri.com": "Cimri", "epey.com": "Epey", "boyner.com.tr": "Boyner", "watsons.com.tr": "Watsons", "kitapyurdu.com": "Kitapyurdu", "sephora.com.tr": "Sephora",
    "koctas.com.tr": "Koçtaş", "itopya.com": "İtopya", "gratis.com": "Gratis", "grfratis.com": "Gratis",
}
SCRAPER_BACKED = ["Trendyol", "Hepsiburada", "Amazon TR", "N11", "Pazarama", "Teknosa", "Vatan", "Decathlon", "MediaMarkt", "PTT AVM"]
OTHER_RETAILER = "Diğer"
LARGEST_AMOUNT = 99_999_999


def _first_part(url: Column, table: dict[str, str], other: Column) -> Column:
    def first(u: Column) -> Column:
        out = other
        for part, name in reversed(table.items()):
            out = F.when(F.contains(u, F.lit(part)), name).otherwise(out)
        return out

    return bind(F.lower(url), first)  # else a URL would be built and lowered again for each part


def marketplace_of(url: Column, strict: bool = False) -> Column:
    """CSE-06, MAP-01: the marketplace whose domain the URL holds (`strict`: whose domain ends its host), else null."""
    if not strict:
        return _first_part(url, MARKETPLACES, F.lit(None).cast("string"))

    def ends(host: Column) -> Column:
        out = F.lit(None).cast("string")
        for domain, name in reversed(MARKETPLACES.items()):
            out = F.when((host == domain) | F.endswith(host, F.lit("." + domain)), name).otherwise(out)
        return out

    return bind(host_of(url), ends)


def retailer_of(url: Column) -> Column:
    """CSE-07."""
    return _first_part(url, RETAILERS, F.lit(OTHER_RETAILER))


def is_scraper_backed(retailer: Column) -> Column:
    """CSE-08."""
    return retailer.isin(SCRAPER_BACKED)


def host_of(url: Column) -> Column:
    """URL-04: host without www., the URL itself where it is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), url)


# Keyword, marketplace and name of stores, in the order in which they are tried
STORES = [
    ("trendyol", "TRENDYOL", "Trendyol"), ("hepsiburada", "HEPSIBURADA", "Hepsiburada"), ("amazon.com.tr", "AMAZON_TR", "Amazon TR"), ("amazon tr", "AMAZON_TR", "Amazon TR"), ("n11.com", "N11", "N11"), ("n11", "N11", "N11"),
    ("ciceksepeti", "CICEKSEPETI", "Çiçeksepeti"), ("pttavm", "PTTAVM", "PTT AVM"), ("ptt avm", "PTTAVM", "PTT AVM"), ("teknosa", "TEKNOSA", "Teknosa"), ("mediamarkt", "MEDIAMARKT", "MediaMarkt"), ("media markt", "MEDIAMARKT", "MediaMarkt"),
    ("koctas", "KOCTAS", "Koçtaş"), ("koçtaş", "KOCTAS", "Koçtaş"), ("sephora", "SEPHORA", "Sephora"), ("boyner", "BOYNER", "Boyner"), ("gratis", "GRATIS", "Gratis"), ("watsons", "WATSONS", "Watsons"), ("kitapyurdu", "KITAPYURDU", "Kitapyurdu"),
    ("decathlon", "DECATHLON", "Decathlon"), ("vatanbilgisayar", "VATAN", "Vatan"), ("vatan bilgisayar", "VATAN", "Vatan"), ("itopya", "ITOPYA", "İtopya"), ("akakce", "AKAKCE", "Akakçe"), ("akakçe", "AKAKCE", "Akakçe"), ("cimri", "CIMRI", "Cimri"),
    ("epey", "EPEY", "Epey"), ("migros", "CUSTOM", "Migros"), ("carrefour", "CUSTOM", "CarrefourSA"), ("lcwaikiki", "CUSTOM", "LC Waikiki"), ("lc waikiki", "CUSTOM", "LC Waikiki"), ("flo.com", "CUSTOM", "FLO"), ("nike.com", "CUSTOM", "Nike"),
    ("adidas.com", "CUSTOM", "Adidas"), ("ikea", "CUSTOM", "IKEA"), ("karaca", "CUSTOM", "Karaca"), ("dr.com.tr", "CUSTOM", "D&R"), ("d&r", "CUSTOM", "D&R"), ("bkmkitap", "CUSTOM", "BKM Kitap"), ("idefix", "CUSTOM", "İdefix"),
    ("rossmann", "CUSTOM", "Rossmann"), ("a101", "CUSTOM", "A101"), ("sok.com", "CUSTOM", "ŞOK"), ("şok market", "CUSTOM", "ŞOK"), ("mavi.com", "CUSTOM", "Mavi"), ("koton", "CUSTOM", "Koton"), ("defacto", "CUSTOM", "DeFacto"),
    ("superstep", "CUSTOM", "SuperStep"), ("vivense", "CUSTOM", "Vivense"), ("bellona", "CUSTOM", "Bellona"), ("madamecoco", "CUSTOM", "Madame Coco"), ("morhipo", "CUSTOM", "Morhipo"), ("evidea", "CUSTOM", "Evidea"), ("electroworld", "CUSTOM", "Electro World"),
]


def store_of(url: Column, title: Column) -> Column:
    """CSE-09: (marketplace, store) of the first keyword that the URL or title holds, else CUSTOM and the host's first part with a capital letter."""
    both = F.lower(F.concat_ws(" ", url, title))

    def first(b: Column) -> Column:
        out = F
        for k, m, n in STORES:  # the search ends at the first
            out = out.when(F.contains(b, F.lit(k)), F.struct(F.lit(m).alias("marketplace"), F.lit(n).alias("store")))
        return out

    hit = bind(both, first)
    label = F.split_part(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit("."), F.lit(1))
    capital = bind(label, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, F.lit(2), F.char_length(x))))
    name = F.coalesce(capital, F.lit("Diğer"))
    return bind(hit, lambda h: F.struct(F.coalesce(h["marketplace"], F.lit("CUSTOM")).alias("marketplace"), F.coalesce(h["store"], name).alias("store")))


def content_id(url: Column) -> Column:
    """URL-03."""
    return F.nullif(F.regexp_extract(url, r"p-(\d+)", 1), F.lit(""))


def merchant_id(url: Column) -> Column:
    """URL-03."""
    return F.nullif(F.regexp_extract(url, r"[?&]merchantId=(\d+)", 1), F.lit(""))


def sha1_key(x: Column) -> Column:
    """URL-05: first 16 of SHA-1."""
    return F.substring(F.sha1(x), 1, 16)


def score_band(score: Column) -> Column:
    """CSE-04."""
    return F.when(score >= 90, "high").when(score >= 70, "good").when(score >= 40, "weak").when(score.isNotNull(), "poor")


def price_age(seen: Column, now: Column) -> Column:
    """CSE-03: (kind, whole days) from a day on, amber up to three days, red beyond."""
    hours = hours_between(seen, now)
    kind = F.when(hours <= 72, "amber").otherwise("red")
    return F.when(hours >= 24, F.struct(kind.alias("kind"), F.floor(hours / 24).alias("days")))


def relative_time(then: Column, now: Column) -> Column:
    """DTE-02: (unit, n): now, minutes below an hour, hours below a day, then days; null for the future."""
    minutes = F.floor(hours_between(then, now) * 60 + 1e-9)
    unit = F.when(minutes < 1, "now").when(minutes < 60, "minute").when(minutes < 1440, "hour").otherwise("day")
    n = F.when(minutes < 1, 0).when(minutes < 60, minutes).when(minutes < 1440, F.floor(minutes / 60)).otherwise(F.floor(minutes / 1440))
    return F.when(minutes >= 0, F.struct(unit.alias("unit"), n.cast("long").alias("n")))


def trend(change: Column) -> Column:
    """CSE-10."""
    return F.when(change < 0, "down").when(change > 0, "up").otherwise("flat")


def confidence(listings: Column, usable: Column, stale: Column, fresh: Column, settled: Column) -> Column:
    """CSE-02: strong needs eight usable listings of ten, a fresh own price and at most half of them stale."""
    quality = usable / listings
    return (
        F.when(listings == 0, F.when(settled, "none").otherwise("waiting")).when(usable == 0, "low")
        .when((quality >= 0.8) & fresh & (stale / listings <= 0.5), "strong").when(quality >= 0.5, "cautious").otherwise("low")
    )


def position(listings: Column, usable: Column, own: Column, settled: Column, rank: Column) -> Column:
    """CSE-12: (badge, label, rank): why there is no position, and what the rank stands against."""
    none = F.when(settled, "none").otherwise("waiting")
    badge = F.when(usable == 0, F.when(listings == 0, none).otherwise("no-usable")).when(positive(own).isNull(), "no-own-price")
    label = F.when(usable == 0, none).when(rank.isNotNull() & (usable >= 2), "ranked").otherwise("against")
    return F.struct(badge.alias("badge"), label.alias("label"), F.when(label == "ranked", rank).alias("rank"))


def zero_reason(packaging: Column, price_filtered: Column, rejected: Column, unrecoverable: Column, unavailable: Column) -> Column:
    """CSE-05: why a search found nothing; of equal counts rejections first, then prices, packaging, missing prices."""
    most = F.greatest(packaging, price_filtered, rejected, unrecoverable)
    return (
        F.when((unavailable > 0) & (unavailable >= rejected), "classifier-unavailable").when(most == 0, "no-exact-match")
        .when(rejected == most, "rejected").when(price_filtered == most, "price-filtered").when(packaging == most, "packaging").otherwise("no-price")
    )


def usage(used: Column, most: Column) -> Column:
    """CSE-11: (percent, near, reached) of a limit."""
    pct = F.least(F.lit(100), F.floor(100 * F.try_divide(used, most) + 0.5))
    return F.struct(pct.alias("percent"), (pct >= 80).alias("near"), (pct >= 100).alias("reached"))


def deliberate_skip(error: Column, phrases: list[str]) -> Column:
    """CSE-13: every part of the message holds a known phrase."""
    known = lambda p: F.exists(F.array(*[F.lit(x) for x in phrases]), lambda q: F.contains(p, q))
    return F.coalesce((error != "") & F.forall(F.split(error, " · "), known), F.lit(False))


def delivery_badge(status: Column, error: Column, phrases: list[str]) -> Column:
    """CSE-13."""
    return F.when(status == "FAILED", "failed").when((status == "SKIPPED") & ~deliberate_skip(error, phrases), "channel-not-set")


def day_section(at: Column, now: Column) -> Column:
    """SET-07: today, the seven days before, older."""
    today = F.date_trunc("day", now)
    return F.when(at >= today, "today").when(at >= today - F.make_dt_interval(days=F.lit(7)), "week").otherwise("older")


def valid_settings(threshold: Column, cooldown: Column, cost: Column, price: Column) -> Column:
    """VAL-01: names of the settings out of range (nulls pass)."""
    bad = lambda c, name: F.when(c, F.lit(name))
    return F.array_compact(F.array(
        bad(~threshold.between(0, 100), "threshold"), bad(~cooldown.between(5, 1440), "cooldown"),
        bad((cost < 0) | (cost > LARGEST_AMOUNT), "cost"), bad((price <= 0) | (price > LARGEST_AMOUNT), "price"),
    ))


def parse_instant(x: Column) -> Column:
    """DTE-03: a time from Unix seconds, milliseconds (over 1e12) or ISO text; null for anything else."""
    n = F.when(x.rlike(r"^\d+$"), x.try_cast("decimal(20,0)"))
    ms = F.when(n > 1_000_000_000_000, n).otherwise(n * 1000)
    iso = F.when(x.rlike(r"^\d{4}-\d\d-\d\d"), x.try_cast("timestamp"))
    return F.when(x.rlike(r"^\d+$"), F.when((n > 0) & (ms < 8_640_000_000_000_000), F.timestamp_millis(ms.cast("long")))).otherwise(iso)


def within_tolerance(at: Column, now: Column, seconds: int = 300) -> Column:
    """DTE-04."""
    return F.abs(hours_between(at, now)) * 3600 <= seconds


def day_label(at: Column) -> Column:
    """DTE-05: dd.MM, for display only; buckets are dates."""
    return F.date_format(at, "dd.MM")


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def tr_number(x: Column, digits: int = 1) -> Column:
    """FMT-01: 1.234,5, and an em dash for null or a number that isn't finite."""
    return F.coalesce(F.translate(F.format_number(_finite(x), digits), ",.", ".,"), F.lit("—"))


def tr_money(x: Column) -> Column:
    """FMT-01."""
    return F.when(_finite(x).isNull(), "—").otherwise(F.concat(F.when(x < 0, "-₺").otherwise("₺"), tr_number(F.abs(x), 2)))


def tr_percent(x: Column, digits: int = 1, sign: bool = False) -> Column:
    """FMT-01: −%4,5, and +%4,5 with `sign`."""
    mark = F.when(x < 0, "−").when(F.lit(sign) & (x > 0), "+").otherwise("")
    return F.when(_finite(x).isNull(), "—").otherwise(F.concat(mark, F.lit("%"), tr_number(F.abs(x), digits)))


def alert_text(rule: Column, name: Column, previous: Column, current: Column, pct: Column, competitor: Column) -> Column:
    """SNK-11: title and message of an alert."""
    moved = F.concat(name, F.lit(": "), tr_money(previous), F.lit(" → "), tr_money(current), F.lit(" ("), tr_percent(pct, sign=True), F.lit(")"))
    title = (
        F.when(rule == "PRICE_DROP", "Price fell").when(rule == "PRICE_INCREASE", "Price rose").when(rule == "PERCENTAGE_CHANGE", "Price moved").when(rule == "PRICE_THRESHOLD", "Target price reached")
        .when(rule == "OUT_OF_STOCK", "Out of stock").when(rule == "BACK_IN_STOCK", "Back in stock").when(rule == "COMPETITOR_CHEAPER", "A competitor is cheaper").when(rule == "LOW_MARGIN", "Low margin").otherwise("Alert")
    )
    message = F.when(rule.isin("OUT_OF_STOCK", "BACK_IN_STOCK"), name).when(rule == "COMPETITOR_CHEAPER", F.concat(name, F.lit(": "), tr_money(competitor), F.lit(" < "), tr_money(current))).otherwise(moved)
    return F.struct(title.alias("title"), message.alias("message"))
