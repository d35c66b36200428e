"""Queries of labels, lookups, formats and search texts (CSE-*, DTE-*, FMT-01, URL-*, STR-*, FLT-*, SRT-*, VAL-01), and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as k
from ..functions import prices, search, text
from ..operators import quality, timeseries
from ..sources import tables as t
from .linkage import _T
from .queries import _assessed, _last, _moves, query

_AS_OF = "TIMESTAMP '2001-11-05'"
_TR = lambda x, d: f"translate(format('{{:,.{d}f}}', {x}), ',.', '.,')"
_LASTS = "q AS (SELECT product_id, max(scraped_at) AS seen, arg_max(price_change, [epoch(scraped_at), l_orderkey, l_linenumber]) FILTER (price_change IS NOT NULL) AS price_change, arg_max(price_change_pct, [epoch(scraped_at), l_orderkey, l_linenumber]) FILTER (price_change IS NOT NULL) AS pct FROM m GROUP BY product_id)"


@query(f""", {_LASTS}, z AS (SELECT p.*, seen, price_change, pct, date_diff('second', seen, {_AS_OF}) AS s FROM p LEFT JOIN q USING (product_id))
    SELECT product_id, CASE WHEN s >= 86400 THEN CASE WHEN s <= 259200 THEN 'amber' ELSE 'red' END END AS age, CASE WHEN s >= 86400 THEN s // 86400 END AS age_days,
    CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN 'minute' WHEN s < 86400 THEN 'hour' ELSE 'day' END AS unit, CASE WHEN s IS NULL THEN NULL WHEN s < 60 THEN 0 WHEN s < 3600 THEN s // 60 WHEN s < 86400 THEN s // 3600 ELSE s // 86400 END AS n,
    CASE WHEN price_change < 0 THEN 'down' WHEN price_change > 0 THEN 'up' ELSE 'flat' END AS trend, CASE WHEN current_price IS NULL THEN '—' ELSE '₺' || {_TR("current_price", 2)} END AS money,
    CASE WHEN pct IS NULL THEN '—' ELSE CASE WHEN pct < 0 THEN '−' WHEN pct > 0 THEN '+' ELSE '' END || '%' || {_TR("abs(pct)", 1)} END AS percent,
    CASE WHEN seen >= {_AS_OF} THEN 'today' WHEN seen >= {_AS_OF} - INTERVAL 7 DAY THEN 'week' ELSE 'older' END AS section, strftime(seen, '%d.%m') AS day,
    concat_ws(',', CASE WHEN NOT product_id % 120 - 10 BETWEEN 0 AND 100 THEN 'threshold' END, CASE WHEN NOT product_id % 1600 BETWEEN 5 AND 1440 THEN 'cooldown' END, CASE WHEN cost < 0 OR cost > 99999999 THEN 'cost' END, CASE WHEN current_price <= 0 OR current_price > 99999999 THEN 'price' END) AS invalid FROM z""", "mp")
def product_labels(spark, d):
    """CSE-03, CSE-10, DTE-02, DTE-05, FMT-01, SET-07, VAL-01."""
    latest = F.when(F.col("price_change").isNotNull(), F.struct(*timeseries.ORDER))
    last = _moves(spark, d).groupBy("product_id").agg(F.max("scraped_at").alias("seen"), F.max_by("price_change", latest).alias("price_change"), F.max_by("price_change_pct", latest).alias("pct"))
    z, i = t.tracked_products(spark, d).join(last, "product_id", "left"), F.col("product_id")
    age, ago = k.price_age(F.col("seen"), t.as_of()), k.relative_time(F.col("seen"), t.as_of())
    return z.select(
        "product_id", age["kind"].alias("age"), age["days"].alias("age_days"), F.coalesce(ago["unit"], F.lit("day")).alias("unit"), ago["n"].alias("n"), k.trend(F.col("price_change")).alias("trend"),
        k.tr_money(F.col("current_price")).alias("money"), k.tr_percent(F.col("pct"), sign=True).alias("percent"), k.day_section(F.col("seen"), t.as_of()).alias("section"), k.day_label(F.col("seen")).alias("day"),
        F.array_join(k.valid_settings(i % 120 - 10, i % 1600, F.col("cost"), F.col("current_price")), ",").alias("invalid"),
    )


@query("""SELECT product_id, seller_id, CASE WHEN match_score >= 90 THEN 'high' WHEN match_score >= 70 THEN 'good' WHEN match_score >= 40 THEN 'weak' WHEN match_score IS NOT NULL THEN 'poor' END AS band, price > 0 AS priced, (ls AND NOT po) OR (ob AND NOT po) OR po AS suspicious,
    row_number() OVER (PARTITION BY product_id ORDER BY price, seller_id) AS lowest, row_number() OVER (PARTITION BY product_id ORDER BY price DESC, seller_id) AS highest, row_number() OVER (PARTITION BY product_id ORDER BY abs(price - coalesce(own_price, price)), seller_id) AS closest FROM a""", "a")
def listing_filters(spark, d):
    """CSE-04, FLT-09, SRT-10: places in each order, listings without a price last."""
    price, w = prices.positive(F.col("price")), Window.partitionBy("product_id")
    place = lambda *order: F.row_number().over(w.orderBy(*order, "seller_id"))
    suspicious = F.arrays_overlap("issues", F.array(*[F.lit(x) for x in ("low-score", "out-of-band", "peer-outlier")]))
    return _assessed(spark, d).select(
        "product_id", "seller_id", k.score_band(F.col("match_score")).alias("band"), price.isNotNull().alias("priced"), suspicious.alias("suspicious"),
        place(F.asc_nulls_last(price)).alias("lowest"), place(F.desc_nulls_last(price)).alias("highest"), place(F.asc_nulls_last(F.abs(price - F.coalesce(F.col("own_price"), price)))).alias("closest"),
    )


@query(f"""SELECT product_id, listings, CASE WHEN usable = 0 THEN 'low' WHEN usable / listings >= 0.8 AND seen >= {_AS_OF} - INTERVAL 24 HOUR AND stale / listings <= 0.5 THEN 'strong' WHEN usable / listings >= 0.5 THEN 'cautious' ELSE 'low' END AS confidence,
    CASE WHEN usable = 0 THEN 'no-usable' WHEN own_price IS NULL THEN 'no-own-price' END AS badge, CASE WHEN usable = 0 THEN CASE WHEN status = 'PAUSED' THEN 'waiting' ELSE 'none' END WHEN own_price IS NOT NULL AND usable >= 2 THEN 'ranked' ELSE 'against' END AS label,
    CASE WHEN own_price IS NOT NULL AND usable >= 2 THEN cheaper + 1 END AS rank FROM (SELECT product_id, any_value(own_price) AS own_price, count(*) AS listings, count_if(usable) AS usable, count_if(st AND NOT po) AS stale, count_if(usable AND price < own_price) AS cheaper FROM a GROUP BY 1)
    JOIN p USING (product_id) LEFT JOIN (SELECT product_id, max(scraped_at) AS seen FROM h GROUP BY 1) USING (product_id)""", "hpa")
def listing_confidence(spark, d):
    """CSE-02, CSE-12, AGG-24: a scan has settled unless the product is paused."""
    n, own = F.count("*"), F.first("own_price")
    g = _assessed(spark, d).groupBy("product_id").agg(own.alias("own"), n.alias("listings"), F.count_if("usable").alias("usable"), F.count_if(F.array_contains("issues", "stale")).alias("stale"), F.count_if(F.col("usable") & (F.col("price") < F.col("own_price"))).alias("cheaper"))
    j = g.join(t.tracked_products(spark, d).select("product_id", "status"), "product_id").join(_last(spark, d), "product_id", "left")
    settled, fresh = F.col("status") != "PAUSED", text.hours_between(F.col("last_scraped_at"), t.as_of()) <= 24
    at = k.position(F.col("listings"), F.col("usable"), F.col("own"), settled, F.when(F.col("own") > 0, F.col("cheaper") + 1))
    return j.select("product_id", "listings", k.confidence(F.col("listings"), F.col("usable"), F.col("stale"), fresh, settled).alias("confidence"), at["badge"].alias("badge"), at["label"].alias("label"), at["rank"].alias("rank"))


_URLS = f"""v AS (SELECT product_id, seller_id, price, 'https://' || [{", ".join(f"'{x}'" for x in t.LISTING_HOSTS)}][1 + (product_id + seller_id) % {len(t.LISTING_HOSTS)}] || '/urun-adi-' || product_id || '-p-' || (product_id * 7 + seller_id % 4)
    || CASE seller_id % 3 WHEN 0 THEN '?merchantId=' || seller_id || '&x=1' WHEN 1 THEN '/' ELSE '#top' END AS url FROM c)"""
_PICK = lambda table, other: "CASE " + " ".join(f"WHEN contains(lower(url), '{x}') THEN '{n}'" for x, n in table.items()) + f" ELSE {other} END"
_HOST = "regexp_replace(lower(regexp_extract(url, '^https://([^/]+)', 1)), '^www\\.', '')"


@query(f""", {_URLS} SELECT product_id, seller_id, {_PICK(k.MARKETPLACES, "NULL")} AS marketplace, CASE {" ".join(f"WHEN host = '{x}' OR suffix(host, '.{x}') THEN '{n}'" for x, n in k.MARKETPLACES.items())} END AS strict_marketplace, {_PICK(k.RETAILERS, "'Diğer'")} AS retailer,
    {_PICK(k.RETAILERS, "'Diğer'")} IN ({", ".join(f"'{x}'" for x in k.SCRAPER_BACKED)}) AS scraper_backed, host, regexp_extract(url, 'p-(\\d+)', 1) AS content_id, nullif(regexp_extract(url, '[?&]merchantId=(\\d+)', 1), '') AS merchant_id,
    CASE WHEN contains(lower(url), 'trendyol') THEN 'Trendyol' WHEN contains(lower(url), 'hepsiburada') THEN 'Hepsiburada' WHEN contains(lower(url), 'amazon.com.tr') THEN 'Amazon TR' WHEN contains(lower(url), 'n11') THEN 'N11' WHEN contains(lower(url), 'koctas') THEN 'Koçtaş' WHEN contains(lower(url), 'gratis') THEN 'Gratis' WHEN contains(lower(url), 'akakce') THEN 'Akakçe' ELSE upper(string_split(host, '.')[1][1]) || string_split(host, '.')[1][2:] END AS store, 'Urun Adi ' || product_id AS slug FROM (SELECT *, {_HOST} AS host FROM v)""", "hc")
def url_labels(spark, d):
    """CSE-06..09, MAP-01, URL-03, URL-04, STR-18."""
    u = F.col("url")
    return t.listing_urls(spark, d).select(
        "product_id", "seller_id", k.marketplace_of(u).alias("marketplace"), k.marketplace_of(u, strict=True).alias("strict_marketplace"), k.retailer_of(u).alias("retailer"), k.is_scraper_backed(k.retailer_of(u)).alias("scraper_backed"),
        k.host_of(u).alias("host"), k.content_id(u).alias("content_id"), k.merchant_id(u).alias("merchant_id"), k.store_of(u, F.lit(""))["store"].alias("store"), search.slug_title(u).alias("slug"),
    )


_NOISY = "concat(CASE product_id % 5 WHEN 0 THEN 'İndirimli ' WHEN 1 THEN 'Orijinal, ' WHEN 2 THEN 'Hızlı Kargo ' ELSE '' END, title, CASE product_id % 4 WHEN 0 THEN ' - Trendyol' WHEN 1 THEN ', ;' ELSE ' Garantili' END)"


@query(f""", {_T}, n AS (SELECT product_id, {_NOISY} AS name FROM t), n1 AS (SELECT *, list_filter(regexp_split_to_array(name, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words, trim(array_to_string(list_filter(regexp_split_to_array(name, '\\s+'), lambda w: NOT list_contains([{", ".join(f"'{x}'" for x in search.NOISE)}], lower(translate(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]+', '', 'g'), 'İIışŞçÇğĞüÜöÖ', 'iiissccgguuoo')))), ' ')) AS clean FROM n),
    n2 AS (SELECT *, regexp_extract(name, '\\b[A-Za-z0-9](?:[A-Za-z0-9-/]){{4,}}[A-Za-z0-9]\\b') AS model, list_filter(regexp_split_to_array(name, '\\s+'), lambda w: length(w) > 1) AS w FROM n1)
    SELECT product_id, array_to_string(words, ' ') AS words, clean, product_id % 7 = 0 AS generic, array_to_string([x for x in [name, nullif(trim(regexp_replace(substr(name, 1, instr(name, model) - 1) || substr(name, instr(name, model) + length(model)), '\\s{{2,}}', ' ', 'g')), name), nullif(model, ''), w[1] || ' ' || w[-2] || ' ' || w[-1]] if x IS NOT NULL][:4], '|') AS variations,
    regexp_replace(trim(substr(name, 1, 80)), '[\\s,;:·|/-]+$', '') AS short, regexp_replace(trim(regexp_replace(name, '\\s+[|-]\\s+[^|-]*$', '')), '\\s+', ' ', 'g') AS site_free, replace(replace(name || ' <b>"A&B"</b>', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;').replace('"', '&quot;') AS html,
    coalesce(nullif(trim(CASE WHEN product_id % 3 = 0 THEN '  ' ELSE name END), ''), 'none') AS named FROM n2""", "hcp")
def search_texts(spark, d):
    """STR-06, STR-07, STR-09..11, STR-14..16, STR-18."""
    i, title = F.col("product_id"), F.col("title")
    before = F.when(i % 5 == 0, "İndirimli ").when(i % 5 == 1, "Orijinal, ").when(i % 5 == 2, "Hızlı Kargo ").otherwise("")
    name = F.concat(before, title, F.when(i % 4 == 0, " - Trendyol").when(i % 4 == 1, ", ;").otherwise(" Garantili"))
    n = F.col("name")
    return t.spread(t.titles(spark, d).select("product_id", name.alias("name"))).select(
        "product_id", F.array_join(search.words(n), " ").alias("words"), search.strip_noise(n).alias("clean"), search.is_generic(F.when(i % 7 == 0, "Trendyol - Amazon TR ürünleri").otherwise(n)).alias("generic"),
        F.array_join(search.search_variations(n), "|").alias("variations"), search.short_title(n).alias("short"), search.clean_site_title(n).alias("site_free"),
        search.escape_html(F.concat(n, F.lit(' <b>"A&B"</b>'))).alias("html"), search.text_or(F.when(i % 3 == 0, "  ").otherwise(n), "none").alias("named"),
    )


_META = ["{\"searchKeywords\": [\"%s pro\", \" \", 7, \"other thing\"]}", "{\"analysis\": {\"searchKeywords\": [\"%s x\"]}}", "{\"searchKeywords\": \"no list\"", "[]"]


@query()
def search_queries(spark, d):
    """STR-13, JSN-02: tested against a plain version."""
    i = F.col("product_id")
    meta = F.element_at(F.array(*[F.replace(F.lit(m), F.lit("%s"), F.element_at(search.words(F.col("title")), 2)) for m in _META]), (1 + i % len(_META)).cast("int"))
    return t.spread(t.titles(spark, d).select("product_id", "title", meta.alias("metadata"))).select("product_id", "title", "metadata", search.search_queries(F.when(i % 9 == 0, "").otherwise(F.col("title")), F.lit("Trendyol ürün"), F.col("metadata")).alias("queries"))


_TIMES = """CASE event_id % 6 WHEN 0 THEN (epoch(ts)::BIGINT)::VARCHAR WHEN 1 THEN (epoch_ms(ts))::VARCHAR WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 3 THEN '0' WHEN 4 THEN 'soon' ELSE '' END"""


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts) WHEN 2 THEN date_trunc('second', ts) END::TIMESTAMP AS at, CASE WHEN event_id % 6 < 3 THEN abs(epoch(CASE event_id % 6 WHEN 1 THEN date_trunc('millisecond', ts) ELSE date_trunc('second', ts) END) - epoch(ts) - 250) <= 300 END AS timely FROM events""")
def mixed_timestamps(spark, d):
    """DTE-03, DTE-04: text in Unix seconds, milliseconds or ISO form, or no time at all."""
    e, ts = t.read(spark, d, "events"), F.col("ts").cast("timestamp")
    i = F.col("event_id") % 6
    label = F.when(i == 0, F.unix_seconds(ts).cast("string")).when(i == 1, F.unix_millis(ts).cast("string")).when(i == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i == 3, "0").when(i == 4, "soon").otherwise("")
    at = k.parse_instant(label)
    return e.select("event_id", at.cast("timestamp_ntz").alias("at"), k.within_tolerance(at, ts + F.make_dt_interval(secs=F.lit(250))).alias("timely"))


#: The stores spelt out once more, for the SQL alone.
_STORES = """('trendyol','TRENDYOL','Trendyol'),('hepsiburada','HEPSIBURADA','Hepsiburada'),('amazon.com.tr','AMAZON_TR','Amazon TR'),('amazon tr','AMAZON_TR','Amazon TR'),('n11.com','N11','N11'),('n11','N11','N11'),('ciceksepeti','CICEKSEPETI','Çiçeksepeti'),
    ('pttavm','PTTAVM','PTT AVM'),('ptt avm','PTTAVM','PTT AVM'),('teknosa','TEKNOSA','Teknosa'),('mediamarkt','MEDIAMARKT','MediaMarkt'),('media markt','MEDIAMARKT','MediaMarkt'),('koctas','KOCTAS','Koçtaş'),('koçtaş','KOCTAS','Koçtaş'),('sephora','SEPHORA','Sephora'),
    ('boyner','BOYNER','Boyner'),('gratis','GRATIS','Gratis'),('watsons','WATSONS','Watsons'),('kitapyurdu','KITAPYURDU','Kitapyurdu'),('decathlon','DECATHLON','Decathlon'),('vatanbilgisayar','VATAN','Vatan'),('vatan bilgisayar','VATAN','Vatan'),('itopya','ITOPYA','İtopya'),
    ('akakce','AKAKCE','Akakçe'),('akakçe','AKAKCE','Akakçe'),('cimri','CIMRI','Cimri'),('epey','EPEY','Epey'),('migros','CUSTOM','Migros'),('carrefour','CUSTOM','CarrefourSA'),('lcwaikiki','CUSTOM','LC Waikiki'),('lc waikiki','CUSTOM','LC Waikiki'),('flo.com','CUSTOM','FLO'),
    ('nike.com','CUSTOM','Nike'),('adidas.com','CUSTOM','Adidas'),('ikea','CUSTOM','IKEA'),('karaca','CUSTOM','Karaca'),('dr.com.tr','CUSTOM','D&R'),('d&r','CUSTOM','D&R'),('bkmkitap','CUSTOM','BKM Kitap'),('idefix','CUSTOM','İdefix'),('rossmann','CUSTOM','Rossmann'),
    ('a101','CUSTOM','A101'),('sok.com','CUSTOM','ŞOK'),('şok market','CUSTOM','ŞOK'),('mavi.com','CUSTOM','Mavi'),('koton','CUSTOM','Koton'),('defacto','CUSTOM','DeFacto'),('superstep','CUSTOM','SuperStep'),('vivense','CUSTOM','Vivense'),('bellona','CUSTOM','Bellona'),
    ('madamecoco','CUSTOM','Madame Coco'),('morhipo','CUSTOM','Morhipo'),('evidea','CUSTOM','Evidea'),('electroworld','CUSTOM','Electro World')"""
_WHERE = ["Media Markt", "PTT AVM mağazası", "LC Waikiki", "D&R", "Şok Market", "Vatan Bilgisayar", "Amazon TR", "www.dr.com.tr", "A101 ve Trendyol", "bellona ev", "kendi mağazası", "Watsons", "Ikea", "IKEA"]


@query(f""", {_URLS}, s AS (SELECT row_number() OVER () AS no, * FROM (VALUES {_STORES}) x(keyword, marketplace, store)), w AS (SELECT product_id, seller_id, url, replace(url, 'trendyol', 'example') || ' ' || [{", ".join(f"'{x}'" for x in _WHERE)}][1 + (product_id + 3 * seller_id) % 14] AS both_ FROM v)
    SELECT product_id, seller_id, coalesce(arg_min(s.marketplace, no), 'CUSTOM') AS marketplace, coalesce(arg_min(s.store, no), any_value(upper(label[1]) || label[2:])) AS store FROM (SELECT *, string_split(regexp_replace(lower(regexp_extract(replace(url, 'trendyol', 'example'), '^https://([^/]+)', 1)), '^www\\.', ''), '.')[1] AS label FROM w) LEFT JOIN s ON contains(lower(both_), keyword) GROUP BY product_id, seller_id""", "hc")
def store_labels(spark, d):
    """CSE-09: the first store keyword in a listing's URL or title."""
    u = F.replace("url", F.lit("trendyol"), F.lit("example"))
    title = F.element_at(F.array(*[F.lit(x) for x in _WHERE]), (1 + (F.col("product_id") + 3 * F.col("seller_id")) % len(_WHERE)).cast("int"))
    return t.listing_urls(spark, d).select("product_id", "seller_id", F.inline(F.array(k.store_of(u, title))))
