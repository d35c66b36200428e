"""Queries of discovery's last steps, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery
from ..sources import tables as t
from .catalog import _HITS, _hits
from .labels import _URLS
from .queries import query

_READABLE = "regexp_matches(host, 'cimri\\.com|akakce\\.com|epey\\.com|n11\\.com|amazon\\.com\\.tr|pazarama\\.com|mediamarkt\\.com\\.tr|teknosa\\.com|vatanbilgisayar\\.com|decathlon\\.com\\.tr|kitapyurdu\\.com|pttavm\\.com') AND NOT regexp_matches(host, 'trendyol\\.com|hepsiburada\\.com')"
_LD = "CASE WHEN position % 3 = 0 THEN price * 1.2 WHEN position % 3 = 1 THEN 0.0 END"
_META = "CASE WHEN position % 4 <> 0 THEN price * 0.9 END"
_CHECKED = f"""x AS (SELECT *, regexp_replace(lower(regexp_extract(url, '(?i)^https://([^/]+)', 1)), '^www\\.', '') AS host, {_LD} AS ld, {_META} AS meta FROM hits), y AS (SELECT *, {_READABLE} AS readable FROM x),
    k AS (SELECT *, CASE WHEN NOT readable THEN price WHEN ld > 0 THEN ld WHEN meta > 0 THEN meta ELSE price END AS good, CASE WHEN NOT readable THEN 'search' WHEN ld > 0 THEN 'json-ld' WHEN meta > 0 THEN 'meta-tag' ELSE 'page-failed' END AS source FROM y)"""


def _paged(spark, d):
    """Hits with the prices that their pages hold."""
    p = F.col("position")
    ld = F.when(p % 3 == 0, F.col("price") * 1.2).when(p % 3 == 1, 0.0)
    return _hits(spark, d).withColumns({"ld_price": ld, "meta_price": F.when(p % 4 != 0, F.col("price") * 0.9)})


@query(f", {_HITS}, {_CHECKED} SELECT product_id, query_no, position, good AS price, source FROM k", "hc")
def verified_prices(spark, d):
    """DSC-05."""
    v = discovery.verified_price(F.col("url"), F.col("price"), F.col("ld_price"), F.col("meta_price"))
    return _paged(spark, d).select("product_id", "query_no", "position", F.inline(F.array(v)))


@query(f""", {_URLS}, s AS (SELECT product_id, seller_id, price * (0.9 + seller_id % 3 / 10.0) AS price FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, seller_id) AS rank FROM s QUALIFY rank <= 10)
    SELECT r.product_id, 'https://www.example.com/urun-' || r.product_id || '?merchantId=' || r.seller_id AS url, rank, r.price, o.price AS previous_price, 100 AS match_score, CASE WHEN r.seller_id % 4 = 0 THEN 'Trendyol satıcısı' ELSE 'Shop ' || r.seller_id END AS name, o.price IS NULL AS is_new, rank <= 5 AS charted,
    CASE WHEN r.seller_id % 4 = 0 THEN 'Satıcı ' ELSE 'Shop ' END || r.seller_id AS chart_name, coalesce(o.price <> r.price, false) AS moved FROM r LEFT JOIN (SELECT product_id, seller_id, price FROM v WHERE seller_id % 2 = 0) o ON o.product_id = r.product_id AND o.seller_id = r.seller_id""", "hc")
def same_listing_sellers(spark, d):
    """DSC-04."""
    s = F.col("seller_id")
    v = t.listing_urls(spark, d)
    page = F.concat(F.lit("https://www.example.com/urun-"), F.col("product_id").cast("string"))
    name = F.when(s % 4 != 0, F.concat(F.lit("Shop "), s.cast("string")))
    sellers = v.select("product_id", F.concat(page, F.lit("?merchantId=1#x")).alias("product_url"), s.alias("merchant_id"), name.alias("seller_name"), (F.col("price") * (0.9 + s % 3 / 10.0)).alias("price"))
    return discovery.same_listing(sellers, v.where(s % 2 == 0).select("product_id", F.concat(page, F.lit("?merchantId="), s.cast("string")).alias("url"), "price"))


@query(f""", {_URLS}, s AS (SELECT v.*, match_score, CASE seller_id % 5 WHEN 0 THEN NULL WHEN 1 THEN v.price ELSE v.price * 1.1 END AS page FROM v JOIN c USING (product_id, seller_id))
    SELECT product_id, url, page IS NOT NULL AS done, coalesce(page, price) AS price, CASE WHEN seller_id % 3 = 0 AND page IS NOT NULL THEN 'Page ' || seller_id WHEN seller_id % 3 = 0 THEN 'Manuel rakip' ELSE 'Rival' END AS name, CASE WHEN page IS NULL THEN 0 ELSE 2 END AS history_rows,
    coalesce(page <> price AND (match_score IS NULL OR match_score >= 70), false) AS moved FROM s""", "hc")
def direct_scrapes(spark, d):
    """DSC-08."""
    s = F.col("seller_id")
    v = t.listing_urls(spark, d)
    return discovery.direct_scrapes(v.select(
        "product_id", "url", F.col("price").alias("previous_price"), "match_score", F.when(s % 3 == 0, "Manuel rakip").otherwise("Rival").alias("competitor_name"),
        F.when(s % 5 == 1, F.col("price")).when(s % 5 != 0, F.col("price") * 1.1).alias("page_price"), F.concat(F.lit("Page "), s.cast("string")).alias("page_name"),
    ))


@query(f""", {_HITS}, {_CHECKED}, f AS (SELECT * FROM k WHERE query_no = 1 QUALIFY row_number() OVER (PARTITION BY product_id, lower(regexp_replace(url, '/$', '')) ORDER BY query_no, position) = 1),
    l AS (SELECT v.*, match_score, last_scraped_at, CASE WHEN v.seller_id % 2 = 0 THEN v.price * 0.95 END AS page FROM v JOIN c USING (product_id, seller_id) WHERE v.seller_id % 7 <> 0),
    a AS (SELECT f.product_id, f.good AS price, f.source, l.price AS previous_price, l.match_score, CASE WHEN l.price IS NOT NULL THEN 'update' WHEN current_price IS NULL OR f.good BETWEEN 0.3 * current_price AND 3 * current_price THEN 'create' ELSE 'price-filtered' END AS action FROM f JOIN p ON p.product_id = f.product_id LEFT JOIN l ON l.product_id = f.product_id AND l.url = f.url
    UNION ALL SELECT product_id, page, 'page', price, match_score, CASE WHEN page IS NULL THEN 'lost' ELSE 'recover' END FROM (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.product_id = l.product_id AND f.url = l.url) QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY last_scraped_at NULLS FIRST, url) <= 10))
    SELECT product_id, count_if(action = 'update') AS updated, count_if(action = 'create') AS created, count_if(action = 'price-filtered') AS price_filtered, 0 AS without_price, count_if(action = 'recover') AS recovered, count_if(action = 'lost') AS lost,
    count_if(action IN ('update', 'create', 'recover') AND price <> previous_price AND (match_score IS NULL OR match_score >= 70)) AS moves, count_if(action IN ('update', 'create', 'recover')) AS competitor_rows, count_if(action IN ('update', 'create', 'recover')) AS history_rows,
    count_if(action IN ('update', 'create') AND source IN ('json-ld', 'meta-tag')) AS verified FROM a GROUP BY product_id""", "hpc")
def product_refresh(spark, d):
    """DSC-01, DSC-05, DSC-06: the counters of a refresh of every product; listings of sellers divisible by 7 aren't stored yet."""
    v = t.listing_urls(spark, d).where("seller_id % 7 <> 0").withColumn("page_price", F.when(F.col("seller_id") % 2 == 0, F.col("price") * 0.95))
    return discovery.refresh_counters(discovery.refresh(_paged(spark, d), v, t.tracked_products(spark, d)))
