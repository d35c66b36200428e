"""Discovery to the end: verified prices, same-listing sellers, direct scrapes and the refresh of products (DSC-04..06, DSC-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import host_of
from ..functions.prices import positive, within_price_band
from .catalog import merged_hits, missing_listings

# Sites whose pages show no price to a plain reader, those whose pages do, and the least score that counts
SPA_DOMAINS = ("trendyol.com", "hepsiburada.com")
FETCHABLE_DOMAINS = ("cimri.com", "akakce.com", "epey.com", "n11.com", "amazon.com.tr", "pazarama.com", "mediamarkt.com.tr", "teknosa.com", "vatanbilgisayar.com", "decathlon.com.tr", "kitapyurdu.com", "pttavm.com")
LEAST_SCORE, SAME_LISTING, CHARTED, RECOVERED = 70, 10, 5, 10


def verified_price(url: Column, search_price: Column, ld_price: Column, meta_price: Column) -> Column:
    """DSC-05: (price, source): on sites whose pages can be read the page's price goes before the search's, structured data first."""
    holds = lambda domains: F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: F.contains(host_of(url), d))
    of = lambda price, source: F.struct(price.alias("price"), F.lit(source).alias("source"))
    readable = holds(FETCHABLE_DOMAINS) & ~holds(SPA_DOMAINS)
    ld, meta = positive(ld_price), positive(meta_price)
    return F.when(~readable, of(search_price, "search")).when(ld.isNotNull(), of(ld, "json-ld")).when(meta.isNotNull(), of(meta, "meta-tag")).otherwise(of(search_price, "page-failed"))


def _moved(previous: Column, price: Column, score: Column | None = None) -> Column:
    usable = F.lit(True) if score is None else score.isNull() | (score >= LEAST_SCORE)
    return F.coalesce((positive(previous) > 0) & (positive(price) > 0) & (price != previous) & usable, F.lit(False))


def same_listing(sellers: DataFrame, stored: DataFrame, most: int = SAME_LISTING) -> DataFrame:
    """DSC-04: the cheapest sellers of a product's own listing as competitors of score 100.

    `sellers` has product_id, product_url, merchant_id, seller_name and price; `stored` has product_id, url and price. A
    row is an upsert (`is_new` or not) with its row in the competitor's history; `charted` ones, the cheapest few, give
    one in the product's history as well; `moved` ones tell a change of price. Ties go by merchant.
    """
    rn = F.row_number().over(Window.partitionBy("product_id").orderBy("price", "merchant_id"))
    top = sellers.where("price IS NOT NULL").withColumn("rank", rn).where(F.col("rank") <= most)
    url = F.concat(F.regexp_replace("product_url", r"[?#].*$", ""), F.lit("?merchantId="), F.col("merchant_id").cast("string"))
    known = stored.select("product_id", "url", F.col("price").alias("previous_price"), F.lit(True).alias("_known"))
    j = top.withColumn("url", url).join(known, ["product_id", "url"], "left")
    return j.select(
        "product_id", "url", "rank", "price", "previous_price", F.lit(100).alias("match_score"), F.coalesce("seller_name", F.lit("Trendyol satıcısı")).alias("name"), F.col("_known").isNull().alias("is_new"),
        (F.col("rank") <= CHARTED).alias("charted"), F.coalesce("seller_name", F.concat(F.lit("Satıcı "), F.col("merchant_id").cast("string"))).alias("chart_name"), _moved(F.col("previous_price"), F.col("price")).alias("moved"),
    )


def direct_scrapes(scraped: DataFrame) -> DataFrame:
    """DSC-08: what a scrape of a stored competitor does: its new price (with a row in both histories), and whether it tells a move.

    `scraped` has product_id, url, previous_price, match_score, competitor_name, page_price and page_name. A scrape
    without a price fails and changes nothing; a placeholder's name gives way to the page's.
    """
    price = positive(F.col("page_price"))
    named = F.coalesce(F.nullif(F.col("competitor_name"), F.lit("")), F.lit("Manuel rakip")) != "Manuel rakip"
    name = F.when(named | price.isNull(), F.col("competitor_name")).otherwise(F.coalesce(F.left(F.nullif(F.col("page_name"), F.lit("")), F.lit(200)), F.col("competitor_name")))
    done = price.isNotNull()
    return scraped.select(
        "product_id", "url", done.alias("done"), F.coalesce(price, F.col("previous_price")).alias("price"), name.alias("name"), F.when(done, 2).otherwise(0).alias("history_rows"),
        _moved(F.col("previous_price"), price, F.col("match_score")).alias("moved"),
    )


def refresh(hits: DataFrame, listings: DataFrame, products: DataFrame, recover: int = RECOVERED) -> DataFrame:
    """DSC-06: what the refresh of products does, a row for each stored or new listing that it touches.

    The product's own price stands first; hits of the first query (each URL once, prices verified) update the listings
    that they name and become new listings when their price is plausible; of the stored listings that no hit names the
    `recover` longest unseen take the price of their page, if it has one. `hits` has product_id, query_no, position, url,
    price, ld_price and meta_price; `listings` has product_id, url, price, match_score, last_scraped_at and page_price;
    `products` has product_id and current_price. Every row that is applied writes one row to each of the two histories.
    """
    first = merged_hits(hits.where("query_no = 1"))
    checked = first.withColumn("v", verified_price(F.col("url"), F.col("price"), F.col("ld_price"), F.col("meta_price"))).select("product_id", "url", "v.price", "v.source")
    own = products.select("product_id", "current_price")
    stored = listings.select("product_id", "url", F.col("price").alias("previous_price"), "match_score", F.lit(True).alias("_known"))
    seen = checked.join(own, "product_id").join(stored, ["product_id", "url"], "left")
    valid = positive(F.col("price")).isNotNull()
    action = F.when(~valid, "no-price").when(F.col("_known"), "update").when(within_price_band(F.col("current_price"), F.col("price")), "create").otherwise("price-filtered")
    seen = seen.select("product_id", "url", action.alias("action"), "price", "source", "previous_price", "match_score")
    late = missing_listings(listings, first, recover)
    page = positive(F.col("page_price"))
    late = late.select("product_id", "url", F.when(page.isNotNull(), "recover").otherwise("lost").alias("action"), page.alias("price"), F.lit("page").alias("source"), F.col("price").alias("previous_price"), "match_score")
    both = seen.unionByName(late)
    applied = F.col("action").isin("update", "create", "recover")
    return both.withColumn("moved", applied & _moved(F.col("previous_price"), F.col("price"), F.col("match_score"))).withColumn("applied", applied)


def refresh_counters(rows: DataFrame) -> DataFrame:
    """DSC-01, DSC-06: the counters of a refresh, by product."""
    of = lambda name: F.count_if(F.col("action") == name)
    return rows.groupBy("product_id").agg(
        of("update").alias("updated"), of("create").alias("created"), of("price-filtered").alias("price_filtered"), of("no-price").alias("without_price"), of("recover").alias("recovered"), of("lost").alias("lost"),
        F.count_if("moved").alias("moves"), F.count_if("applied").alias("competitor_rows"), F.count_if("applied").alias("history_rows"), F.count_if(F.col("source").isin("json-ld", "meta-tag") & F.col("applied")).alias("verified"),
    )
