"""Source tables and the domain views over them (one table day counts as 480 seconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AS_OF = "2001-11-05 00:00:00"
RULE_TYPES = [
    "PRICE_DROP", "PRICE_INCREASE", "PRICE_THRESHOLD", "PERCENTAGE_CHANGE", "OUT_OF_STOCK",
    "BACK_IN_STOCK", "COMPETITOR_CHEAPER", "COMPETITOR_PRICE_CHANGE", "LOW_MARGIN",
]


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """SRC-01: a lazy scan; filters and columns chosen later reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small file dealt to all cores: a narrow table has one task for 128 MB, however costly its rows are."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


#: Rows of a history that one task holds and sorts, if no product has more.
ROWS_A_TASK = 250_000


def parts(history: DataFrame, rows_a_task: int = ROWS_A_TASK) -> int:
    """Into how many parts a history is dealt; its rows are counted from the footers of its files."""
    return max(history.sparkSession.sparkContext.defaultParallelism, history.count() // rows_a_task + 1)


def dealt(history: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """A history dealt by product into as many parts as its rows ask for, so a task's sorts don't grow with the table.

    What is grouped, windowed or joined by product and more keys afterwards stays in its part.
    """
    return history.repartition(parts(history, rows_a_task), "product_id")


def tracked_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    status = F.when(k % 10 == 0, "PAUSED").when(k % 10 == 1, "ERROR").when(k % 10 == 2, "OUT_OF_STOCK").otherwise("ACTIVE")
    return read(spark, sf_dir, "part").select(
        k.alias("product_id"), (k % 50).alias("user_id"), F.concat_ws(" ", "p_name", "p_brand").alias("product_name"),
        F.col("p_type").alias("marketplace"),
        F.when(k % 29 != 0, F.col("p_retailprice")).alias("current_price"),
        F.when(k % 7 != 0, F.col("p_retailprice") * (60 + F.col("p_size")) / 100.0).alias("cost"),
        status.alias("status"),
    )


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.lit("2001-11-05").cast("date"), F.col("l_shipdate").cast("date"))
    ts = as_of() - F.make_dt_interval(secs=480 * days)
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), ts.alias("scraped_at"),
        (F.col("l_returnflag") != "R").alias("in_stock"), "l_orderkey", "l_linenumber",
    )


def is_own() -> Column:
    """Whether a row of the history is the owner's own listing: one of four sellers of each product."""
    return (F.col("product_id") + F.col("seller_id")) % 4 == 0


def newest(history: DataFrame, keys: list[str], n: int = 1) -> DataFrame:
    """WIN-01, WIN-05: the newest n rows of each key (Spark prunes with a group limit before the shuffle)."""
    order = [F.desc(c) for c in ("scraped_at", "l_orderkey", "l_linenumber")]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return history.withColumn("rn", rn).where(F.col("rn") <= n)


def competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest observation of every product and seller, over the dealt history.

    Most pairs are seen once, so a maximum with a map side would sort every task's share of the file and move as many rows.
    """
    p, s = F.col("product_id"), F.col("seller_id")
    score = F.when((p + s) % 6 != 0, 40 + (p * 31 + s * 17) % 61)
    last = F.max(F.struct("scraped_at", "l_orderkey", "l_linenumber", "price")).alias("r")
    return dealt(price_history(spark, sf_dir)).groupBy("product_id", "seller_id").agg(last).select(
        p, s, F.col("r.price").alias("price"), score.alias("match_score"), F.col("r.scraped_at").alias("last_scraped_at")
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    plan = F.when(k % 4 == 0, "FREE").when(k % 4 == 1, "STARTER").when(k % 4 == 2, "PRO").otherwise("ENTERPRISE")
    expires = F.when(k % 3 != 0, as_of() + F.make_dt_interval(days=(k % 21 - 10).cast("int")))
    return read(spark, sf_dir, "customer").select(
        k.alias("user_id"), plan.alias("plan"), F.when(k % 5 == 0, "EXPIRED").otherwise("ACTIVE").alias("plan_status"),
        expires.alias("plan_expires_at"), (k % 11).cast("double").alias("alert_threshold_pct"),
    )


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "SENT").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("SKIPPED")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("date").alias("sent_at"),
        status.alias("status"), F.col("o_orderpriority").alias("rule_type"), (F.col("o_orderkey") % 3 == 0).alias("is_read"),
        F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("no channel "), (F.col("o_orderkey") % 3).cast("string"))).alias("error"),
    )


def product_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.explode(F.array_distinct(F.array((F.col("p_partkey") % 25).cast("long"), (F.col("p_size") % 25).cast("long"))))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), tag.alias("tag_id"))


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One global rule per (user, type) of 50 users; overrides for products divisible by 13, inactive for 26."""
    kinds = F.explode(F.array(*[F.lit(r) for r in RULE_TYPES])).alias("rule_type")
    everyone = read(spark, sf_dir, "customer").where("c_custkey < 50").select(F.col("c_custkey").alias("user_id"), F.lit(None).cast("long").alias("product_id"), kinds, F.lit(True).alias("is_active"))
    own = read(spark, sf_dir, "part").where("p_partkey % 13 = 0").select(
        (F.col("p_partkey") % 50).alias("user_id"), F.col("p_partkey").alias("product_id"), F.lit("PRICE_DROP").alias("rule_type"), (F.col("p_partkey") % 26 != 0).alias("is_active")
    )
    owner = F.when(F.col("product_id").isNull(), F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("product_id").cast("string")))
    return everyone.unionByName(own).withColumn("rule_id", F.concat_ws(":", owner, "rule_type"))


#: Hosts of listings' URLs, some of which only hold a known domain's name.
LISTING_HOSTS = ["www.trendyol.com", "www.hepsiburada.com", "m.n11.com", "xn11.com", "www.amazon.com.tr", "gratis.com", "www.grfratis.com", "shop.example.org", "WWW.Koctas.com.tr", "akakce.com"]


def listing_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A URL for every competitor's listing."""
    p, s = F.col("product_id"), F.col("seller_id")
    host = F.element_at(F.array(*[F.lit(h) for h in LISTING_HOSTS]), (1 + (p + s) % len(LISTING_HOSTS)).cast("int"))
    query = F.when(s % 3 == 0, F.concat(F.lit("?merchantId="), s.cast("string"), F.lit("&x=1"))).when(s % 3 == 1, "/").otherwise("#top")
    url = F.concat(F.lit("https://"), host, F.lit("/urun-adi-"), p.cast("string"), F.lit("-p-"), (p * 7 + s % 4).cast("string"), query)
    return competitors(spark, sf_dir).select(p, s, "price", "match_score", "last_scraped_at", url.alias("url"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title with a product code, storage and a count of parts for every product (short codes for odd ones)."""
    k = F.col("p_partkey")
    code = F.when(k % 2 == 0, F.format_string("ZX%06dTRK", k)).otherwise(F.format_string("Q%04dA", k % 10000))
    return read(spark, sf_dir, "part").select(
        k.alias("product_id"), F.format_string("%s %s %s %dGB %d parçalı", "p_brand", "p_name", code, 8 * (1 + k % 3), 2 + k % 4).alias("title"),
    )


def listing_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of competitors' listings: the product's own with twelve kinds of differences."""
    c = competitors(spark, sf_dir).select("product_id", "seller_id", F.col("price").alias("listing_price"), "match_score")
    t, k, code = F.col("title"), F.col("kind"), F.col("code")
    own = titles(spark, sf_dir).withColumn("code", F.regexp_extract(t, "(ZX[0-9]{6}TRK|Q[0-9]{4}A)", 1))
    j = c.join(own, "product_id").withColumn("kind", (F.col("product_id") + F.col("seller_id")) % 12)
    kinds = [
        t, F.replace(t, code, F.concat(code, F.lit("K"))), F.replace(t, code, F.concat(code, F.lit("1X"))), F.replace(t, code, F.concat(code, F.lit(" 015"))),
        F.replace(t, F.lit("8GB"), F.lit("0,5 TB")), F.concat(t, F.lit(" kılıfı")), F.concat(F.lit("Koli  bandı "), t), F.replace(t, code, F.lit("")),
        F.concat(F.lit("Başka ürün "), F.replace(t, code, F.lit("RTX4060"))), F.lower(t), F.regexp_replace(t, "[0-9]+ parçalı", "12 PARÇALI"), F.replace(t, code, F.concat(F.left(code, F.lit(3)), F.lit("-"), F.substring(code, F.lit(4), F.lit(20)))),
    ]
    listing = F
    for i, kind in enumerate(kinds):  # only the row's own kind is built
        listing = listing.when(k == i, kind)
    return j.select("product_id", "seller_id", "title", listing.alias("listing"), "listing_price", "match_score")


#: Blocks of product data that stand in for those of real pages, by page.
PAGE_BLOCKS = [
    '<script type="application/ld+json">{"@type":"Product","name":"Item %d","image":["a.jpg","b.jpg"],"category":"Home","aggregateRating":{"ratingValue":"4.5","reviewCount":"12"},"offers":{"price":"1.%d99,90","priceCurrency":"TRY","availability":"https://schema.org/InStock","seller":{"name":"Shop %d"}}}</script>',
    '<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":"Product","name":"Graph %d","image":"c.jpg","offers":[{"price":1%d.5,"availability":"OutOfStock"}]}]}</script>',
    '<script type="application/ld+json">{"@type":"ProductGroup","name":"Group %d","image":{"contentUrl":["d.jpg"]},"hasVariant":[{"offers":{"price":9%d}}]}</script>',
    '<script type="application/ld+json">{"@type":"Product",</script><meta property="og:title" content="Open %d"><meta content="2%d,75" property="product:price:amount"><meta property="og:image" content="e.jpg">',
    '<script id="__NEXT_DATA__" type="application/json">{"props":{"a":[{"totalPrice":"3%d,5"}],"b":{"note":"x"}}}</script>',
    '<script type="application/ld+json">{"@type":"Product","name":"Many %d","offers":{"@type":"AggregateOffer","lowPrice":"4%d","highPrice":90}}</script>',
    '<p>Just a moment %d %d</p>',
    '<script>window.__STATE__ = {"merchant":{"id":"1"},"price":{"discountedPrice":0,"sellingPrice":14%d.9},"sellers":[{"id":"1","name":"Own","price":5},{"id":"%d7","name":"Rival","price":{"sellingPrice":6}}]};</script>',
    '<meta name="description" content="Now %d TL"><b>Tükendi</b><i data-price="">%d</i>',
    "<i>%d %d</i>",
]


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a block of product data at their end."""
    k = F.col("page_id")
    digit = (1 + k % 9).cast("string")
    block = F.replace(F.element_at(F.array(*[F.lit(b) for b in PAGE_BLOCKS]), (1 + k % len(PAGE_BLOCKS)).cast("int")), F.lit("%d"), digit)
    return read(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", block).alias("html"))


SHOPS = ["trendyol", "hepsiburada", "amazon", "mediamarkt", "pttavm", "n11"]
#: Four blocks for each shop, as its pages hold them: also prices of other products, blank labels and later selectors first.
SHOP_BLOCKS = [
    # trendyol
    '<div class="pr-new-br"><h1> Lamp <b>%d</b> </h1></div><span class="prc-slg x">9,99 TL</span><div class="a prc-dsc b">1.2%d9,90 TL</div><a class="merchant-text">Shop %d</a><div class="base-product-image"><p>x</p><img src="/i/%d.jpg"></div>',
    '<h1 class="product-name">Desk %d</h1><div class="product-price-container"><s>80 TL</s><span class="prc-slg">7%d,50 TL</span></div><b class="seller-name">Seller %d</b><button class="out-of-stock-btn">x</button><img class="detail-section-img" src="/d/%d.jpg">',
    '<script type="application/ld+json">{"@type":"Product","name":"Chair %d","image":"/c/%d.jpg","offers":{"price":"3%d.5","availability":"OutOfStock","seller":{"name":"Ld %d"}}}</script><div class="prc-dsc">1 TL</div>',
    '<script type="application/ld+json">{"@type":"Product","name":"Group %d","image":"/g/%d.jpg","offers":{"price":"0","seller":{"name":"Ld %d"}}}</script><div class="prc-dsc"> </div><div class="product-price-container"><span class="prc-slg">4%d TL</span></div>',
    # hepsiburada
    '<h1 id="product-name">Pan %d - Hepsiburada deals</h1><i data-test-id="price">99 TL</i><i data-test-id="default-price"> </i><i data-test-id="price-current-price">2%d,9 TL</i><i data-test-id="merchant-name">Pans %d</i><img itemprop="image" src="/p/%d.jpg">',
    '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"product":{"name":"Pot %d","price":{"value":0,"discountedPrice":"1.4%d9,50"},"sellingPrice":7,"images":[{"url":"/pot/%d.jpg"}],"merchant":{"name":"Pots %d"},"stock":0}}}}</script><i data-test-id="price">5 TL</i>',
    '<b data-bind="text: currentPriceValue">yok</b><b class="price-value">88 TL</b><script>window.x = {"salePrice": 1%d.25, "finalPrice": 3};</script><div class="product-image"><em><img src="/s/%d.jpg"></em></div><p>Tükendi</p>',
    '<meta name="description" content="Only 1.0%d0,25 TL today"><meta property="og:price:amount" content=""><script>var y = {"finalPrice": 77};</script><i data-test-id="seller-name">Desc %d</i>',
    # amazon
    '<div class="a-price"><span class="a-offscreen">926,00 TL</span></div><span id="productTitle">  Fryer %d </span><div id="corePrice_feature_div"><div class="a-price"><span class="a-offscreen">9.5%d0,00 TL</span></div></div><a id="sellerProfileTriggerId">FRY %d</a><img id="landingImage" src="/f/%d.jpg"><div id="availability"> Stokta var </div>',
    '<span id="productTitle">Radio %d</span><div id="corePrice_feature_div"> </div><div class="a-price"><span class="a-offscreen">5%d TL</span></div><div id="availability"><span>Şu anda mevcut değil.</span></div><div id="merchantInfo">Sold   by %d</div>',
    '<span id="productTitle">Phone %d</span><div id="apex_desktop"><i class="a-price"><u class="a-offscreen">yok</u></i></div><b id="priceblock_dealprice">33,3%d TL</b><div id="merchantInfoFeature_feature_div">Satıcı Store%d  more</div><div id="imgTagWrapperId"><img src="/w/%d.jpg"></div>',
    '<div class="a-price"><span class="a-offscreen">12,00 TL</span></div><span id="productTitle">Cable %d</span><div id="outOfStock">x</div><meta property="og:image" content="/og/%d.jpg">',
    # mediamarkt
    '<h1 data-test="product-title">Tv %d</h1><b class="price">1 TL</b><b data-test="product-price">8.%d00,00 TL</b><b data-test="branded-price-whole-value">7.%d00,00 TL</b><i data-test="marketplace-seller-name">Tvs %d</i><img data-test="product-image" src="/tv/%d.jpg">',
    '<h1 data-test="mms-product-name">Sound %d</h1><b data-test="product-price"> </b><i itemprop="price" content="6%d.50"></i><i data-test="sold-and-shipped-by">MM %d</i><img data-test="product-image" data-src="/so/%d.jpg"><p>ürün tükendi</p>',
    '<script type="application/ld+json">{"@type":"Product","name":"Fridge %d","image":["/fr/%d.jpg"],"offers":[{"price":"5%d1","availability":"InStock","seller":{"name":"Cold %d"}}]}</script><b class="price">1 TL</b><p>stokta yok</p>',
    '<b class="big price">3%d,00 TL</b><meta property="og:image" content="/mm/%d.jpg">',
    # pttavm
    '<h1 class="product-title">Tea %d</h1><i data-price="99"></i><b class="productPrice">2%d,40 TL</b>',
    '<b class="x-ProductName-y">Cup %d</b><i data-price="1%d,75"></i><meta property="og:image" content="/cup/%d.jpg"><p>Tükendi</p>',
    '<h1 class="product-name">Jar %d</h1><i data-product-price="4%d"></i><b class="Price__current-1"> </b>',
    '<h1 class="product-name">Box %d</h1><meta property="product:price:amount" content="5%d,5"><b class="product-price-new">fiyat yok</b>',
    # n11
    '<h1 class="proName">Shoe %d</h1><div class="priceContainer"><ins>9 TL</ins></div><div class="newPrice"><p><ins>1.1%d0,00 TL</ins></p></div><script type="application/ld+json">{"@type":"Product","name":"Shoe ld %d","offers":{"@type":"AggregateOffer","lowPrice":"1%d"}}</script><link rel="canonical" href="https://x/y?magaza=shop%d&a=1">',
    '<h1 class="proName">Sock %d</h1><div class="priceContainer"><ins>2%d,00 TL</ins></div><div class="unf-p-sellerInfo"><a> Socks %d </a></div><img class="imgObj" data-original="/so/%d.jpg"><p>Stokta yok</p>',
    '<script type="application/ld+json">{"@type":"Product","name":"Hat %d","image":"/hat/%d.jpg","offers":{"@type":"AggregateOffer","lowPrice":"3%d,5"}}</script><meta property="og:url" content="https://x/z?b=1&magaza=hats-%d">',
    '<div class="newPrice"> </div><ins>5 TL</ins>',
]


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of known shops: every page with one of its shop's blocks at its end."""
    k = F.col("page_id")
    digit = (1 + k % 9).cast("string")
    at = k % len(SHOPS) * 4 + F.floor(k / len(SHOPS)) % 4
    block = F.replace(F.element_at(F.array(*[F.lit(b) for b in SHOP_BLOCKS]), (1 + at).cast("int")), F.lit("%d"), digit)
    site = F.element_at(F.array(*[F.lit(s) for s in SHOPS]), (1 + k % len(SHOPS)).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", site.alias("site"), F.concat("html", block).alias("html"))
