"""Competitor quality (QUA-01..03), position and advice (AGG-11..13, JON-12, WIN-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prices import positive, within_price_band
from ..functions.text import hours_between

# Fixed values of the policy
MIN_SCORE, MAX_AGE_HOURS, MIN_SURVIVORS = 70, 72, 5
LOW_RATIO, LOW_GAP, HIGH_RATIO, HIGH_GAP = 0.45, 1.8, 2.75, 1.5


def issues(price: Column, score: Column, seen: Column, own: Column, now: Column) -> Column:
    """QUA-01: issue codes in a fixed order; an empty array means usable."""
    age = hours_between(seen, now)
    priced, known = positive(price).isNotNull(), positive(own).isNotNull()
    return F.array_compact(F.array(
        F.when(~priced, F.lit("no-price")),
        F.when(score < MIN_SCORE, F.lit("low-score")),
        F.when(priced & known & ~within_price_band(own, price), F.lit("out-of-band")),
        F.when(age.isNull() | (age > MAX_AGE_HOURS), F.lit("stale")),
    ))


def assess(listings: DataFrame, products: DataFrame, now: Column) -> DataFrame:
    """QUA-01 and QUA-03 for every listing of every product.

    The leave-one-out median comes from each row's rank and the middle prices of its product, and the nearest peer
    from the neighbours in price order, so no product's prices are collected.
    """
    own = products.select(F.col("product_id").alias("own_id"), F.col("current_price").alias("own_price"))
    c = listings.join(own, F.col("product_id") == F.col("own_id"), "left").drop("own_id")
    c = c.withColumn("issues", issues(F.col("price"), F.col("match_score"), F.col("last_scraped_at"), F.col("own_price"), now))
    c = c.withColumn("ok", F.size("issues") == 0)
    group = Window.partitionBy("product_id", "ok")
    ranked = group.orderBy("price", "seller_id")
    # ranks first: their order serves the windows of whole groups as well, which would else sort once more
    c = c.withColumn("i", F.row_number().over(ranked)).withColumn("below", F.lag("price").over(ranked)).withColumn("above", F.lead("price").over(ranked))
    c = c.withColumn("n", F.count("*").over(group))
    half = F.floor(F.col("n") / 2)
    c = c.withColumns({f"m{k}": F.max(F.when(F.col("i") == half + k, F.col("price"))).over(group) for k in range(3)})
    i, even = F.col("i"), F.col("n") % 2 == 0
    left = F.when(i > half, F.col("m0")).otherwise(F.col("m1"))
    right = F.when(i > half + 1, F.col("m1")).otherwise(F.col("m2"))
    median = F.when(even, left).otherwise((left + right) / 2)
    p, b, a = F.col("price"), F.col("below"), F.col("above")
    nearest = F.when(a.isNull() | (p - b <= a - p), b).otherwise(a)
    low = (p < LOW_RATIO * median) & (nearest / p >= LOW_GAP)
    high = (p > HIGH_RATIO * median) & (p / nearest >= HIGH_GAP)
    outlier = F.col("ok") & (F.col("n") >= MIN_SURVIVORS) & (low | high)
    outlier = F.coalesce(outlier, F.lit(False))
    out = F.when(outlier, F.array(F.lit("peer-outlier"))).otherwise(F.col("issues"))
    return c.select("product_id", "seller_id", "price", "own_price", "match_score", "last_scraped_at", out.alias("issues"), (F.col("ok") & ~outlier).alias("usable"))


def pressure(assessed: DataFrame) -> DataFrame:
    """AGG-11: per product the usable competitors, the cheaper ones, the least price and the gap in percent."""
    usable = F.col("usable")
    g = assessed.groupBy("product_id").agg(
        F.first("own_price").alias("own_price"), F.count_if(usable).alias("usable"),
        F.count_if(usable & (F.col("price") < F.col("own_price"))).alias("cheaper"), F.min(F.when(usable, F.col("price"))).alias("min_price"),
    )
    gap = F.when(F.col("own_price") > F.col("min_price"), (F.col("own_price") - F.col("min_price")) / F.col("own_price") * 100).otherwise(0.0)
    return g.withColumn("gap_pct", gap)


def market_position(assessed: DataFrame) -> DataFrame:
    """AGG-12, AGG-13, WIN-06: least, largest and mean price with the own one, mean of the three cheapest, own rank."""
    u = assessed.where("usable")
    three = F.row_number().over(Window.partitionBy("product_id").orderBy("price", "seller_id")) <= 3
    u = u.withColumn("three", three)
    g = u.groupBy("product_id").agg(
        F.first("own_price").alias("own"), F.count("*").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi"), F.sum("price").alias("s"),
        F.sum(F.when(F.col("three"), F.col("price"))).alias("s3"), F.count_if(F.col("price") < F.col("own_price")).alias("cheaper"),
    )
    own = F.col("own")
    return g.select(
        "product_id", F.col("n").alias("usable"), F.least("lo", own).alias("min_price"), F.greatest("hi", own).alias("max_price"),
        F.round((F.col("s") + F.coalesce(own, F.lit(0.0))) / (F.col("n") + own.isNotNull().cast("int")), 6).alias("avg_price"),
        F.when(F.col("n") >= 3, F.round(F.col("s3") / 3, 6)).alias("top3_avg"),
        F.when((F.col("n") >= 2) & own.isNotNull(), F.col("cheaper") + 1).alias("own_rank"),
    )


def nearest_competitor(assessed: DataFrame) -> DataFrame:
    """JON-12: the usable competitor nearest in price, the cheaper one on ties; one pass without a self-join."""
    d = F.abs(F.col("price") - F.col("own_price"))
    best = F.min(F.struct(d.alias("d"), F.col("price"), F.col("seller_id"))).alias("b")
    return assessed.where("usable AND own_price IS NOT NULL").groupBy("product_id").agg(best).select("product_id", F.col("b.seller_id").alias("seller_id"), F.col("b.price").alias("price"))
