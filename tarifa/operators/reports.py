"""Dashboard, market and catalogue reports (AGG-*, SRT-*, FLT-*, SNK-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prices import margin_band, margin_pct, price_for_margin, undercut, to_fixed
from ..functions.text import csv_escape, tr_lower


def period_report(changes: DataFrame, now: Column) -> DataFrame:
    """AGG-09: changes and moving products of a day, a week and 30 days from one pass over the changes."""
    real = F.col("price_change").isNotNull() & (F.col("price_change") != 0)
    spans = {"today": 24, "7d": 168, "30d": 720}
    inside = {k: real & (F.col("scraped_at") >= now - F.make_dt_interval(hours=F.lit(h))) for k, h in spans.items()}
    widest = now - F.make_dt_interval(hours=F.lit(max(spans.values())))
    one = changes.where(F.col("scraped_at") >= widest).agg(*[F.count_if(c).alias(f"n_{k}") for k, c in inside.items()], *[F.countDistinct(F.when(c, F.col("product_id"))).alias(f"p_{k}") for k, c in inside.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("period"), F.col(f"n_{k}").alias("changes"), F.col(f"p_{k}").alias("products")) for k in spans])
    return one.select(F.inline(rows))


def most_moving(changes: DataFrame, since: Column, k: int = 5) -> DataFrame:
    """AGG-10, SRT-01."""
    g = changes.where(F.col("scraped_at") >= since).groupBy("product_id").agg(
        F.count_if(F.col("price_change").isNotNull() & (F.col("price_change") != 0)).alias("moves"),
        F.max(F.abs(F.coalesce("price_change_pct", F.lit(0.0)))).alias("max_pct"),
    )
    return g.orderBy(F.desc("moves"), F.desc("max_pct"), "product_id").limit(k)


def marketplace_stats(products: DataFrame, listings: DataFrame, history: DataFrame, since: Column) -> DataFrame:
    """AGG-02..07: per marketplace the products by status, listings, mean score, observations and rates."""
    s = F.col("status")
    p = products.groupBy("marketplace").agg(F.count("*").alias("total"), F.count_if(s == "ACTIVE").alias("active"), F.count_if(s == "ERROR").alias("error"), F.count_if(s == "PAUSED").alias("paused"))
    dim = products.select("product_id", "marketplace")
    c = listings.groupBy("product_id").agg(F.count("*").alias("c"), F.sum("match_score").alias("ss"), F.count("match_score").alias("sn"))
    c = c.join(dim, "product_id").groupBy("marketplace").agg(F.sum("c").alias("listings"), F.sum("ss").alias("ss"), F.sum("sn").alias("sn"))
    # counted by product before the join, so the join carries one row a product
    h = history.where(F.col("scraped_at") >= since).groupBy("product_id").agg(F.count("*").alias("n")).join(dim, "product_id")
    h = h.groupBy("marketplace").agg(F.sum("n").alias("observations"))
    j = p.join(c, "marketplace", "left").join(h, "marketplace", "left")
    rate = lambda x: F.coalesce(F.floor(F.try_divide(100.0 * F.col(x), F.col("total")) + 0.5), F.lit(0))
    score = F.nullif(F.try_divide(F.col("ss").cast("double"), F.col("sn")), F.lit(0.0))
    return j.select("marketplace", "total", "active", "error", "paused", F.coalesce("listings", F.lit(0)).alias("listings"), F.floor(score + 0.5).alias("avg_score"), F.coalesce("observations", F.lit(0)).alias("observations"), rate("active").alias("success_rate"), rate("error").alias("error_rate"))


def marketplace_summary(stats: DataFrame) -> DataFrame:
    """AGG-08: grand totals; the mean score is the mean of the rounded means."""
    return stats.agg(
        F.count("*").alias("marketplaces"), F.sum("total").alias("total"), F.sum("active").alias("active"), F.sum("listings").alias("listings"),
        F.floor(F.avg("avg_score") + 0.5).alias("avg_score"), F.floor(100.0 * F.sum("active") / F.sum("total") + 0.5).alias("success_rate"),
    )


def margin_report(products: DataFrame) -> DataFrame:
    """NUM-04, NUM-05 for every product that has both prices."""
    pct = margin_pct(F.col("current_price"), F.col("cost"))
    return products.select("product_id", (F.col("current_price") - F.col("cost")).alias("profit"), pct.alias("margin_pct"), margin_band(pct).alias("band")).where("margin_pct IS NOT NULL")


def price_suggestion(assessed: DataFrame, products: DataFrame, target_pct: float = 10.0) -> DataFrame:
    """NUM-06, NUM-07: undercut the cheapest usable competitor, but not below the price of the target margin."""
    low = assessed.where("usable").groupBy(F.col("product_id").alias("k")).agg(F.min("price").alias("cheapest"))
    j = products.join(low, F.col("product_id") == F.col("k"))
    floor_, cut = price_for_margin(F.col("cost"), F.lit(target_pct)), undercut(F.col("cheapest"))
    return j.select("product_id", "cheapest", cut.alias("undercut"), floor_.alias("floor"), F.coalesce(F.greatest(cut, floor_), floor_).alias("protected"), F.coalesce(cut < floor_, F.lit(False)).alias("breaches_floor"))


def catalog_gap(assessed: DataFrame, k: int = 50) -> DataFrame:
    """NUM-08, SRT-09: by gap over the least price, missing gaps last."""
    g = assessed.groupBy("product_id").agg(F.first("own_price").alias("own"), F.min(F.when(F.col("usable"), F.col("price"))).alias("low"))
    gap = F.try_divide(F.col("own") - F.col("low"), F.col("low"))
    return g.select("product_id", gap.alias("gap")).orderBy(F.desc_nulls_last("gap"), "product_id").limit(k)


def quick_filters(pressures: DataFrame, products: DataFrame, last: DataFrame, since: Column) -> DataFrame:
    """FLT-08: which quick filters each product passes; `last` has the newest time and change of each product."""
    band = margin_band(margin_pct(F.col("current_price"), F.col("cost")))
    j = products.join(pressures.drop("own_price"), "product_id", "left").join(last, "product_id", "left")
    return j.select(
        "product_id", (F.coalesce("usable", F.lit(0)) == 0).alias("no_competitor"), F.coalesce(F.col("current_price") > F.col("min_price"), F.lit(False)).alias("cheaper_competitor"),
        F.coalesce(band.isin("loss", "thin"), F.lit(False)).alias("loss"), (F.col("status") == "ACTIVE").alias("active"),
        (F.col("ts").isNull() | (F.col("ts") < since)).alias("stale"), F.coalesce(F.col("change") != 0, F.lit(False)).alias("changed"),
    )


def catalog_search(products: DataFrame, tags: DataFrame, text: str, tag_ids: list[int] | None, marketplace: str) -> DataFrame:
    """FLT-01, FLT-07: name or marketplace holds the text, any of the tags, and the marketplace ("ALL" for every one)."""
    found = products
    if text.strip():
        t = text.strip().lower()
        found = found.where(F.contains(F.lower("product_name"), F.lit(t)) | F.contains(F.lower("marketplace"), F.lit(t)))
    if tag_ids:
        found = found.join(tags.where(F.col("tag_id").isin(tag_ids)), "product_id", "left_semi")
    return found if marketplace == "ALL" else found.where(F.col("marketplace") == marketplace)


def catalog_places(rows: DataFrame, k: int) -> DataFrame:
    """SRT-09: for each order the first k products and their places: a top-k of each, no global window."""
    orders = {
        "updated": F.desc_nulls_last("ts"), "dearest": F.desc_nulls_last("current_price"), "cheapest": F.asc_nulls_last("current_price"),
        "competitors": F.coalesce("n", F.lit(0)).desc(), "change": F.coalesce("change", F.lit(0.0)).asc(),
    }
    found = None
    for name, order in orders.items():
        top = rows.orderBy(order, "product_id").limit(k)
        at = top.withColumn("_n", F.row_number().over(Window.orderBy(order, "product_id"))).select("product_id", F.lit(name).alias("_o"), "_n")
        found = at if found is None else found.unionByName(at)
    return found.groupBy("product_id").agg(*[F.max(F.when(F.col("_o") == n, F.col("_n"))).alias(n) for n in orders])


def rule_list(rules: DataFrame, shown: str, asked: str) -> DataFrame:
    """FLT-11, SRT-11: rules that are "active", "inactive", "recent" (have fired) or "all" and whose text holds what is asked, with their `place` in their user's list: global ones first, then those that fired last."""
    keep = {"active": F.col("is_active"), "inactive": ~F.col("is_active"), "recent": F.col("last_triggered").isNotNull(), "all": F.lit(True)}[shown]
    hay = tr_lower(F.concat_ws(" ", "rule_type", F.col("product_id").cast("string")))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("product_id").isNotNull(), F.desc_nulls_last("last_triggered"), "rule_id"))
    return rules.where(keep & F.contains(hay, tr_lower(F.lit(asked)))).withColumn("place", place)


def page(rows: DataFrame, order: list, offset: int, limit: int, most: int = 50) -> DataFrame:
    """SRT-05: one page of at most `most` rows."""
    return rows.orderBy(*order).offset(offset).limit(min(limit, most))


#: Columns of the product file, in order.
EXPORT = ["product", "marketplace", "my_price", "cost", "profit", "margin_pct", "competitor_count", "last_update", "status", "tags", "product_url"]


def product_export(products: DataFrame, tags: DataFrame, competitors: DataFrame, last: DataFrame, url: Column) -> DataFrame:
    """SNK-02: one CSV line of EXPORT's columns a product; a price or cost of 0 or none leaves its cells empty, times are ISO."""
    k = F.col("product_id").alias("k")
    t = tags.groupBy(k).agg(F.array_join(F.transform(F.array_sort(F.collect_list("tag_id")), lambda x: x.cast("string")), " | ").alias("tags"))
    n = competitors.groupBy(k).agg(F.count("*").alias("n"))
    j = products
    for side in (t, n, last.select(k, "last_scraped_at")):
        j = j.join(side, F.col("product_id") == F.col("k"), "left").drop("k")
    cell = lambda x, d: F.coalesce(to_fixed(x, d), F.lit(""))
    price, cost = (F.nullif(F.col(c), F.lit(0.0)) for c in ("current_price", "cost"))
    pct = margin_pct(price, cost)
    at = F.date_format("last_scraped_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    cells = [
        F.col("product_name"), F.col("marketplace"), cell(price, 2), cell(cost, 2), cell(F.when(pct.isNotNull(), price - cost), 2), cell(pct, 1),
        F.coalesce("n", F.lit(0)), F.coalesce(at, F.lit("")), F.col("status"), F.coalesce("tags", F.lit("")), url,
    ]
    return j.select("product_id", F.concat_ws(",", *[csv_escape(c) for c in cells]).alias("line"))


def status_cube(products: DataFrame) -> DataFrame:
    """AGG-08, grouping sets: products, priced ones and their mean price by marketplace, status and plan, of every combination; `level` tells which are totals."""
    price = F.col("current_price").cast("decimal(28,9)")
    mean = F.sum(price).cast("double") / F.nullif(F.count(price), F.lit(0))
    g = products.cube("marketplace", "status", "plan").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("products"), F.count(price).alias("priced"), mean.alias("mean_price"))
    return g.select("level", "marketplace", "status", "plan", "products", "priced", "mean_price")


def daily_sketches(moves: DataFrame) -> DataFrame:
    """By day: a HyperLogLog sketch of the products that moved and a KLL sketch of prices; small rows that merge to any span of days."""
    day = F.to_date("scraped_at").alias("day")
    return moves.groupBy(day).agg(F.hll_sketch_agg("product_id", 12).alias("movers"), F.kll_sketch_agg_double("price", 400).alias("prices"), F.count("*").alias("moves"))


def sketch_spans(sketches: DataFrame, spans: tuple[int, ...] = (7, 30)) -> DataFrame:
    """AGG-09: for every day and span, the distinct movers and price quantiles of the days up to it, from the days' sketches alone.

    The movers' estimate has a relative standard error of 1.04 / sqrt(2^12), 1.6 %; a quantile's rank is off by 0.7 % at most with
    99 % confidence.
    """
    s = sketches.withColumn("span", F.explode(F.array(*[F.lit(n) for n in spans])))
    s = s.withColumn("until", F.explode(F.sequence(F.col("day"), F.date_add("day", F.col("span") - 1))))
    g = s.groupBy("span", "until").agg(F.hll_union_agg("movers").alias("m"), F.kll_merge_agg_double("prices").alias("p"), F.sum("moves").alias("moves"))
    q = F.kll_sketch_get_quantile_double("p", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    return g.select("span", "until", F.hll_sketch_estimate("m").alias("movers"), q.alias("quartiles"), "moves")
