"""Queries of search hits, catalogue views, writes and admissions, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels, prices, text
from ..operators import catalog, lifecycle, quality, reports, timeseries
from ..sources import tables as t
from .labels import _PICK, _URLS
from .queries import _TAGS, _assessed, _day, _last, _moves, query

_NEW = "TIMESTAMP '2001-11-05'"
_KEY = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^https://([^?#]*)', 1)), '^www\\.', ''), '/+$', '')"
#: Hits: every listing with its query and place, and again in the next query with another case and price for sellers divisible by 5.
_HITS = f"""{_URLS}, hits AS (SELECT product_id, 1 + seller_id % 3 AS query_no, seller_id AS position, url, price * 1.01 AS price FROM v UNION ALL SELECT product_id, 2 + seller_id % 3, seller_id, upper(url), price FROM v WHERE seller_id % 5 = 0),
    own AS (SELECT product_id, arg_min(url, seller_id) AS own_url FROM v GROUP BY 1)"""


def _hits(spark, d):
    v = t.listing_urls(spark, d)
    s = F.col("seller_id")
    one = v.select("product_id", (1 + s % 3).alias("query_no"), s.alias("position"), "url", (F.col("price") * 1.01).alias("price"))
    return one.unionByName(v.where(s % 5 == 0).select("product_id", (2 + s % 3).alias("query_no"), s.alias("position"), F.upper("url").alias("url"), "price"))


def _own(spark, d):
    return t.listing_urls(spark, d).groupBy("product_id").agg(F.min_by("url", "seller_id").alias("own_url"))


@query(f", {_HITS} SELECT product_id, query_no, position, url, price FROM hits QUALIFY row_number() OVER (PARTITION BY product_id, lower(regexp_replace(url, '/$', '')) ORDER BY query_no, position) = 1", "hc")
def merged_hits(spark, d):
    """SET-02."""
    return catalog.merged_hits(_hits(spark, d))


@query(f""", {_HITS}, s AS (SELECT hits.*, ({_KEY}) = (SELECT {_KEY.replace("url", "own_url")} FROM own WHERE own.product_id = hits.product_id) AS is_own FROM hits)
    SELECT product_id, count(*) AS hits, count_if(is_own) AS own, arg_min(price, [query_no, position]) FILTER (is_own AND NOT contains(url, 'merchantId=')) AS own_price FROM s GROUP BY product_id""", "hc")
def own_listing(spark, d):
    """JON-08, DSC-07."""
    s = catalog.split_own(_hits(spark, d).where(~F.col("url").startswith("HTTPS")), _own(spark, d))
    upper = _hits(spark, d).where(F.col("url").startswith("HTTPS")).groupBy("product_id").agg(F.count("*").alias("u"))
    g = s.groupBy("product_id").agg(F.count("*").alias("hits"), F.count_if("is_own").alias("own")).join(upper, "product_id", "left")
    return g.join(catalog.recovered_own_price(s), "product_id", "left").select("product_id", (F.col("hits") + F.coalesce("u", F.lit(0))).alias("hits"), "own", "own_price")


@query(f", {_HITS} SELECT product_id, count_if(v.url IS NULL) AS new_hits, count_if(v.price <> hits.price) AS moved, count_if(match_score >= 70) AS strong FROM hits LEFT JOIN (SELECT v.*, match_score FROM v JOIN c USING (product_id, seller_id)) v USING (product_id, url) GROUP BY product_id", "hc")
def known_hits(spark, d):
    """JON-07, JON-11."""
    j = catalog.known_hits(_hits(spark, d), t.listing_urls(spark, d))
    return j.groupBy("product_id").agg(F.count_if("is_new").alias("new_hits"), F.count_if("moved").alias("moved"), F.count_if(F.col("match_score") >= 70).alias("strong"))


@query(f""", {_HITS}, b AS (SELECT hits.*, current_price IS NULL OR price BETWEEN 0.3 * current_price AND 3 * current_price AS accepted FROM hits JOIN p USING (product_id)), n AS (SELECT product_id, query_no, count_if(accepted) AS n FROM b GROUP BY ALL),
    r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY product_id ORDER BY query_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) SELECT product_id, count(*) AS candidates, count_if(accepted) AS accepted, count_if(NOT accepted) AS price_filtered, max(query_no) AS last_query,
    CASE WHEN count_if(accepted) > 0 THEN NULL WHEN count_if(NOT accepted) = 0 THEN 'no-exact-match' ELSE 'price-filtered' END AS reason FROM b WHERE (product_id, query_no) IN (SELECT (product_id, query_no) FROM r WHERE before < 3) GROUP BY product_id""", "hpc")
def discovery_funnel(spark, d):
    """DSC-01, DSC-02, AGG-22, CSE-05: hits of the queries that are run, by what becomes of them."""
    h = _hits(spark, d).join(t.tracked_products(spark, d).select("product_id", "current_price"), "product_id")
    run = catalog.staged(h.withColumn("accepted", prices.within_price_band(F.col("current_price"), F.col("price"))))
    g = run.groupBy("product_id").agg(F.count("*").alias("candidates"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("price_filtered"), F.max("query_no").alias("last_query"))
    none = F.lit(0)
    return g.withColumn("reason", F.when(F.col("accepted") == 0, labels.zero_reason(none, F.col("price_filtered"), none, none, none)))


@query(f""", {_URLS}, w AS (SELECT v.*, {_KEY} AS key, last_scraped_at FROM v JOIN c USING (product_id, seller_id)) SELECT product_id, seller_id, new_price, seen_at FROM w JOIN (SELECT key, arg_max(price, [epoch(last_scraped_at), price]) AS new_price, max(last_scraped_at) AS seen_at FROM w GROUP BY key) USING (key)""", "hc")
def url_fanout(spark, d):
    """JON-09, AGG-06."""
    v = t.listing_urls(spark, d)
    return catalog.fan_out(v, v.select("product_id", "seller_id", "url")).select("product_id", "seller_id", "new_price", "seen_at")


@query(f""", {_URLS} SELECT product_id, url, rn FROM (SELECT v.product_id, v.url, row_number() OVER (PARTITION BY v.product_id ORDER BY last_scraped_at NULLS FIRST, v.url) AS rn FROM v JOIN c USING (product_id, seller_id) WHERE seller_id % 2 = 0) WHERE rn <= 10""", "hc")
def missing_listings(spark, d):
    """JON-14: the listings of even sellers have no hit."""
    v = t.listing_urls(spark, d)
    return catalog.missing_listings(v, v.where("seller_id % 2 = 1")).select("product_id", "url", "rn")


@query(f""", {_URLS} SELECT product_id, seller_id, price, marketplace, row_number() OVER (PARTITION BY product_id ORDER BY price, seller_id) AS rn FROM (SELECT *, {_PICK(labels.MARKETPLACES, "'CUSTOM'")} AS marketplace FROM v) WHERE marketplace <> 'TRENDYOL'""", "hc")
def other_marketplaces(spark, d):
    """DSC-09, SRT-08, SNK-13's lookup: listings of other marketplaces, cheapest first, missing prices last."""
    v = t.listing_urls(spark, d).withColumn("marketplace", F.coalesce(labels.marketplace_of(F.col("url")), F.lit("CUSTOM"))).where("marketplace <> 'TRENDYOL'")
    rn = F.row_number().over(Window.partitionBy("product_id").orderBy(F.asc_nulls_last("price"), "seller_id"))
    return v.select("product_id", "seller_id", "price", "marketplace", rn.alias("rn"))


@query(f"SELECT product_id, product_name, status FROM p WHERE (contains(lower(product_name), 'a') OR contains(lower(marketplace), 'a')) AND product_id IN (SELECT product_id FROM {_TAGS} WHERE tag_id IN (3, 7)) AND marketplace <> ''", "p")
def catalog_search(spark, d):
    """FLT-01, FLT-07: "ALL" leaves a filter out."""
    return reports.catalog_search(t.tracked_products(spark, d), t.product_tags(spark, d), "A", [3, 7], "ALL").select("product_id", "product_name", "status")


@query("""SELECT product_id, CASE WHEN updated <= 20 THEN updated END AS updated, CASE WHEN dearest <= 20 THEN dearest END AS dearest, CASE WHEN cheapest <= 20 THEN cheapest END AS cheapest, CASE WHEN competitors <= 20 THEN competitors END AS competitors, CASE WHEN change <= 20 THEN change END AS change FROM (SELECT product_id, row_number() OVER (ORDER BY ts DESC NULLS LAST, product_id) AS updated, row_number() OVER (ORDER BY current_price DESC NULLS LAST, product_id) AS dearest, row_number() OVER (ORDER BY current_price NULLS LAST, product_id) AS cheapest, row_number() OVER (ORDER BY coalesce(n, 0) DESC, product_id) AS competitors, row_number() OVER (ORDER BY coalesce(pc, 0), product_id) AS change
    FROM p LEFT JOIN (SELECT product_id, count(*) AS n FROM c GROUP BY 1) USING (product_id) LEFT JOIN (SELECT product_id, max(scraped_at) AS ts, arg_max(price_change, [epoch(scraped_at), l_orderkey, l_linenumber]) FILTER (price_change IS NOT NULL) AS pc FROM m GROUP BY 1) USING (product_id)
    QUALIFY least(updated, dearest, cheapest, competitors, change) <= 20)""", "hpcm")
def catalog_sorts(spark, d):
    """SRT-09: places of the products that are among the first 20 in one of five orders."""
    h = _moves(spark, d)
    last = h.groupBy("product_id").agg(F.max("scraped_at").alias("ts"), F.max_by("price_change", F.when(F.col("price_change").isNotNull(), F.struct(*timeseries.ORDER))).alias("change"))
    n = t.competitors(spark, d).groupBy("product_id").agg(F.count("*").alias("n"))
    j = t.tracked_products(spark, d).join(last, "product_id", "left").join(n, "product_id", "left")
    return reports.catalog_places(j, 20)


@query("""SELECT user_id, product_id, rule_type, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY product_id IS NOT NULL, product_id DESC, rule_type) AS place FROM (SELECT c_custkey AS user_id, NULL::BIGINT AS product_id, unnest(['PRICE_DROP', 'LOW_MARGIN']) AS rule_type, true AS is_active FROM customer WHERE c_custkey < 50 UNION ALL SELECT p_partkey % 50, p_partkey, 'PRICE_DROP', p_partkey % 26 <> 0 FROM part WHERE p_partkey % 13 = 0)) WHERE is_active AND contains(lower(replace(replace(concat_ws(' ', rule_type, product_id), 'İ', 'i'), 'I', 'ı')), 'prıce')""")
def rules_sorted(spark, d):
    """FLT-11, SRT-11: active rules whose text holds a query, global ones first."""
    r = t.alert_rules(spark, d).where(F.col("product_id").isNotNull() | F.col("rule_type").isin("PRICE_DROP", "LOW_MARGIN"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("product_id").isNotNull(), F.desc_nulls_last("product_id"), "rule_type"))
    hay = text.tr_lower(F.concat_ws(" ", "rule_type", F.col("product_id").cast("string")))
    return r.withColumn("place", place).where(F.col("is_active") & F.contains(hay, text.tr_lower(F.lit("PRICE")))).select("user_id", "product_id", "rule_type", "place")


@query(f"""SELECT action, product_id, row_number() OVER (PARTITION BY action ORDER BY product_id) AS rn FROM (SELECT product_id, unnest([CASE WHEN coalesce(usable, 0) = 0 THEN 'no-competitor' END, CASE WHEN ts IS NULL OR ts < {_NEW} - INTERVAL 24 HOUR THEN 'stale' END, CASE WHEN status = 'ERROR' THEN 'critical' END]) AS action
    FROM p LEFT JOIN g USING (product_id) LEFT JOIN (SELECT product_id, max(scraped_at) AS ts FROM h GROUP BY 1) USING (product_id)) WHERE action IS NOT NULL QUALIFY rn <= 4""", "hpg")
def action_groups(spark, d):
    """SRT-13."""
    j = t.tracked_products(spark, d).join(quality.pressure(_assessed(spark, d)).select("product_id", "usable"), "product_id", "left").join(_last(spark, d), "product_id", "left")
    seen = F.col("last_scraped_at")
    groups = {"no-competitor": F.coalesce("usable", F.lit(0)) == 0, "stale": seen.isNull() | (seen < _day()), "critical": F.col("status") == "ERROR"}
    return catalog.action_groups(j, groups, ["product_id"]).select("action", "product_id", "rn")


@query("""WITH n AS (SELECT *, o_orderkey % 3 = 0 AS is_read, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'price' WHEN o_orderpriority = '3-MEDIUM' THEN 'stock' ELSE 'other' END AS category FROM orders), g AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, count(*) OVER () AS total FROM n WHERE NOT is_read)
    SELECT o_orderkey AS id, total, 90 < total AS has_more, regexp_matches(o_orderpriority, '(?i)acil|kritik|urgent') AS critical, category FROM g WHERE rn BETWEEN 41 AND 90""")
def notifications_filtered(spark, d):
    """FLT-10, AGG-27, SRT-05: a page of at most 50 unread ones with the total and whether more follow."""
    rows = t.notifications(spark, d).where("NOT is_read")
    total = rows.agg(F.count("*").alias("n"))
    category = F.when(F.col("rule_type").isin("1-URGENT", "2-HIGH"), "price").when(F.col("rule_type") == "3-MEDIUM", "stock").otherwise("other")
    page = reports.page(rows, [F.desc("sent_at"), F.desc("id")], 40, 80)
    return page.select("id", total.scalar().alias("total"), F.col("rule_type").rlike("(?i)acil|kritik|urgent").alias("critical"), category.alias("category")).withColumn("has_more", F.col("total") > 90)


@query("""SELECT p.product_id, count(*) AS alerts FROM orders o JOIN u ON u.user_id = o_custkey JOIN p ON p.product_id = o_orderkey % 977 WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY alerts DESC, p.product_id LIMIT 5""", "pu")
def product_alerts_top5(spark, d):
    """JON-05, SRT-03: sent alerts by product, counted before the joins."""
    n = t.notifications(spark, d).where("status = 'SENT'").join(t.users(spark, d).select("user_id"), "user_id", "left_semi").groupBy((F.col("id") % 977).alias("product_id")).agg(F.count("*").alias("alerts"))
    return n.join(t.tracked_products(spark, d).select("product_id"), "product_id", "left_semi").orderBy(F.desc("alerts"), "product_id").limit(5)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'no' END AS is_read, coalesce(product_name, '') AS product_name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS sent_at FROM orders LEFT JOIN p ON p.product_id = o_orderkey % 977 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000""", "p")
def notification_export(spark, d):
    """SNK-03: the newest 1000 first, then the join."""
    n = t.notifications(spark, d).orderBy(F.desc("sent_at"), F.desc("id")).limit(1000).withColumn("product_id", F.col("id") % 977)
    j = n.join(t.tracked_products(spark, d).select("product_id", "product_name"), "product_id", "left")
    return j.select("id", F.when(F.col("is_read"), "yes").otherwise("no").alias("is_read"), F.coalesce("product_name", F.lit("")).alias("product_name"), F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("sent_at"))


@query("SELECT o_orderkey AS id, o_orderkey % 3 = 0 OR o_custkey = 7 AS is_read FROM orders")
def marked_read(spark, d):
    """SNK-06, SNK-12."""
    return catalog.updated(t.notifications(spark, d), F.col("user_id") == 7, {"is_read": F.lit(True)}).select("id", "is_read")


@query(f"""SELECT product_id, tag_id FROM {_TAGS} WHERE product_id % 10 <> 1 OR product_id % 30 = 11 UNION ALL SELECT p_partkey, unnest([1, 2])::BIGINT FROM part WHERE p_partkey % 10 = 1 AND p_partkey % 30 <> 11""")
def replaced_tags(spark, d):
    """SNK-08: a third of the requests name a tag that does not exist."""
    k = F.col("p_partkey")
    wanted = t.read(spark, d, "part").where(k % 10 == 1).select(k.alias("product_id"), F.explode(F.array(F.lit(1).cast("long"), F.when(k % 30 == 11, 99).otherwise(2).cast("long"))).alias("tag_id"))
    return catalog.replaced_set(t.product_tags(spark, d), wanted, "product_id", "tag_id", t.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("tag_id")))


@query(f""", {_URLS} SELECT product_id, seller_id, CASE WHEN seller_id % 2 = 0 THEN {_PICK(labels.MARKETPLACES, "'CUSTOM'")} ELSE 'N11' END AS marketplace FROM v""", "hc")
def marketplace_backfill(spark, d):
    """SNK-13: rows with CUSTOM take what their URL tells; others stay."""
    v = t.listing_urls(spark, d).withColumn("marketplace", F.when(F.col("seller_id") % 2 == 0, "CUSTOM").otherwise("N11"))
    own = F.coalesce(labels.marketplace_of(F.col("url")), F.col("marketplace"))
    return catalog.updated(v, F.col("marketplace") == "CUSTOM", {"marketplace": own}).select("product_id", "seller_id", "marketplace")


@query("SELECT product_id, count(*) AS kept FROM h JOIN p USING (product_id) WHERE status <> 'PAUSED' GROUP BY product_id", "hp")
def cascade_delete(spark, d):
    """SNK-07: paused products and their history go."""
    gone = t.tracked_products(spark, d).where("status = 'PAUSED'").select("product_id")
    left = lifecycle.without(t.price_history(spark, d), gone, ["product_id"])
    return left.groupBy("product_id").agg(F.count("*").alias("kept"))


@query(f"""SELECT product_id, coalesce(tags, '') AS tags, coalesce(rivals, '') AS rivals FROM p LEFT JOIN (SELECT product_id, string_agg(tag_id::VARCHAR, ',' ORDER BY tag_id) AS tags FROM {_TAGS} GROUP BY 1) USING (product_id)
    LEFT JOIN (SELECT product_id, string_agg(seller_id::VARCHAR, ',' ORDER BY price, seller_id) AS rivals FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price, seller_id) <= 3) GROUP BY 1) USING (product_id)""", "hpc")
def nested_products(spark, d):
    """SRC-03, JON-01, JON-06."""
    rn = F.row_number().over(Window.partitionBy("product_id").orderBy("price", "seller_id"))
    three = t.competitors(spark, d).select("product_id", "price", "seller_id", rn.alias("rn")).where("rn <= 3").drop("rn")
    n = catalog.nested(t.tracked_products(spark, d).select("product_id"), "product_id", {"tags": t.product_tags(spark, d), "rivals": three})
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",").alias(c)
    return n.select("product_id", joined("tags", "tag_id"), joined("rivals", "seller_id"))


@query("SELECT product_id, product_name FROM p WHERE product_id = 42", "p")
def point_lookup(spark, d):
    """SRC-02."""
    return t.tracked_products(spark, d).where("product_id = 42").select("product_id", "product_name").limit(1)


_PASTED = r"concat('https://a.example/', s_suppkey, chr(10), '  http://b.example/', s_suppkey % 3, chr(13), chr(10), 'ftp://c', chr(10), 'HTTPS://D.example')"


@query(f"""WITH x AS (SELECT s_suppkey AS user_id, unnest(list_filter(list_transform(string_split({_PASTED}, chr(10)), lambda s: trim(replace(s, chr(13), ''))), lambda s: starts_with(lower(s), 'http'))) AS url FROM supplier) SELECT user_id, url, url = 'http://b.example/1' AS tracked FROM x""")
def pasted_urls(spark, d):
    """SRC-09, JON-17: pasted lines and which of them the user already has."""
    s = F.col("s_suppkey").cast("string")
    pasted = F.concat(F.lit("https://a.example/"), s, F.lit("\n  http://b.example/"), (F.col("s_suppkey") % 3).cast("string"), F.lit("\r\nftp://c\nHTTPS://D.example"))
    rows = catalog.pasted_urls(t.read(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), pasted.alias("text")), "user_id", "text")
    tracked = spark.createDataFrame([("http://b.example/1", True)], "url string, tracked boolean")
    return rows.join(F.broadcast(tracked), "url", "left").select("user_id", "url", F.coalesce("tracked", F.lit(False)).alias("tracked"))


@query("""SELECT user_id, unnest(['COMPETITOR_CHEAPER', 'COMPETITOR_PRICE_CHANGE', 'OUT_OF_STOCK', 'BACK_IN_STOCK'][:CASE WHEN plan = 'FREE' THEN 3 ELSE 4 END]) AS rule_type FROM u WHERE user_id >= 50 AND user_id NOT IN (SELECT p_partkey % 50 FROM part WHERE p_partkey % 13 = 0)""", "u")
def default_rules(spark, d):
    """ALR-11: fixed default rules with their cooldowns."""
    defaults = [("COMPETITOR_CHEAPER", 30), ("COMPETITOR_PRICE_CHANGE", 30), ("OUT_OF_STOCK", 120), ("BACK_IN_STOCK", 15)]
    u = t.users(spark, d).select("user_id", lifecycle.limit_of(F.col("plan"), "rules").alias("slots"))
    return catalog.default_rules(u, t.alert_rules(spark, d), defaults).select("user_id", "rule_type")


_EFFECTIVE = "CASE WHEN plan <> 'FREE' AND plan_status = 'ACTIVE' AND (plan_expires_at IS NULL OR plan_expires_at + INTERVAL 3 DAY >= TIMESTAMP '2001-11-05') THEN plan ELSE 'FREE' END"
_ALLOWED = f"CASE {_EFFECTIVE} WHEN 'FREE' THEN ['EMAIL'] WHEN 'STARTER' THEN ['EMAIL', 'TELEGRAM'] ELSE ['EMAIL', 'TELEGRAM', 'WEBHOOK'] END"


@query(f"SELECT user_id AS alert_id, channel, CASE WHEN list_contains({_ALLOWED}, channel) THEN 'SEND' ELSE 'SKIPPED' END AS status FROM (SELECT *, unnest(['WEBHOOK', 'EMAIL', 'TELEGRAM']) AS channel FROM u)", "u")
def channel_deliveries(spark, d):
    """ALR-09, SET-05, SET-06."""
    wanted = F.array(*[F.lit(c) for c in ("WEBHOOK", "EMAIL", "TELEGRAM", "EMAIL")])
    u = t.users(spark, d).select(F.col("user_id").alias("alert_id"), wanted.alias("wanted"), lifecycle.limit_of(lifecycle.effective_plan(t.as_of()), "channels").alias("allowed"))
    return catalog.deliveries(u)


@query(f""", n AS (SELECT user_id AS id, user_id % 60 AS user_id, CASE WHEN user_id % 3 = 0 THEN user_id END AS product_id, CASE WHEN user_id % 2 = 0 THEN 'PRICE_DROP' ELSE 'NEW_TYPE' END AS rule_type, CASE WHEN user_id % 5 = 0 THEN ['WEBHOOK'] ELSE ['EMAIL'] END AS channels FROM u),
    r AS (SELECT c_custkey AS user_id, NULL::BIGINT AS product_id, unnest(['PRICE_DROP', 'a', 'b', 'c', 'd', 'e', 'f', 'g', 'h']) AS rule_type FROM customer WHERE c_custkey < 50 UNION ALL SELECT p_partkey % 50, p_partkey, 'PRICE_DROP' FROM part WHERE p_partkey % 13 = 0), k AS (SELECT user_id, count(*) AS held FROM r GROUP BY 1)
    SELECT n.id, n.user_id, n.rule_type, CASE WHEN n.product_id IS NULL AND n.rule_type = 'PRICE_DROP' AND n.user_id < 50 AND n.user_id > 0 THEN 'duplicate' WHEN channels = ['WEBHOOK'] AND NOT list_contains({_ALLOWED}, 'WEBHOOK') THEN 'channel' WHEN coalesce(held, 0) >= CASE {_EFFECTIVE} WHEN 'FREE' THEN 3 WHEN 'STARTER' THEN 20 WHEN 'PRO' THEN 100 ELSE 99999 END THEN 'limit' END AS problem FROM n JOIN u ON u.user_id = n.user_id LEFT JOIN k ON k.user_id = n.user_id""", "u")
def rule_problems(spark, d):
    """ALR-12."""
    k, plan = F.col("user_id"), lifecycle.effective_plan(t.as_of())
    u = t.users(spark, d)
    new = u.select(k.alias("id"), (k % 60).alias("user_id"), F.when(k % 3 == 0, k).alias("product_id"), F.when(k % 2 == 0, "PRICE_DROP").otherwise("NEW_TYPE").alias("rule_type"), F.when(k % 5 == 0, F.array(F.lit("WEBHOOK"))).otherwise(F.array(F.lit("EMAIL"))).alias("channels"))
    return catalog.rule_problems(new, t.alert_rules(spark, d), u.select("user_id", lifecycle.limit_of(plan, "channels").alias("allowed"), lifecycle.limit_of(plan, "rules").alias("slots")))


@query(f"""SELECT h.product_id, count(*) AS visible FROM h JOIN p USING (product_id) JOIN u USING (user_id) WHERE scraped_at >= {_NEW} - to_days(CASE {_EFFECTIVE} WHEN 'FREE' THEN 7 WHEN 'STARTER' THEN 30 WHEN 'PRO' THEN 365 ELSE 99999 END) GROUP BY 1""", "hpu")
def visible_history(spark, d):
    """RET-02: by the effective plan."""
    days = lifecycle.limit_of(lifecycle.effective_plan(t.as_of()), "history_days")
    owner = t.tracked_products(spark, d).select("product_id", "user_id").join(t.users(spark, d).select("user_id", *["plan", "plan_status", "plan_expires_at"]), "user_id").select("product_id", days.alias("days"))
    j = t.price_history(spark, d).join(owner, "product_id").where(F.col("scraped_at") >= t.as_of() - F.make_dt_interval(days=F.col("days")))
    return j.groupBy("product_id").agg(F.count("*").alias("visible"))


@query("""SELECT user_id, count(DISTINCT marketplace) AS marketplaces, string_agg(DISTINCT coalesce(CASE WHEN product_id % 3 > 0 THEN status END, 'unknown'), ',' ORDER BY coalesce(CASE WHEN product_id % 3 > 0 THEN status END, 'unknown')) AS kinds, count_if(status = 'ACTIVE') / count(*) * 100 AS active_share, count_if(status = 'ERROR') / count(*) * 100 AS error_share, count_if(status = 'PAUSED') / count(*) * 100 AS paused_share FROM p GROUP BY user_id""", "p")
def user_shares(spark, d):
    """AGG-16, AGG-19, AGG-25, AGG-26."""
    kind = F.coalesce(F.when(F.col("product_id") % 3 > 0, F.col("status")), F.lit("unknown"))
    share = lambda s: (F.try_divide(F.count_if(F.col("status") == s), F.count("*")) * 100).alias(s.lower() + "_share")
    return t.tracked_products(spark, d).groupBy("user_id").agg(F.countDistinct("marketplace").alias("marketplaces"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"), share("ACTIVE"), share("ERROR"), share("PAUSED"))


_METADATA = """CASE o_orderkey % 4 WHEN 0 THEN '{"rule_type": "PRICE_DROP", "product_id": "x' || o_orderkey || '"}' WHEN 1 THEN '{"rule_type": 5}' WHEN 2 THEN 'no json' END"""


@query(f"""SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 4 = 0 THEN 'PRICE_DROP' END) AS rule_type, CASE WHEN o_orderkey % 4 = 0 THEN 'x' || o_orderkey END AS product FROM orders""")
def notification_rows(spark, d):
    """PRJ-02: the joined row first, then the metadata, where it is a text."""
    k = F.col("id")
    meta = F.when(k % 4 == 0, F.concat(F.lit('{"rule_type": "PRICE_DROP", "product_id": "x'), k.cast("string"), F.lit('"}'))).when(k % 4 == 1, '{"rule_type": 5}').when(k % 4 == 2, "no json")
    v = F.try_parse_json(meta)
    label = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    return t.notifications(spark, d).select("id", F.coalesce(F.when(k % 5 == 0, F.col("rule_type")), label("$.rule_type")).alias("rule_type"), label("$.product_id").alias("product"))


@query()
def admissions(spark, d):
    """ENT-03: every user asks for ten URLs; tested against a plain version."""
    u = t.users(spark, d).where("user_id < 50")
    v = t.listing_urls(spark, d).where("seller_id % 7 = 0").join(t.tracked_products(spark, d).select("product_id", "user_id"), "product_id")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("product_id", "seller_id"))
    wanted = v.withColumn("n", n).where("n <= 10").withColumn("marketplace", F.coalesce(labels.marketplace_of(F.col("url")), F.lit("CUSTOM")))
    wanted = wanted.select("user_id", "n", "url", "marketplace", (F.col("n") % 4 == 0).alias("tracked"), labels.is_scraper_backed(labels.retailer_of(F.col("url"))).alias("supported"))
    plan = lifecycle.effective_plan(t.as_of())
    limits = u.select("user_id", (lifecycle.limit_of(plan, "products") - 1).alias("remaining"), lifecycle.limit_of(plan, "marketplaces").alias("marketplace_limit"), F.array(F.lit("N11")).alias("used"))
    return catalog.admissions(wanted, limits)


@query()
def alert_documents(spark, d):
    """SNK-09, SNK-11: a JSON document and a text for each alert candidate; blocks without data are left out."""
    from .queries import _evaluated

    e = _evaluated(spark, d, _day()).where("fired")
    p = t.tracked_products(spark, d).select("product_id", "product_name", "marketplace")
    j = e.join(p, "product_id")
    margin = F.when(F.col("cost").isNotNull(), F.struct("cost", (F.col("price") - F.col("cost")).alias("profit")))
    body = F.to_json(F.struct(
        F.when(F.col("rule_type") == "COMPETITOR_PRICE_CHANGE", "competitor_price_change").otherwise("price_change").alias("event"), F.struct(F.col("product_name").alias("name"), "marketplace").alias("product"),
        F.struct(F.col("price").alias("current"), F.col("previous_price").alias("previous"), F.col("price_change").alias("change"), F.col("price_change_pct").alias("changePercent")).alias("price"),
        margin.alias("margin"), F.when(F.col("min_price").isNotNull(), F.struct(F.col("min_price").alias("cheapestPrice"))).alias("competitor"), F.when(F.size("moves") > 0, F.col("moves")).alias("competitorChanges"),
    ))
    text_ = labels.alert_text(F.col("rule_type"), F.col("product_name"), F.col("previous_price"), F.col("price"), F.col("price_change_pct"), F.col("min_price"))
    return j.select("product_id", "l_orderkey", "l_linenumber", "rule_type", body.alias("body"), text_["title"].alias("title"), text_["message"].alias("message"))
