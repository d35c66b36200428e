"""Queries of what an account's pages list: rules, tracked URLs, sellers, badges, plans, images, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, search
from ..operators import lifecycle, reports
from ..sources import tables as t
from .labels import _URLS
from .queries import query

_KINDS = "['PRICE_DROP', 'PRICE_INCREASE', 'PRICE_THRESHOLD', 'PERCENTAGE_CHANGE', 'OUT_OF_STOCK', 'BACK_IN_STOCK', 'COMPETITOR_CHEAPER', 'COMPETITOR_PRICE_CHANGE', 'LOW_MARGIN']"


@query(f"""WITH r AS (SELECT c_custkey AS user_id, NULL::BIGINT AS product_id, unnest({_KINDS}) AS rule_type, true AS is_active FROM customer WHERE c_custkey < 50 UNION ALL SELECT p_partkey % 50, p_partkey, 'PRICE_DROP', p_partkey % 26 <> 0 FROM part WHERE p_partkey % 13 = 0),
    s AS (SELECT o_custkey AS user_id, {_KINDS}[1 + o_orderkey % 9] AS rule_type, max(o_orderdate)::DATE AS last_triggered FROM orders WHERE o_orderkey % 9 <> 2 GROUP BY ALL),
    j AS (SELECT r.*, CASE WHEN product_id IS NULL OR product_id % 2 = 0 THEN last_triggered END AS last_triggered, CASE WHEN product_id IS NULL THEN 'u' || r.user_id ELSE 'p' || product_id END || ':' || rule_type AS rule_id FROM r LEFT JOIN s USING (user_id, rule_type)),
    f AS (SELECT *, unnest(['all', 'active', 'inactive', 'recent']) AS shown FROM j)
    SELECT shown, user_id, rule_id, last_triggered, row_number() OVER (PARTITION BY shown, user_id ORDER BY product_id IS NOT NULL, last_triggered DESC NULLS LAST, rule_id) AS place FROM f WHERE CASE shown WHEN 'active' THEN is_active WHEN 'inactive' THEN NOT is_active WHEN 'recent' THEN last_triggered IS NOT NULL ELSE true END
    AND contains(replace(replace(rule_type || ' ' || coalesce(product_id::VARCHAR, ''), 'I', 'ı'), 'İ', 'i').lower(), 'prıce')""")
def rule_lists(spark, d):
    """FLT-11, SRT-11: each user's rules under every filter and a search text, global ones first, then those that fired last."""
    kind = F.element_at(F.array(*[F.lit(k) for k in t.RULE_TYPES]), (1 + F.col("id") % 9).cast("int"))
    sent = t.notifications(spark, d).where("id % 9 <> 2").groupBy("user_id", kind.alias("rule_type")).agg(F.max("sent_at").alias("sent"))
    r = t.alert_rules(spark, d).join(sent, ["user_id", "rule_type"], "left")
    r = r.withColumn("last_triggered", F.when(F.col("product_id").isNull() | (F.col("product_id") % 2 == 0), F.col("sent")))
    out = None
    for shown in ("all", "active", "inactive", "recent"):
        one = reports.rule_list(r, shown, "PRICE").select(F.lit(shown).alias("shown"), "user_id", "rule_id", "last_triggered", "place")
        out = one if out is None else out.unionByName(one)
    return out


@query(f""", {_URLS}, own AS (SELECT product_id % 50 AS user_id, url FROM v WHERE seller_id % 2 = 0) SELECT product_id, seller_id, product_id % 50 AS user_id FROM v WHERE (product_id % 50, url) IN (SELECT (user_id, url) FROM own)""", "hc")
def tracked_urls(spark, d):
    """JON-17: of pasted URLs those that their user tracks."""
    v = t.listing_urls(spark, d).withColumn("user_id", F.col("product_id") % 50)
    return v.join(v.where("seller_id % 2 = 0").select("user_id", "url"), ["user_id", "url"], "left_semi").select("product_id", "seller_id", "user_id")


@query("SELECT product_id, string_agg(DISTINCT coalesce(CASE WHEN seller_id % 7 <> 0 THEN 'Shop ' || seller_id END, 'unknown'), ',' ORDER BY coalesce(CASE WHEN seller_id % 7 <> 0 THEN 'Shop ' || seller_id END, 'unknown')) AS sellers FROM h GROUP BY 1", "h")
def seller_lists(spark, d):
    """AGG-25: the sellers of a product's history; rows without one are of an unknown seller."""
    s = F.col("seller_id")
    name = F.coalesce(F.when(s % 7 != 0, F.concat(F.lit("Shop "), s.cast("string"))), F.lit("unknown"))
    return t.price_history(spark, d).groupBy("product_id").agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("sellers"))


@query("""SELECT id, CASE WHEN status = 'FAILED' THEN 'failed' WHEN status = 'SKIPPED' AND NOT (error <> '' AND regexp_matches(error, '^[^·]*E-posta uyarıları kapalı[^·]*( · [^·]*E-posta uyarıları kapalı[^·]*)*$')) THEN 'channel-not-set' WHEN status = 'SKIPPED' AND error IS NULL THEN 'channel-not-set' END AS badge FROM
    (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'SENT' WHEN 'O' THEN 'FAILED' ELSE 'SKIPPED' END AS status, CASE o_orderkey % 5 WHEN 0 THEN 'EMAIL: E-posta uyarıları kapalı' WHEN 1 THEN 'EMAIL: E-posta uyarıları kapalı · TELEGRAM: yok' WHEN 2 THEN 'E-posta uyarıları kapalı · X: E-posta uyarıları kapalı' WHEN 3 THEN '' END AS error FROM orders)""")
def delivery_badges(spark, d):
    """CSE-13: a skip that the user chose has no badge."""
    k = F.col("id")
    error = F.when(k % 5 == 0, "EMAIL: E-posta uyarıları kapalı").when(k % 5 == 1, "EMAIL: E-posta uyarıları kapalı · TELEGRAM: yok").when(k % 5 == 2, "E-posta uyarıları kapalı · X: E-posta uyarıları kapalı").when(k % 5 == 3, "")
    return t.notifications(spark, d).select("id", labels.delivery_badge(F.col("status"), error, ["E-posta uyarıları kapalı"]).alias("badge"))


@query("""SELECT user_id, feature, CASE feature WHEN 'bulk' THEN 'STARTER' WHEN 'tags' THEN 'STARTER' WHEN 'analytics' THEN 'PRO' WHEN 'auto_rules' THEN 'PRO' ELSE 'ENTERPRISE' END AS least_plan, CASE WHEN feature IN ('bulk', 'tags') THEN plan <> 'FREE' WHEN feature IN ('analytics', 'auto_rules') THEN plan IN ('PRO', 'ENTERPRISE') ELSE plan = 'ENTERPRISE' END AS held
    FROM (SELECT user_id, plan, unnest(['bulk', 'tags', 'analytics', 'auto_rules', 'api']) AS feature FROM u)""", "u")
def feature_plans(spark, d):
    """ENT-02: each user's features: the least plan that has one, and whether their own is as high."""
    u = t.users(spark, d).select("user_id", "plan", F.explode(F.array(*[F.lit(x) for x in ("bulk", "tags", "analytics", "auto_rules", "api")])).alias("feature"))
    least = lifecycle.least_plan(F.col("feature"))
    order = F.array(*[F.lit(p) for p in lifecycle.PLANS])
    return u.select("user_id", "feature", least.alias("least_plan"), (F.array_position(order, F.col("plan")) >= F.array_position(order, least)).alias("held"))


_IMAGES = ['"/a%d.jpg"', '["/b%d.jpg", "/x.jpg"]', '{"contentUrl": ["/c%d.jpg"]}', '{"contentUrl": "/d%d.jpg", "url": "/x"}', '{"url": "/e%d.jpg"}', '[{"url": "/f%d.jpg"}]', '{"src": "/g%d.jpg"}', 'null', 'broken', '[]', '{"contentUrl": " "}']
_IMAGE_SQL = f"""WITH g AS (SELECT page_id, replace([{", ".join(f"'{x}'" for x in _IMAGES)}][1 + page_id % {len(_IMAGES)}], '%d', page_id::VARCHAR) AS x FROM pages), j AS (SELECT page_id, CASE WHEN json_valid(x) THEN x::JSON END AS j FROM g)
    SELECT page_id, coalesce(CASE WHEN json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$') END, CASE WHEN json_type(j, '$[0]') = 'VARCHAR' THEN json_extract_string(j, '$[0]') END, json_extract_string(j, '$.contentUrl[0]'), nullif(trim(json_extract_string(j, '$.contentUrl')), ''), json_extract_string(j, '$.url'), json_extract_string(j, '$.src'), json_extract_string(j, '$[0].url')) AS image,
    CASE page_id % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'og' END AS title, substring(sha1(page_id::VARCHAR), 1, 16) AS hash FROM j"""


@query(_IMAGE_SQL)
def page_images(spark, d):
    """ARR-01, EXT-14, URL-05: an image from a text, list or object; the first text that isn't blank; the short SHA-1."""
    k = F.col("page_id")
    json = F.replace(F.element_at(F.array(*[F.lit(x) for x in _IMAGES]), (1 + k % len(_IMAGES)).cast("int")), F.lit("%d"), k.cast("string"))
    texts = F.array(F.lit(None).cast("string"), F.lit("  "), F.when(k % 3 == 0, " first "), F.when(k % 3 < 2, "og"))
    return t.read(spark, d, "pages").select("page_id", search.image_of(json).alias("image"), search.first_text(texts).alias("title"), labels.sha1_key(k.cast("string")).alias("hash"))


_NAMES = ["amazontr", "Trendyolürünü", "TRENDYOL ürünü", "media  markt", "Pttavm product", "Diğer", "ab", "iPhone 15", "Hepsiburada telefon", "n11 urunu x1", "AMAZON TR", "çiçeksepetiurunu", "vatan bilgisayar 5", ""]


@query(f"""WITH n AS (SELECT p_partkey AS product_id, [{", ".join(f"'{x}'" for x in _NAMES)}][1 + p_partkey % {len(_NAMES)}] AS name FROM part) SELECT product_id, length(trim(name)) < 3 OR regexp_matches(name, '(?i)^(trendyol|hepsiburada|amazon(\\s*tr)?|n11|pazarama|teknosa|vatan|media\\s*markt|mediamarkt|decathlon|ptt\\s*avm|çiçeksepeti|ciceksepeti|akakçe|akakce|cimri|epey|boyner|gratis|watsons|kitapyurdu|sephora|koçtaş|koctas|itopya|diğer|diger)\\s*(ürünü|urunu|product)?$') AS generic FROM n""")
def generic_names(spark, d):
    """STR-11: names that tell no product, also those that are written together."""
    k = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (1 + k % len(_NAMES)).cast("int"))
    return t.read(spark, d, "part").select(k.alias("product_id"), search.is_generic(name).alias("generic"))
