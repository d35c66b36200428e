"""Queries of the price-intelligence operators, and independent SQL for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, prices, text
from ..operators import alerts, lifecycle, quality, reports, timeseries
from ..sources import tables as t

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_CTE = {
    "h": """h AS (SELECT l_partkey AS product_id, l_suppkey AS seller_id, l_extendedprice / l_quantity AS price, l_orderkey, l_linenumber,
        TIMESTAMP '2001-11-05' - to_seconds(480 * date_diff('day', l_shipdate::DATE, DATE '2001-11-05')) AS scraped_at, l_returnflag <> 'R' AS in_stock FROM lineitem)""",
    "p": """p AS (SELECT p_partkey AS product_id, p_partkey % 50 AS user_id, p_name || ' ' || p_brand AS product_name, p_type AS marketplace,
        CASE WHEN p_partkey % 29 <> 0 THEN p_retailprice END AS current_price, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice * (60 + p_size) / 100.0 END AS cost,
        CASE p_partkey % 10 WHEN 0 THEN 'PAUSED' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'OUT_OF_STOCK' ELSE 'ACTIVE' END AS status FROM part)""",
    "c": """c AS (SELECT product_id, seller_id, price, scraped_at AS last_scraped_at,
        CASE WHEN (product_id + seller_id) % 6 <> 0 THEN 40 + (product_id * 31 + seller_id * 17) % 61 END AS match_score
        FROM h QUALIFY row_number() OVER (PARTITION BY product_id, seller_id ORDER BY scraped_at DESC, l_orderkey DESC, l_linenumber DESC) = 1)""",
    "u": """u AS (SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'FREE' WHEN 1 THEN 'STARTER' WHEN 2 THEN 'PRO' ELSE 'ENTERPRISE' END AS plan,
        CASE WHEN c_custkey % 5 = 0 THEN 'EXPIRED' ELSE 'ACTIVE' END AS plan_status,
        CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '2001-11-05' + to_days(CAST(c_custkey % 21 - 10 AS INTEGER)) END AS plan_expires_at FROM customer)""",
    "m": """m AS (SELECT *, CASE WHEN previous_price > 0 THEN price - previous_price END AS price_change, CASE WHEN previous_price > 0 THEN (price - previous_price) / previous_price * 100 END AS price_change_pct
        FROM (SELECT *, lag(price) OVER w AS previous_price, lag(in_stock) OVER w AS previous_stock FROM h WINDOW w AS (PARTITION BY product_id ORDER BY scraped_at, l_orderkey, l_linenumber)))""",
    # leave-one-out medians by a self-join over the survivors of the first pass
    "a": """a1 AS (SELECT c.*, p.current_price AS own_price,
          NOT (price > 0) AS np, coalesce(match_score < 70, false) AS ls, coalesce(price < 0.3 * current_price OR price > 3 * current_price, false) AS ob,
          last_scraped_at < TIMESTAMP '2001-11-05' - INTERVAL 72 HOUR AS st FROM c LEFT JOIN p USING (product_id)),
        a2 AS (SELECT * FROM a1 WHERE NOT (np OR ls OR ob OR st)),
        a3 AS (SELECT x.product_id, x.seller_id, x.price, count(*) AS peers, median(y.price) AS med, arg_min(y.price, [abs(y.price - x.price), y.price]) AS near
          FROM a2 x JOIN a2 y ON x.product_id = y.product_id AND x.seller_id <> y.seller_id GROUP BY ALL),
        a4 AS (SELECT product_id, seller_id FROM a3 WHERE peers >= 4 AND ((price < 0.45 * med AND near / price >= 1.8) OR (price > 2.75 * med AND price / near >= 1.5))),
        a AS (SELECT a1.*, a4.seller_id IS NOT NULL AS po, NOT (np OR ls OR ob OR st) AND a4.seller_id IS NULL AS usable FROM a1 LEFT JOIN a4 USING (product_id, seller_id))""",
    "g": """g AS (SELECT product_id, any_value(own_price) AS own_price, count_if(usable) AS usable, count_if(usable AND price < own_price) AS cheaper,
        min(price) FILTER (usable) AS min_price FROM a GROUP BY product_id)""",
}
_NEEDS = {"c": "h", "m": "h", "a": "hcp", "g": "hcpa"}


def _with(names: str, body: str) -> str:
    wanted = {x for n in names for x in _NEEDS.get(n, "") + n}
    return "WITH RECURSIVE " + ", ".join(v for k, v in _CTE.items() if k in wanted) + " " + body  # a body may go on with views of its own


def query(sql: str | None = None, views: str = ""):
    """Register a query under its function's name, with its SQL over the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _with(views, sql) if views else sql
        return f

    return add


def _assessed(spark: SparkSession, d: str) -> DataFrame:
    return quality.assess(t.competitors(spark, d), t.tracked_products(spark, d), t.as_of())


def _moves(spark: SparkSession, d: str, since: Column | None = None) -> DataFrame:
    h = t.price_history(spark, d)
    return timeseries.moves(h, ["product_id"]) if since is None else timeseries.recent_moves(t.dealt(h), ["product_id"], since)


def _day() -> Column:
    return t.as_of() - F.make_dt_interval(hours=F.lit(24))


_DAY = "TIMESTAMP '2001-11-05' - INTERVAL 24 HOUR"


@query("SELECT product_id, own_price, usable, cheaper, min_price, CASE WHEN own_price > min_price THEN (own_price - min_price) / own_price * 100 ELSE 0.0 END AS gap_pct FROM g ORDER BY cheaper DESC, gap_pct DESC, product_id LIMIT 5", "g")
def pressure_top5(spark, d):
    return quality.pressure(_assessed(spark, d)).orderBy(F.desc("cheaper"), F.desc("gap_pct"), "product_id").limit(5)


@query("""SELECT product_id, seller_id, usable, CASE WHEN po THEN 'peer-outlier' ELSE concat_ws(',', CASE WHEN np THEN 'no-price' END, CASE WHEN ls THEN 'low-score' END, CASE WHEN ob THEN 'out-of-band' END, CASE WHEN st THEN 'stale' END) END AS issues FROM a""", "a")
def competitor_assessment(spark, d):
    return _assessed(spark, d).select("product_id", "seller_id", "usable", F.array_join("issues", ",").alias("issues"))


@query("SELECT product_id, scraped_at, l_orderkey, l_linenumber, price, previous_price, price_change, price_change_pct FROM m WHERE price_change IS NOT NULL AND price_change <> 0", "m")
def price_moves(spark, d):
    return _moves(spark, d).where("price_change IS NOT NULL AND price_change <> 0").select("product_id", "scraped_at", "l_orderkey", "l_linenumber", "price", "previous_price", "price_change", "price_change_pct")


@query("SELECT product_id, scraped_at, l_orderkey, l_linenumber, CASE WHEN in_stock THEN 'back' ELSE 'out' END AS transition FROM m WHERE previous_stock IS NOT NULL AND previous_stock <> in_stock", "m")
def stock_transitions(spark, d):
    return _moves(spark, d).where("previous_stock IS NOT NULL AND previous_stock <> in_stock").select("product_id", "scraped_at", "l_orderkey", "l_linenumber", F.when(F.col("in_stock"), "back").otherwise("out").alias("transition"))


@query("""SELECT product_id, seller_id, l_orderkey, l_linenumber, price FROM (SELECT *, lag(price) OVER (PARTITION BY product_id, seller_id ORDER BY scraped_at, l_orderkey, l_linenumber) AS q FROM h) WHERE q > 0 AND price > 0 AND abs((price - q) / q * 100) > 90""", "h")
def implausible_moves(spark, d):
    return timeseries.implausible(t.price_history(spark, d), ["product_id", "seller_id"]).select("product_id", "seller_id", "l_orderkey", "l_linenumber", "price")


_RECENT = "scraped_at >= " + _DAY + " AND price_change_pct IS NOT NULL AND NOT (price_change = 0)"


@query(f"SELECT product_id, price, price_change_pct FROM (SELECT * FROM m WHERE {_RECENT} QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, l_orderkey DESC, l_linenumber DESC) = 1) ORDER BY abs(price_change_pct) DESC, product_id LIMIT 5", "m")
def movers_top5(spark, d):
    recent = _moves(spark, d, _day()).where(F.col("price_change_pct").isNotNull() & ~(F.col("price_change") == 0))
    return timeseries.movers(recent).select("product_id", "price", "price_change_pct")


@query(f"""SELECT product_id, price, price_change_pct FROM (SELECT * FROM (SELECT * FROM m WHERE {_RECENT} ORDER BY scraped_at DESC, l_orderkey DESC, l_linenumber DESC, product_id DESC LIMIT 50)
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, l_orderkey DESC, l_linenumber DESC) = 1) ORDER BY abs(price_change_pct) DESC, product_id LIMIT 5""", "m")
def movers_prelimit50(spark, d):
    recent = _moves(spark, d, _day()).where(F.col("price_change_pct").isNotNull() & ~(F.col("price_change") == 0))
    return timeseries.movers(recent, prelimit=50).select("product_id", "price", "price_change_pct")


@query("SELECT product_id, l_orderkey, l_linenumber, price, row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM h QUALIFY rn <= 2", "h")
def latest_two_history(spark, d):
    return t.newest(t.price_history(spark, d), ["product_id"], 2).select("product_id", "l_orderkey", "l_linenumber", "price", "rn")


@query("SELECT product_id, seller_id, price, match_score, last_scraped_at FROM c", "c")
def history_dedup(spark, d):
    return t.competitors(spark, d)


@query("""SELECT period, count(*) FILTER (price_change <> 0) AS changes, count(DISTINCT product_id) FILTER (price_change <> 0) AS products, (SELECT count(*) FROM p LEFT JOIN (SELECT product_id, max(scraped_at) AS ts FROM h GROUP BY 1) USING (product_id) WHERE ts IS NULL OR ts < TIMESTAMP '2001-11-05' - INTERVAL 24 HOUR) AS stale,
    (SELECT count(*) FROM g WHERE cheaper > 0) AS pressure FROM m, (VALUES ('today', 24), ('7d', 168), ('30d', 720)) v(period, hours) WHERE scraped_at >= TIMESTAMP '2001-11-05' - to_hours(hours) GROUP BY period""", "mpg")
def period_report(spark, d):
    day = t.as_of() - F.make_dt_interval(hours=F.lit(24))
    stale = t.tracked_products(spark, d).join(_last(spark, d), "product_id", "left").agg(F.count_if(F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") < day)).alias("n"))
    pressed = quality.pressure(_assessed(spark, d)).agg(F.count_if(F.col("cheaper") > 0).alias("n"))
    return reports.period_report(_moves(spark, d, t.as_of() - F.make_dt_interval(days=F.lit(30))), t.as_of()).select("*", stale.scalar().alias("stale"), pressed.scalar().alias("pressure"))


@query(f"SELECT product_id, count_if(price_change IS NOT NULL AND price_change <> 0) AS moves, max(abs(coalesce(price_change_pct, 0.0))) AS max_pct FROM m WHERE scraped_at >= {_DAY} GROUP BY product_id ORDER BY moves DESC, max_pct DESC, product_id LIMIT 5", "m")
def most_moving_top5(spark, d):
    return reports.most_moving(_moves(spark, d, _day()), _day())


@query("""SELECT p.product_id, CAST(l.ts IS NULL OR l.ts < TIMESTAMP '2001-11-05' - INTERVAL 24 HOUR AS INT) + CAST(current_price IS NULL AS INT) + CAST(status = 'ERROR' AS INT) AS issue_score
    FROM p LEFT JOIN (SELECT product_id, max(scraped_at) AS ts FROM h GROUP BY product_id) l USING (product_id) ORDER BY issue_score DESC, product_id LIMIT 5""", "hp")
def data_issues_top5(spark, d):
    last = t.price_history(spark, d).groupBy("product_id").agg(F.max("scraped_at").alias("ts"))
    j = t.tracked_products(spark, d).join(last, "product_id", "left")
    score = (F.col("ts").isNull() | (F.col("ts") < _day())).cast("int") + F.col("current_price").isNull().cast("int") + (F.col("status") == "ERROR").cast("int")
    return j.select("product_id", score.alias("issue_score")).orderBy(F.desc("issue_score"), "product_id").limit(5)


@query("""SELECT o_custkey AS user_id, count(*) AS alerts FROM orders JOIN u ON u.user_id = o_custkey WHERE o_orderstatus = 'F' GROUP BY o_custkey ORDER BY alerts DESC, o_custkey LIMIT 5""", "u")
def most_alerts_top5(spark, d):
    n = t.notifications(spark, d).where("status = 'SENT'").groupBy("user_id").agg(F.count("*").alias("alerts"))
    return n.join(t.users(spark, d).select("user_id"), "user_id").orderBy(F.desc("alerts"), "user_id").limit(5)


@query(f"""SELECT (SELECT count(*) FROM p) AS products, (SELECT count_if(status = 'ACTIVE') FROM p) AS active, (SELECT count(*) FROM m WHERE scraped_at > {_DAY} AND price_change IS NOT NULL AND price_change <> 0) AS changes_24h,
    (SELECT count_if(o_orderkey % 3 <> 0) FROM orders) AS unread""", "pm")
def dashboard_stats(spark, d):
    p = t.tracked_products(spark, d).agg(F.count("*").alias("products"), F.count_if(F.col("status") == "ACTIVE").alias("active"))
    m = _moves(spark, d, _day()).where((F.col("scraped_at") > _day()) & F.col("price_change").isNotNull() & (F.col("price_change") != 0)).agg(F.count("*").alias("changes_24h"))
    n = t.notifications(spark, d).agg(F.count_if(~F.col("is_read")).alias("unread"))
    return p.select("*", m.scalar().alias("changes_24h"), n.scalar().alias("unread"))


@query("SELECT 'status' AS kind, status AS key, count(*) AS n FROM p GROUP BY status UNION ALL SELECT 'plan', plan, count(*) FROM u GROUP BY plan UNION ALL SELECT 'marketplace', marketplace, count(*) FROM p GROUP BY marketplace", "pu")
def admin_stats(spark, d):
    p, u = t.tracked_products(spark, d), t.users(spark, d)
    one = lambda df, c: df.groupBy(F.lit(c).alias("kind"), F.col(c).alias("key")).agg(F.count("*").alias("n"))
    return one(p, "status").unionByName(one(u, "plan")).unionByName(one(p, "marketplace"))


_MARKET = """s AS (SELECT marketplace, count(*) AS total, count_if(status = 'ACTIVE') AS active, count_if(status = 'ERROR') AS error, count_if(status = 'PAUSED') AS paused FROM p GROUP BY 1),
    l AS (SELECT marketplace, count(*) AS listings, nullif(avg(match_score), 0) AS score FROM c JOIN p USING (product_id) GROUP BY 1),
    o AS (SELECT marketplace, count(*) AS observations FROM h JOIN p USING (product_id) WHERE scraped_at >= TIMESTAMP '2001-11-05' - INTERVAL 168 HOUR GROUP BY 1),
    k AS (SELECT marketplace, total, active, error, paused, coalesce(listings, 0) AS listings, CAST(floor(score + 0.5) AS BIGINT) AS avg_score, coalesce(observations, 0) AS observations,
      CAST(floor(100.0 * active / total + 0.5) AS BIGINT) AS success_rate, CAST(floor(100.0 * error / total + 0.5) AS BIGINT) AS error_rate FROM s LEFT JOIN l USING (marketplace) LEFT JOIN o USING (marketplace))"""


def _market(spark, d):
    week = t.as_of() - F.make_dt_interval(hours=F.lit(168))
    return reports.marketplace_stats(t.tracked_products(spark, d), t.competitors(spark, d), t.price_history(spark, d), week)


@query(", " + _MARKET + " SELECT * FROM k", "hpc")
def marketplace_stats(spark, d):
    return _market(spark, d)


@query(", " + _MARKET + " SELECT count(*) AS marketplaces, sum(total)::BIGINT AS total, sum(active)::BIGINT AS active, sum(listings)::BIGINT AS listings, CAST(floor(avg(avg_score) + 0.5) AS BIGINT) AS avg_score, CAST(floor(100.0 * sum(active) / sum(total) + 0.5) AS BIGINT) AS success_rate FROM k", "hpc")
def marketplace_summary(spark, d):
    return reports.marketplace_summary(_market(spark, d))


@query("""SELECT product_id, count(*) AS usable, least(min(price), any_value(own_price)) AS min_price, greatest(max(price), any_value(own_price)) AS max_price,
    round((sum(price) + coalesce(any_value(own_price), 0)) / (count(*) + CAST(any_value(own_price) IS NOT NULL AS INT)), 6) AS avg_price,
    CASE WHEN count(*) >= 3 THEN round(list_sum(list_sort(list(price))[1:3]) / 3, 6) END AS top3_avg,
    CASE WHEN count(*) >= 2 AND any_value(own_price) IS NOT NULL THEN count_if(price < own_price) + 1 END AS own_rank FROM a WHERE usable GROUP BY product_id""", "a")
def market_position(spark, d):
    return quality.market_position(_assessed(spark, d))


@query("SELECT product_id, arg_min(seller_id, [abs(price - own_price), price, seller_id]) AS seller_id, arg_min(price, [abs(price - own_price), price, seller_id]) AS price FROM a WHERE usable AND own_price IS NOT NULL GROUP BY product_id", "a")
def nearest_competitor(spark, d):
    return quality.nearest_competitor(_assessed(spark, d))


@query("""SELECT product_id, current_price - cost AS profit, (current_price - cost) / current_price * 100 AS margin_pct,
    CASE WHEN (current_price - cost) / current_price * 100 < 0 THEN 'loss' WHEN (current_price - cost) / current_price * 100 < 10 THEN 'thin' WHEN (current_price - cost) / current_price * 100 < 25 THEN 'healthy' ELSE 'strong' END AS band
    FROM p WHERE current_price > 0 AND cost >= 0""", "p")
def margin_report(spark, d):
    return reports.margin_report(t.tracked_products(spark, d))


@query("""SELECT product_id, cheapest, CASE WHEN cheapest > 1 THEN cheapest - 1 END AS undercut, cost / 0.9 AS floor, CASE WHEN cost IS NOT NULL THEN greatest(cheapest - 1, cost / 0.9) ELSE NULLIF(cheapest - 1, NULL) END AS protected,
    coalesce(cheapest - 1 < cost / 0.9, false) AS breaches_floor FROM p JOIN (SELECT product_id, min(price) AS cheapest FROM a WHERE usable GROUP BY 1) USING (product_id)""", "pa")
def price_suggestion(spark, d):
    return reports.price_suggestion(_assessed(spark, d), t.tracked_products(spark, d))


@query("""SELECT product_id, day, count(*) FILTER (NOT own) AS sellers, min(price) FILTER (NOT own) AS min_price, (sum(price::DECIMAL(28, 9)) FILTER (NOT own))::DOUBLE / nullif(count(*) FILTER (NOT own), 0) AS avg_price, arg_max(price, nth) FILTER (own) AS own_price
    FROM (SELECT *, row_number() OVER (PARTITION BY product_id, day ORDER BY first_at, first_order, first_line) AS nth FROM (SELECT product_id, scraped_at::DATE AS day, seller_id, (product_id + seller_id) % 4 = 0 AS own, price,
      first_value(scraped_at) OVER w AS first_at, first_value(l_orderkey) OVER w AS first_order, first_value(l_linenumber) OVER w AS first_line FROM h WINDOW w AS (PARTITION BY product_id, scraped_at::DATE, seller_id ORDER BY scraped_at, l_orderkey, l_linenumber)
    QUALIFY row_number() OVER (PARTITION BY product_id, scraped_at::DATE, seller_id ORDER BY scraped_at DESC, l_orderkey DESC, l_linenumber DESC) = 1)) GROUP BY ALL""", "h")
def daily_price_chart(spark, d):
    return timeseries.daily(t.price_history(spark, d), t.is_own())


@query("""SELECT product_id, coalesce(current_price, last_price) AS price, current_price IS NULL AND last_price IS NOT NULL AS is_stale FROM p LEFT JOIN (SELECT product_id, price AS last_price FROM h WHERE (product_id + seller_id) % 4 = 0 AND price > 0
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, l_orderkey DESC, l_linenumber DESC) = 1) USING (product_id)""", "hp")
def own_price_asof(spark, d):
    """JON-15: the newest price of the own listing stands in for a missing one."""
    own = t.price_history(spark, d).where(t.is_own() & prices.positive(F.col("price")).isNotNull())
    last = own.groupBy("product_id").agg(F.max_by("price", F.struct(*timeseries.ORDER)).alias("last_price"))
    stale = F.col("current_price").isNull() & F.col("last_price").isNotNull()
    return t.tracked_products(spark, d).join(last, "product_id", "left").select("product_id", F.coalesce("current_price", "last_price").alias("price"), stale.alias("is_stale"))


@query("""SELECT product_id, coalesce(usable, 0) = 0 AS no_competitor, coalesce(current_price > min_price, false) AS cheaper_competitor, coalesce((current_price - cost) / current_price * 100 < 10, false) AS loss, status = 'ACTIVE' AS active,
    ts IS NULL OR ts < TIMESTAMP '2001-11-05' - INTERVAL 24 HOUR AS stale, coalesce(pc <> 0, false) AS changed FROM p LEFT JOIN g USING (product_id) LEFT JOIN (SELECT product_id, max(scraped_at) AS ts, max_by(price_change, [epoch(scraped_at), l_orderkey, l_linenumber]) AS pc FROM m GROUP BY 1) USING (product_id)""", "gpm")
def catalog_filtered(spark, d):
    last = _moves(spark, d).groupBy("product_id").agg(F.max("scraped_at").alias("ts"), F.max_by("price_change", F.struct(*timeseries.ORDER)).alias("change"))
    return reports.quick_filters(quality.pressure(_assessed(spark, d)), t.tracked_products(spark, d), last, _day())


@query("SELECT product_id, (own_price - min_price) / min_price AS gap FROM g ORDER BY gap DESC NULLS LAST, product_id LIMIT 50", "g")
def catalog_gap_sort(spark, d):
    return reports.catalog_gap(_assessed(spark, d))


_TAGS = "(SELECT DISTINCT p_partkey AS product_id, unnest([p_partkey % 25, p_size % 25])::BIGINT AS tag_id FROM part)"


@query(f"SELECT product_id, product_name FROM p WHERE product_id IN (SELECT product_id FROM {_TAGS} WHERE tag_id = 7)", "p")
def tag_filter_semi(spark, d):
    return t.tracked_products(spark, d).join(t.product_tags(spark, d).where("tag_id = 7"), "product_id", "left_semi").select("product_id", "product_name")


@query(f"SELECT n_nationkey AS tag_id, count(product_id) AS products FROM nation LEFT JOIN {_TAGS} x ON x.tag_id = n_nationkey GROUP BY n_nationkey")
def tags_with_counts(spark, d):
    n = t.product_tags(spark, d).groupBy("tag_id").agg(F.count("*").alias("n"))
    return t.read(spark, d, "nation").select(F.col("n_nationkey").alias("tag_id")).join(n, "tag_id", "left").select("tag_id", F.coalesce("n", F.lit(0)).alias("products"))


@query("SELECT o_orderkey AS id, o_custkey AS user_id FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def notifications_page(spark, d):
    return reports.page(t.notifications(spark, d).where("NOT is_read"), [F.desc("sent_at"), F.desc("id")], 40, 20).select("id", "user_id")


#: Ties go up: a multiple of an eighth is moved past one.
_FIXED = lambda d, x: f"printf('%.{d}f', CASE WHEN ({x}) * 8 = floor(({x}) * 8) THEN ({x}) + sign({x}) * 1e-9 ELSE {x} END)"


@query(f"""SELECT p.product_id, concat_ws(',', CASE WHEN regexp_matches(product_name, '[",]') THEN '"' || replace(product_name, '"', '""') || '"' ELSE product_name END, marketplace, CASE WHEN current_price <> 0 THEN {_FIXED(2, 'current_price')} ELSE '' END, CASE WHEN cost <> 0 THEN {_FIXED(2, 'cost')} ELSE '' END,
    CASE WHEN current_price > 0 AND cost > 0 THEN {_FIXED(2, 'current_price - cost')} ELSE '' END, CASE WHEN current_price > 0 AND cost > 0 THEN {_FIXED(1, '(current_price - cost) / current_price * 100')} ELSE '' END, coalesce(n, 0), coalesce(strftime(last_at, '%Y-%m-%dT%H:%M:%S.%gZ'), ''), status, x.tags, 'https://shop.example.com/p-' || p.product_id) AS line
    FROM p JOIN (SELECT product_id, string_agg(tag_id::VARCHAR, ' | ' ORDER BY tag_id) AS tags FROM {_TAGS} GROUP BY 1) x USING (product_id) LEFT JOIN (SELECT product_id, count(*) AS n FROM c GROUP BY 1) USING (product_id) LEFT JOIN (SELECT product_id, max(scraped_at) AS last_at FROM h GROUP BY 1) USING (product_id)""", "pc")
def product_export(spark, d):
    """SNK-01, SNK-02: all eleven columns."""
    url = F.concat(F.lit("https://shop.example.com/p-"), F.col("product_id").cast("string"))
    return reports.product_export(t.tracked_products(spark, d), t.product_tags(spark, d), t.competitors(spark, d), _last(spark, d), url)


@query("""SELECT product_id, min(price) AS min_price, arg_min('Shop ' || seller_id, [price, seller_id]) AS cheapest_name, count(*) FILTER (price < own_price) AS cheaper_count,
    arg_min(price, [abs(price - own_price), price, seller_id]) FILTER (own_price > 0) AS nearest_price, arg_min('Shop ' || seller_id, [abs(price - own_price), price, seller_id]) FILTER (own_price > 0) AS nearest_name FROM a WHERE usable GROUP BY product_id""", "a")
def alert_context(spark, d):
    """ALR-07."""
    return alerts.context(_assessed(spark, d), F.concat(F.lit("Shop "), F.col("seller_id").cast("string")))


@query("SELECT grouping_id(marketplace, status, plan)::BIGINT AS level, marketplace, status, plan, count(*) AS products, count(current_price) AS priced, sum(current_price::DECIMAL(28, 9))::DOUBLE / nullif(count(current_price), 0) AS mean_price FROM p JOIN u USING (user_id) GROUP BY CUBE (marketplace, status, plan)", "pu")
def status_cube(spark, d):
    """AGG-08: one plan gives group rows and grand totals."""
    return reports.status_cube(t.tracked_products(spark, d).join(t.users(spark, d).select("user_id", "plan"), "user_id"))


@query()
def mover_sketches(spark, d):
    """AGG-09 for spans of 7 and 30 days, merged from sketches by day; held against exact counts and ranks."""
    return reports.sketch_spans(reports.daily_sketches(_moves(spark, d).where("price_change <> 0")))


_KEY = r"lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1), '^www\.', '') || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', ''))"


@query(f"SELECT page_id, {_KEY} AS match_key, lower(regexp_replace(url, '/$', '')) AS norm, substring(md5(url), 1, 12) AS short FROM pages")
def url_keys(spark, d):
    u = F.col("url")
    return t.read(spark, d, "pages").select("page_id", text.url_match_key(u).alias("match_key"), text.norm_url(u).alias("norm"), text.short_hash(u).alias("short"))


@query("SELECT lower(regexp_replace(url, '/$', '')) AS norm, min(page_id) AS page_id FROM pages GROUP BY 1")
def url_dedup(spark, d):
    return t.read(spark, d, "pages").groupBy(text.norm_url(F.col("url")).alias("norm")).agg(F.min("page_id").alias("page_id"))


@query("SELECT product_id, array_to_string(list_filter(regexp_split_to_array(lower(product_name), '[^a-z0-9]+'), lambda x: length(x) >= 3), ' ') AS tokens FROM p", "p")
def text_fold_tokens(spark, d):
    return t.tracked_products(spark, d).select("product_id", F.array_join(text.tokens(F.col("product_name")), " ").alias("tokens"))


_RULES = """r AS (SELECT c_custkey AS user_id, NULL::BIGINT AS product_id, unnest(['PRICE_DROP', 'PRICE_INCREASE', 'PRICE_THRESHOLD', 'PERCENTAGE_CHANGE', 'OUT_OF_STOCK', 'BACK_IN_STOCK', 'COMPETITOR_CHEAPER', 'COMPETITOR_PRICE_CHANGE', 'LOW_MARGIN']) AS rule_type, true AS is_active FROM customer WHERE c_custkey < 50
    UNION ALL SELECT p_partkey % 50, p_partkey, 'PRICE_DROP', p_partkey % 26 <> 0 FROM part WHERE p_partkey % 13 = 0),
    rr AS (SELECT p.product_id, rule_type, 'product' AS scope FROM r JOIN p ON p.product_id = r.product_id AND p.user_id = r.user_id WHERE is_active
    UNION ALL SELECT p.product_id, rule_type, 'account' FROM p JOIN r USING (user_id) WHERE r.product_id IS NULL AND NOT EXISTS (SELECT 1 FROM r x WHERE x.product_id = p.product_id AND x.rule_type = r.rule_type))"""


@query(", " + _RULES + " SELECT * FROM rr", "p")
def resolve_rules(spark, d):
    return alerts.resolve_rules(t.alert_rules(spark, d), t.tracked_products(spark, d)).drop("rule_id")


#: Thresholds of rules by type, the side of PRICE_THRESHOLD by product, and competitors' moves of the same product and second.
_EVALUATED = """ec AS (SELECT product_id, scraped_at, list({'previous': previous_price, 'current': price}) AS moves FROM (SELECT *, lag(price) OVER (PARTITION BY product_id, seller_id ORDER BY scraped_at, l_orderkey, l_linenumber) AS previous_price FROM h) WHERE previous_price IS NOT NULL GROUP BY ALL),
    e0 AS (SELECT m.*, p.user_id, p.cost, coalesce(moves, []) AS moves, (u.user_id % 11)::DOUBLE AS floor_pct, g.min_price FROM m JOIN p USING (product_id) LEFT JOIN u ON u.user_id = p.user_id LEFT JOIN g ON g.product_id = m.product_id LEFT JOIN ec ON ec.product_id = m.product_id AND ec.scraped_at = m.scraped_at),
    e1 AS (SELECT e0.*, rule_type, coalesce(CASE rule_type
    WHEN 'PRICE_DROP' THEN price_change < 0 AND abs(price_change_pct) >= coalesce(floor_pct, 0) WHEN 'PRICE_INCREASE' THEN price_change > 0 AND abs(price_change_pct) >= coalesce(floor_pct, 0)
    WHEN 'PERCENTAGE_CHANGE' THEN price_change <> 0 AND abs(price_change_pct) >= 10 AND abs(price_change_pct) >= coalesce(floor_pct, 0)
    WHEN 'PRICE_THRESHOLD' THEN price_change <> 0 AND CASE WHEN product_id % 2 = 0 THEN price <= 1500 ELSE price >= 1500 END WHEN 'OUT_OF_STOCK' THEN previous_stock AND NOT in_stock WHEN 'BACK_IN_STOCK' THEN NOT previous_stock AND in_stock
    WHEN 'COMPETITOR_CHEAPER' THEN min_price < price WHEN 'COMPETITOR_PRICE_CHANGE' THEN len(list_filter(moves, lambda x: x.previous > 0 AND x.current > 0 AND x.current <> x.previous AND abs((x.current - x.previous) / x.previous * 100) >= greatest(coalesce(floor_pct, 0), 10))) > 0
    WHEN 'LOW_MARGIN' THEN price_change <> 0 AND (price - cost) / price * 100 < 10 END, false) AS fired FROM e0 JOIN rr USING (product_id) WHERE price_change <> 0 OR previous_stock <> in_stock OR len(moves) > 0)"""


def _evaluated(spark, d, since=None):
    """Every event of a product with each of its rules: event_no, at, rule_no, fired and what the rules look at."""
    h = t.price_history(spark, d)
    pair = ["product_id", "seller_id"]
    rivals = (timeseries.moves(h, pair) if since is None else timeseries.recent_moves(t.dealt(h), pair, since)).where("previous_price IS NOT NULL")
    rivals = rivals.groupBy("product_id", "scraped_at").agg(F.collect_list(F.struct(F.col("previous_price").alias("previous"), F.col("price").alias("current"))).alias("moves"))
    m = _moves(spark, d, since)
    p, u = t.tracked_products(spark, d), t.users(spark, d)
    g = quality.pressure(_assessed(spark, d)).select("product_id", "min_price")
    none = F.array().cast(rivals.schema["moves"].dataType)
    e = m.join(p.select("product_id", "user_id", "cost"), "product_id").join(rivals, ["product_id", "scraped_at"], "left").withColumn("moves", F.coalesce("moves", none))
    e = e.withColumn("event_types", alerts.event_types()).where(F.size("event_types") > 0)
    j = e.join(alerts.resolve_rules(t.alert_rules(spark, d), p), "product_id").join(u.select("user_id", "alert_threshold_pct"), "user_id", "left").join(g, "product_id", "left")
    margin = prices.margin_pct(F.col("price"), F.col("cost"))
    limit = F.when(F.col("rule_type") == "PRICE_THRESHOLD", 1500.0).otherwise(10.0)
    side = F.when(F.col("product_id") % 2 == 0, "below").otherwise("above")
    return j.withColumn("fired", alerts.fires(F.col("rule_type"), limit, side, margin, F.col("min_price")))


@query(", " + _RULES + ", " + _EVALUATED + f" SELECT product_id, l_orderkey, l_linenumber, rule_type FROM e1 WHERE fired AND scraped_at >= {_DAY}", "mpgu")
def alert_candidates(spark, d):
    """ALR-01..05, ALR-07, ALR-08."""
    return _evaluated(spark, d, _day()).where("fired").select("product_id", "l_orderkey", "l_linenumber", "rule_type")


#: The fold of one product's events in order as a recursion: `st` holds for each rule, in the rules' order, whether it
#: was active, until when it cools down and when it was last looked at.
_FOLD = """, es AS (SELECT product_id, scraped_at, epoch(scraped_at) AS sec, l_orderkey, l_linenumber, rule_type, fired, CASE WHEN rr.scope = 'product' THEN 'p' || product_id ELSE 'u' || user_id END || ':' || rule_type AS rule_id,
      list_position(['PRICE_DROP', 'PRICE_INCREASE', 'PRICE_THRESHOLD', 'PERCENTAGE_CHANGE', 'OUT_OF_STOCK', 'BACK_IN_STOCK', 'COMPETITOR_CHEAPER', 'COMPETITOR_PRICE_CHANGE', 'LOW_MARGIN'], rule_type) + CASE WHEN rr.scope = 'product' THEN 0 ELSE 100 END AS rule_no
      FROM e1 JOIN rr USING (product_id, rule_type) WHERE scraped_at >= TIMESTAMP '2001-11-03'),
    eg AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY sec, l_orderkey, l_linenumber) AS n FROM (SELECT product_id, sec, l_orderkey, l_linenumber, list({'id': rule_id, 'kind': rule_type, 'fired': fired} ORDER BY rule_no) AS rules FROM es GROUP BY ALL)),
    f AS (SELECT product_id, 0::BIGINT AS n, 0::BIGINT AS l_orderkey, 0::BIGINT AS l_linenumber, list_transform(rules, lambda r: {'active': false, 'until': 0.0::DOUBLE, 'seen': 0.0::DOUBLE, 'sent': false, 'id': r.id, 'kind': r.kind}) AS st FROM eg WHERE n = 1
      UNION ALL SELECT g.product_id, g.n, g.l_orderkey, g.l_linenumber, list_transform(g.ok, lambda o, i: CASE
        WHEN o.kind IN ('PRICE_DROP', 'PRICE_INCREASE', 'PERCENTAGE_CHANGE') AND g.winner > 0 AND i <> g.winner THEN {'active': o.active, 'until': o.until, 'seen': o.seen, 'sent': false, 'id': o.id, 'kind': o.kind}
        ELSE {'active': CASE WHEN o.kind IN ('PRICE_THRESHOLD', 'COMPETITOR_CHEAPER', 'LOW_MARGIN') THEN o.fired ELSE o.active END,
          'until': CASE WHEN o.alert THEN g.sec + CASE WHEN o.kind = 'OUT_OF_STOCK' THEN 7200 ELSE 1800 END ELSE o.until END, 'seen': g.sec, 'sent': o.alert, 'id': o.id, 'kind': o.kind} END)
      FROM (SELECT *, coalesce(nullif(list_position(list_transform(ok, lambda o: o.free AND o.fired AND o.kind = 'PERCENTAGE_CHANGE'), true), 0), list_position(list_transform(ok, lambda o: o.free AND o.fired AND o.kind IN ('PRICE_DROP', 'PRICE_INCREASE')), true), 0) AS winner FROM
        (SELECT eg.*, list_transform(eg.rules, lambda r, i: {'id': r.id, 'kind': r.kind, 'fired': r.fired, 'active': f.st[i].active, 'until': f.st[i].until, 'seen': f.st[i].seen, 'free': eg.sec >= f.st[i].until,
          'alert': r.fired AND eg.sec >= f.st[i].until AND NOT (r.kind IN ('PRICE_THRESHOLD', 'COMPETITOR_CHEAPER', 'LOW_MARGIN') AND f.st[i].active AND eg.sec - f.st[i].seen < 1209600)}) AS ok FROM f JOIN eg ON eg.product_id = f.product_id AND eg.n = f.n + 1)) g)
    SELECT product_id, l_orderkey, l_linenumber, s.id AS rule_id, s.kind AS rule_type FROM (SELECT product_id, l_orderkey, l_linenumber, unnest(list_filter(st, lambda o: o.sent)) AS s FROM f WHERE n > 0)"""


@query(", " + _RULES + ", " + _EVALUATED + _FOLD, "mpgu")
def alerts_sent(spark, d):
    """ALR-06, STM-03, STM-04: the alerts of two days, folded by product."""
    e = _evaluated(spark, d, t.as_of() - F.make_dt_interval(hours=F.lit(48)))
    at = F.unix_seconds(F.col("scraped_at").cast("timestamp"))
    cooldown = F.when(F.col("rule_type") == "OUT_OF_STOCK", 120).otherwise(30)
    order = F.array_position(F.array(*[F.lit(r) for r in t.RULE_TYPES]), F.col("rule_type")) + F.when(F.col("scope") == "product", 0).otherwise(100)
    event = ["l_orderkey", "l_linenumber"]
    e = e.select("product_id", *event, at.alias("at"), order.alias("rule_no"), "rule_id", "rule_type", "fired", cooldown.alias("cooldown_minutes"))
    return alerts.alerts_sent(e, event, t.parts(t.price_history(spark, d)))


@query(f"SELECT product_id, count(*) AS events, count_if(price_change <> 0) AS price_events, count_if(previous_stock <> in_stock) AS stock_events FROM m WHERE price_change <> 0 OR previous_stock <> in_stock GROUP BY product_id", "m")
def alert_events(spark, d):
    """ALR-01 without competitors' moves."""
    e = _moves(spark, d).withColumn("moves", F.array()).withColumn("types", alerts.event_types()).where(F.size("types") > 0)
    return e.groupBy("product_id").agg(F.count("*").alias("events"), F.count_if(F.array_contains("types", "price-change")).alias("price_events"), F.count_if(F.array_contains("types", "stock-change")).alias("stock_events"))


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS nth FROM
    (SELECT *, count_if(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) WHERE event_type = 'error') WHERE nth = 5""")
def failure_runs(spark, d):
    return timeseries.failure_runs(t.read(spark, d, "events"), "user_id", F.col("event_type") == "error").select("event_id", "user_id")


@query("""SELECT event_id, count(*) OVER w - later AS hits, count(*) OVER w - later <= 2 AS admitted FROM (SELECT *, count(*) OVER (PARTITION BY user_id, s) - row_number() OVER (PARTITION BY user_id, s ORDER BY event_id) AS later FROM (SELECT *, CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS s FROM events)) WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)""")
def sliding_window_limiter(spark, d):
    """STM-07, times cut to ten minutes so that hits share a second."""
    ts = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600) * 600)
    return timeseries.sliding_limiter(t.read(spark, d, "events").withColumn("ts", ts), "user_id", 3600, 2).select("event_id", "hits", "admitted")


_LAST = "LEFT JOIN (SELECT product_id, max(scraped_at) AS last_scraped_at FROM h GROUP BY 1) l USING (product_id)"


def _last(spark, d):
    return t.price_history(spark, d).groupBy("product_id").agg(F.max("scraped_at").alias("last_scraped_at"))


@query(f"""SELECT product_id, last_scraped_at FROM p JOIN u USING (user_id) {_LAST} WHERE status IN ('ACTIVE', 'OUT_OF_STOCK', 'ERROR') AND (last_scraped_at IS NULL OR (last_scraped_at < TIMESTAMP '2001-11-05' - INTERVAL 5 MINUTE AND last_scraped_at + to_minutes(CASE WHEN status = 'ERROR' OR plan IN ('FREE', 'STARTER') THEN 1440 WHEN plan = 'PRO' THEN 720 ELSE 360 END) <= TIMESTAMP '2001-11-05'))
    AND (plan_expires_at IS NULL OR plan_expires_at + INTERVAL 3 DAY >= TIMESTAMP '2001-11-05')""", "hpu")
def due_for_scan(spark, d):
    return lifecycle.due_for_scan(t.tracked_products(spark, d), t.users(spark, d), _last(spark, d), t.as_of())


@query(f"""SELECT product_id, last_scraped_at FROM p JOIN u USING (user_id) {_LAST} WHERE status IN ('ACTIVE', 'OUT_OF_STOCK') AND (last_scraped_at IS NULL OR last_scraped_at + INTERVAL 6 HOUR < TIMESTAMP '2001-11-05')
    AND (plan_expires_at IS NULL OR plan_expires_at >= TIMESTAMP '2001-11-05') ORDER BY last_scraped_at NULLS FIRST, product_id LIMIT 10""", "hpu")
def due_for_discovery(spark, d):
    return lifecycle.due_for_discovery(t.tracked_products(spark, d), t.users(spark, d), _last(spark, d), t.as_of())


@query("""SELECT h.product_id, l_orderkey, l_linenumber, price FROM h JOIN p USING (product_id) JOIN u USING (user_id) WHERE plan = 'ENTERPRISE' OR scraped_at >= TIMESTAMP '2001-11-05' - to_days(CASE plan WHEN 'FREE' THEN 7 WHEN 'STARTER' THEN 30 ELSE 365 END)""", "hpu")
def retention_survivors(spark, d):
    return lifecycle.retained(t.price_history(spark, d), t.tracked_products(spark, d), t.users(spark, d), t.as_of()).select("product_id", "l_orderkey", "l_linenumber", "price")


@query("""SELECT user_id, CASE WHEN plan <> 'FREE' AND plan_status = 'ACTIVE' AND (plan_expires_at IS NULL OR plan_expires_at + INTERVAL 3 DAY >= TIMESTAMP '2001-11-05') THEN plan ELSE 'FREE' END AS effective_plan FROM u""", "u")
def effective_plan(spark, d):
    return t.users(spark, d).select("user_id", lifecycle.effective_plan(t.as_of()).alias("effective_plan"))


@query("SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY product_id) AS rn FROM p QUALIFY rn > 5", "p")
def capacity_pause(spark, d):
    return lifecycle.over_capacity(t.tracked_products(spark, d), 5)


@query("""SELECT user_id, sent, failed, skipped, CASE WHEN sent > 0 THEN 'SENT' WHEN failed > 0 THEN 'FAILED' ELSE 'SKIPPED' END AS status, coalesce(CASE WHEN sent = 0 AND failed = 0 THEN sr ELSE fr END, '') AS reasons FROM (SELECT o_custkey AS user_id, count_if(o_orderstatus = 'F') AS sent, count_if(o_orderstatus = 'O') AS failed, count_if(o_orderstatus NOT IN ('F', 'O')) AS skipped,
    string_agg(DISTINCT CASE WHEN o_orderkey % 4 <> 0 THEN 'no channel ' || o_orderkey % 3 END, ' · ' ORDER BY CASE WHEN o_orderkey % 4 <> 0 THEN 'no channel ' || o_orderkey % 3 END) FILTER (o_orderstatus = 'O') AS fr, string_agg(DISTINCT CASE WHEN o_orderkey % 4 <> 0 THEN 'no channel ' || o_orderkey % 3 END, ' · ' ORDER BY CASE WHEN o_orderkey % 4 <> 0 THEN 'no channel ' || o_orderkey % 3 END) FILTER (o_orderstatus NOT IN ('F', 'O')) AS sr FROM orders GROUP BY 1)""")
def delivery_summary(spark, d):
    return alerts.delivery_summary(t.notifications(spark, d), "user_id")


@query("""SELECT product_id, CASE WHEN l.last_scraped_at IS NULL THEN 'no-data' WHEN hours <= 24 THEN 'fresh' WHEN hours <= 72 THEN 'ageing' ELSE 'stale' END AS freshness FROM (SELECT product_id, last_scraped_at, date_diff('second', last_scraped_at, TIMESTAMP '2001-11-05') / 3600.0 AS hours FROM p LEFT JOIN (SELECT product_id, max(scraped_at) AS last_scraped_at FROM h GROUP BY 1) USING (product_id)) l""", "hp")
def freshness_labels(spark, d):
    j = t.tracked_products(spark, d).join(_last(spark, d), "product_id", "left")
    return j.select("product_id", text.freshness(text.hours_between(F.col("last_scraped_at"), t.as_of()), F.col("last_scraped_at").isNull()).alias("freshness"))


@query("""SELECT product_id, CASE WHEN product_id % 3 = 0 AND product_id % 2 = 0 THEN 1.0 WHEN product_id % 3 = 0 THEN current_price ELSE current_price END AS current_price, status FROM p
    UNION ALL SELECT -1, 5.0, 'ACTIVE'""", "p")
def product_upsert(spark, d):
    p = t.tracked_products(spark, d).select("product_id", "current_price", "status")
    k = F.col("product_id")
    changes = p.where(k % 3 == 0).select("product_id", F.when(k % 2 == 0, F.lit(1.0)).alias("current_price"), F.lit(None).cast("string").alias("status"))
    new = spark.createDataFrame([(-1, 5.0, "ACTIVE")], changes.schema)
    return lifecycle.upsert(p, changes.unionByName(new), ["product_id"])


@query("""SELECT product_id, seller_id, price, rn FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, seller_id) AS rn FROM c WHERE price > 0) WHERE rn <= 10""", "c")
def cheapest_ten_sellers(spark, d):
    """SRT-12."""
    c = t.competitors(spark, d).where("price > 0")
    rn = F.row_number().over(Window.partitionBy("product_id").orderBy("price", "seller_id"))
    return c.select("product_id", "seller_id", "price", rn.alias("rn")).where("rn <= 10")


@query("""SELECT product_id, seller_id, (price - own_price) / own_price * 100 AS diff_pct, price = min(price) OVER (PARTITION BY product_id) AS cheapest FROM a WHERE usable AND own_price > 0""", "a")
def competitor_diffs(spark, d):
    """WIN-11."""
    a = _assessed(spark, d).where("usable AND own_price > 0")
    low = F.min("price").over(Window.partitionBy("product_id"))
    return a.select("product_id", "seller_id", ((F.col("price") - F.col("own_price")) / F.col("own_price") * 100).alias("diff_pct"), (F.col("price") == low).alias("cheapest"))


@query("SELECT product_id, product_name FROM p WHERE product_id > 100 ORDER BY product_id LIMIT 500", "p")
def keyset_page(spark, d):
    """SRT-06: the page of 500 after a cursor."""
    return t.tracked_products(spark, d).where("product_id > 100").select("product_id", "product_name").orderBy("product_id").limit(500)


@query("""SELECT user_id, used, greatest(0, cap - used) AS remaining, pct AS used_pct, pct >= 80 AS near, pct >= 100 AS reached FROM (SELECT *, least(100, CAST(floor(100.0 * used / cap + 0.5) AS BIGINT)) AS pct FROM (SELECT user_id, count(*) AS used, any_value(CASE WHEN plan <> 'FREE' AND plan_status = 'ACTIVE' AND (plan_expires_at IS NULL OR plan_expires_at + INTERVAL 3 DAY >= TIMESTAMP '2001-11-05') THEN CASE plan WHEN 'STARTER' THEN 50 WHEN 'PRO' THEN 500 ELSE 99999 END ELSE 5 END) AS cap FROM p JOIN u USING (user_id) GROUP BY user_id))""", "pu")
def plan_usage(spark, d):
    """AGG-23, CSE-11, ENT-02: products against the limit of the effective plan."""
    g = t.tracked_products(spark, d).groupBy("user_id").agg(F.count("*").alias("used")).join(t.users(spark, d), "user_id")
    cap = lifecycle.limit_of(lifecycle.effective_plan(t.as_of()), "products")
    u = labels.usage(F.col("used"), cap)
    return g.select("user_id", "used", F.greatest(F.lit(0), cap - F.col("used")).alias("remaining"), u["percent"].alias("used_pct"), u["near"].alias("near"), u["reached"].alias("reached"))


@query("SELECT count(DISTINCT marketplace) AS marketplaces, max(scraped_at) AS newest FROM h JOIN p USING (product_id)", "hp")
def marketplaces_in_use(spark, d):
    """AGG-16, AGG-21: the history is reduced by product before the join."""
    last = t.price_history(spark, d).groupBy("product_id").agg(F.max("scraped_at").alias("ts"))
    return last.join(t.tracked_products(spark, d), "product_id").agg(F.countDistinct("marketplace").alias("marketplaces"), F.max("ts").alias("newest"))
