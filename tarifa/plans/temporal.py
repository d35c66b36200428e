"""Queries of joins and windows over time, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal
from ..sources import tables as t
from ..streaming import state
from .queries import query


def _history(spark, d):
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return t.price_history(spark, d).select("product_id", "seller_id", "price", F.col("scraped_at").alias("at"), number.alias("event_no"), t.is_own().alias("own"))


@query("""SELECT r.product_id, r.l_orderkey * 10 + r.l_linenumber AS event_no, r.price, o.price AS own_price, o.scraped_at AS own_at FROM (SELECT * FROM h WHERE (product_id + seller_id) % 4 <> 0) r
    ASOF LEFT JOIN (SELECT * FROM h WHERE (product_id + seller_id) % 4 = 0 QUALIFY row_number() OVER (PARTITION BY product_id, scraped_at ORDER BY l_orderkey DESC, l_linenumber DESC) = 1) o ON r.product_id = o.product_id AND r.scraped_at >= o.scraped_at""", "h")
def rival_prices_asof(spark, d):
    """JON-11, JON-15: every competitor's price with the own price of that time."""
    h = _history(spark, d)
    own = h.where("own").select("product_id", "at", "event_no", F.col("price").alias("own_price"), F.col("at").alias("own_at"))
    found = temporal.asof(h.where("NOT own").select("product_id", "at", "event_no", "price"), own, ["product_id"], "at", ["event_no"], ["own_price", "own_at"])
    return found.drop("at")


@query("""SELECT o.product_id, o.l_orderkey * 10 + o.l_linenumber AS event_no, r.l_orderkey * 10 + r.l_linenumber AS rival_no, r.seller_id AS rival, o.price, r.price AS rival_price FROM h o JOIN h r ON o.product_id = r.product_id
    AND r.scraped_at <= o.scraped_at AND r.scraped_at >= o.scraped_at - INTERVAL 2 HOUR WHERE (o.product_id + o.seller_id) % 4 = 0 AND (r.product_id + r.seller_id) % 4 <> 0""", "h")
def moves_before_own(spark, d):
    """ALR-01, ALR-05: own observations with competitors' of the same product in the two hours before."""
    h = _history(spark, d)
    rivals = h.where("NOT own").select("product_id", "at", F.col("event_no").alias("rival_no"), F.col("seller_id").alias("rival"), F.col("price").alias("rival_price"))
    own = h.where("own").select("product_id", "at", "event_no", "price")
    return temporal.interval_join(own, rivals, ["product_id"], 7200).drop("at", "other_at")


_WINDOW = "count(*) AS rows, min(price) AS least, max(price) AS greatest, arg_max(price, [epoch(scraped_at), l_orderkey * 10 + l_linenumber]) AS last"


@query(f"SELECT product_id, time_bucket(INTERVAL 1 DAY, scraped_at) AS start, {_WINDOW} FROM h GROUP BY ALL", "h")
def tumbling_prices(spark, d):
    """Windows of a day over price observations."""
    return temporal.price_windows(t.dealt(_history(spark, d)), "1 day")


@query(f"SELECT product_id, start, {_WINDOW} FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, scraped_at) - to_hours(6 * k) FOR k IN range(4)]) AS start FROM h) GROUP BY ALL", "h")
def sliding_prices(spark, d):
    """Windows of a day that start every six hours."""
    return temporal.price_windows(t.dealt(_history(spark, d)), "1 day", "6 hours")


def _attempts(spark, d):
    return t.read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "error").alias("failed"))


@query("""SELECT key, start, stop, failures FROM (SELECT user_id AS key, min(ts) AS start, max(ts) + INTERVAL 2 DAY AS stop, count(*) AS failures FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM
    (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 DAY THEN 0 ELSE 1 END AS new FROM events WHERE event_type = 'error')) GROUP BY user_id, run) WHERE failures >= 3""")
def failure_sessions(spark, d):
    """Failures of one key that follow one another within two days, three at least."""
    found = temporal.failure_sessions(_attempts(spark, d), "2 days", 3)
    return found.select("key", F.col("start").cast("timestamp_ntz"), F.col("stop").cast("timestamp_ntz"), "failures")


@query("SELECT event_id, user_id, event_type, ts FROM events")
def once_delivered(spark, d):
    """STM-08: events of which every third is delivered twice, each once."""
    e = t.read(spark, d, "events").select("event_id", "user_id", "event_type", "ts", F.lit(1).alias("delivery"))
    return state.once(e.unionByName(e.where("event_id % 3 = 0").withColumn("delivery", F.lit(2))), ["delivery"]).drop("delivery")
