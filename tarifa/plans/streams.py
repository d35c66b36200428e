"""Queries of the stateful operators in batch form, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as t
from ..streaming import state
from .queries import query


def _hits(spark, d):
    return t.read(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, floor(epoch(ts)) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
    w AS (SELECT key, event_id, n, sec AS start, 1 AS hits FROM e WHERE n = 1 UNION ALL SELECT e.key, e.event_id, e.n, CASE WHEN e.sec >= start + 86400 THEN e.sec ELSE start END, CASE WHEN e.sec >= start + 86400 THEN 1 ELSE hits + 1 END FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
    SELECT event_id, hits <= 2 AS admitted, greatest(0, 2 - hits)::BIGINT AS remaining FROM w""")
def fixed_window_limiter(spark, d):
    """STM-06: two hits a day."""
    return state.fixed_window(_hits(spark, d), 2, 86400)


@query("""WITH e AS (SELECT o_custkey AS user_id, o_orderkey AS event_id, o_orderkey % 3 AS membership, CASE WHEN o_orderstatus = 'F' THEN 'end' ELSE 'renew' END AS kind, o_orderdate AS expires FROM orders), n AS (SELECT user_id, arg_max(membership, event_id) AS membership FROM e WHERE kind <> 'end' GROUP BY 1)
    SELECT user_id, membership, max(expires) AS expires, arg_max(kind, event_id) <> 'end' AS held FROM e JOIN n USING (user_id, membership) GROUP BY ALL""")
def membership_state(spark, d):
    """STM-09."""
    o = t.read(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "end").otherwise("renew")
    return state.memberships(o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("event_id"), (F.col("o_orderkey") % 3).alias("membership"), kind.alias("kind"), F.col("o_orderdate").alias("expires")))
