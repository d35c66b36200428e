"""Price series: changes, transitions, runs, daily buckets, limits by window (WIN-*, AGG-14, STM-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prices import is_plausible_change, pct_change

ORDER = ["scraped_at", "l_orderkey", "l_linenumber"]


def moves(history: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-02, WIN-03: previous price and stock, change and percent of every observation."""
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    h = history.withColumn("previous_price", F.lag("price").over(w)).withColumn("previous_stock", F.lag("in_stock").over(w))
    h = h.withColumn("price_change", F.when(F.col("previous_price") > 0, F.col("price") - F.col("previous_price")))
    return h.withColumn("price_change_pct", pct_change(F.col("previous_price"), F.col("price")))


def recent_moves(history: DataFrame, keys: list[str], since: Column) -> DataFrame:
    """`moves` of the observations from `since` on.

    A history dealt by one of the keys is sorted where it lies. (The newest row before `since` of each series would do
    besides them, but to find it by a maximum each task sorts its whole share of the file first.)
    """
    at = F.col("scraped_at")
    return moves(history.where(at.isNotNull()), keys).where(at >= since)


def implausible(history: DataFrame, keys: list[str]) -> DataFrame:
    """NUM-02 over a series."""
    return moves(history, keys).where(~is_plausible_change(F.col("previous_price"), F.col("price")))


def movers(changes: DataFrame, k: int = 5, prelimit: int | None = None) -> DataFrame:
    """WIN-04, SRT-04: each product's newest change, the k largest. `prelimit` looks at that many newest rows only."""
    newest = [F.desc("scraped_at"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("product_id")]
    if prelimit:
        changes = changes.orderBy(*newest).limit(prelimit)
    rn = F.row_number().over(Window.partitionBy("product_id").orderBy(*newest[:3]))
    last = changes.withColumn("rn", rn).where("rn = 1").drop("rn")
    return last.orderBy(F.abs(F.col("price_change_pct")).desc(), "product_id").limit(k)


def daily(history: DataFrame, own: Column) -> DataFrame:
    """AGG-14: last price of the day of each seller, then least and mean over competitors and the own one, by day.

    Of several own sellers the one that was seen first the latest counts. The mean is of an exact sum, so the order of
    rows doesn't matter.
    """
    order = F.struct(*ORDER)
    last = history.groupBy("product_id", F.to_date("scraped_at").alias("day"), "seller_id", own.alias("own")).agg(F.max_by("price", order).alias("price"), F.min(order).alias("first"))
    rival = F.when(~F.col("own"), F.col("price"))
    mean = F.sum(rival.cast("decimal(28,9)")).cast("double") / F.nullif(F.count(rival), F.lit(0))
    return last.groupBy("product_id", "day").agg(F.count(rival).alias("sellers"), F.min(rival).alias("min_price"), mean.alias("avg_price"), F.max_by("price", F.when(F.col("own"), F.col("first"))).alias("own_price"))


def failure_runs(attempts: DataFrame, key: str, failed, length: int = 5) -> DataFrame:
    """WIN-09: the attempt at which a run of failures reaches `length` (runs end at a success)."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    a = attempts.withColumn("failed", failed).withColumn("run", F.sum((~F.col("failed")).cast("int")).over(w))
    nth = F.row_number().over(Window.partitionBy(key, "run").orderBy("ts", "event_id"))
    return a.where("failed").withColumn("nth", nth).where(F.col("nth") == length).drop("failed", "run", "nth")


def sliding_limiter(hits: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """STM-07: hits in (t - window, t] by whole seconds, rejected ones included; of one second those that came before. Admitted while at most `limit`."""
    w = Window.partitionBy(key).orderBy("second").rangeBetween(-(seconds - 1), 0)
    peers = Window.partitionBy(key, "second")
    h = hits.withColumn("second", F.unix_seconds(F.col("ts").cast("timestamp")))
    later = F.count("*").over(peers) - F.row_number().over(peers.orderBy("event_id"))
    h = h.withColumn("hits", F.count("*").over(w) - later)
    return h.withColumn("admitted", F.col("hits") <= limit)
