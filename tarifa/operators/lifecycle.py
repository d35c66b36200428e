"""Plans, scheduling, retention, upserts (ENT-*, DUE-*, RET-*, WIN-10, SNK-05, SNK-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP_DAYS = {"FREE": 7, "STARTER": 30, "PRO": 365}  # fixed values; ENTERPRISE keeps everything
GRACE_DAYS = 3
#: Limits and features of the plans, from the least one up.
PLANS = {
    "FREE": {"products": 5, "rules": 3, "tags": 0, "interval": 1440, "marketplaces": 1, "history_days": 7, "channels": ["EMAIL"], "features": []},
    "STARTER": {"products": 50, "rules": 20, "tags": 10, "interval": 1440, "marketplaces": 2, "history_days": 30, "channels": ["EMAIL", "TELEGRAM"], "features": ["bulk", "tags"]},
    "PRO": {"products": 500, "rules": 100, "tags": 20, "interval": 720, "marketplaces": 99, "history_days": 365, "channels": ["EMAIL", "TELEGRAM", "WEBHOOK"], "features": ["bulk", "tags", "analytics", "auto_rules"]},
    "ENTERPRISE": {"products": 99999, "rules": 99999, "tags": 99999, "interval": 360, "marketplaces": 99, "history_days": 99999, "channels": ["EMAIL", "TELEGRAM", "WEBHOOK"], "features": ["bulk", "tags", "analytics", "auto_rules", "api"]},
}


def limit_of(plan: Column, name: str) -> Column:
    """ENT-02: a limit of a plan; an unknown plan counts as FREE."""
    out = F.lit(PLANS["FREE"][name])
    for p in ("STARTER", "PRO", "ENTERPRISE"):
        out = F.when(plan == p, F.lit(PLANS[p][name])).otherwise(out)
    return out


def least_plan(feature: Column) -> Column:
    """ENT-02: the least plan that has a feature."""
    out = F.lit("ENTERPRISE")
    for name in reversed(PLANS):
        out = F.when(feature.isin(PLANS[name]["features"] or [""]), name).otherwise(out)
    return out


def effective_plan(now: Column) -> Column:
    """ENT-01: the paid plan while active and at most three days past its expiry, else FREE."""
    live = F.col("plan_expires_at").isNull() | (F.col("plan_expires_at") + F.make_dt_interval(days=F.lit(GRACE_DAYS)) >= now)
    return F.when((F.col("plan") != "FREE") & (F.col("plan_status") == "ACTIVE") & live, F.col("plan")).otherwise("FREE")


def due_for_scan(products: DataFrame, users: DataFrame, last: DataFrame, now: Column) -> DataFrame:
    """DUE-01: products to scan by the interval of their owner's plan. `last` has product_id and last_scraped_at.

    The order (never scanned first) is the caller's to ask for: a global sort of all due rows serves no one.
    """
    j = products.where(F.col("status").isin("ACTIVE", "OUT_OF_STOCK", "ERROR")).join(users, "user_id").join(last, "product_id", "left")
    interval = limit_of(F.col("plan"), "interval")
    wait = F.make_dt_interval(mins=F.when(F.col("status") == "ERROR", F.greatest(interval, F.lit(1440))).otherwise(interval))
    seen = F.col("last_scraped_at")
    due = seen.isNull() | ((seen < now - F.make_dt_interval(mins=F.lit(5))) & (seen + wait <= now))
    paid = F.col("plan_expires_at").isNull() | (F.col("plan_expires_at") + F.make_dt_interval(days=F.lit(GRACE_DAYS)) >= now)
    return j.where(due & paid).select("product_id", "last_scraped_at")


def due_for_discovery(products: DataFrame, users: DataFrame, last: DataFrame, now: Column, batch: int = 10) -> DataFrame:
    """DUE-02: the batch refreshed longest ago, over six hours; expired plans have no grace."""
    j = products.where(F.col("status").isin("ACTIVE", "OUT_OF_STOCK")).join(users, "user_id").join(last, "product_id", "left")
    old = F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") + F.make_dt_interval(hours=F.lit(6)) < now)
    j = j.where(old & (F.col("plan_expires_at").isNull() | (F.col("plan_expires_at") >= now)))
    return j.select("product_id", "last_scraped_at").orderBy(F.asc_nulls_first("last_scraped_at"), "product_id").limit(batch)


def retained(history: DataFrame, products: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """RET-01: history rows that the raw plan of their owner keeps."""
    days = F.coalesce(*[F.when(F.col("plan") == p, F.lit(d)) for p, d in KEEP_DAYS.items()])
    owner = products.select("product_id", "user_id").join(users.select("user_id", days.alias("days")), "user_id").select("product_id", "days")
    j = history.join(owner, "product_id")
    return j.where(F.col("days").isNull() | (F.col("scraped_at") >= now - F.make_dt_interval(days=F.col("days")))).drop("days")


def over_capacity(products: DataFrame, cap: int) -> DataFrame:
    """WIN-10: all but the `cap` oldest products of each user."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("product_id"))
    return products.withColumn("rn", rn).where(F.col("rn") > cap).select("user_id", "product_id", "rn")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-05: changed rows replace by key; a null in a change keeps the old value; new keys are added."""
    rest = [c for c in current.columns if c not in keys]
    n = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest])
    return current.join(n, keys, "full").select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in rest])


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-07: delete by key."""
    return rows.join(gone, keys, "left_anti")
