"""Joins and windows over time: backward as-of join, interval join, event-time windows (JON-11, JON-15, ALR-05; windows of a stream in batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _seconds(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp")) / 1e6


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, order: list[str], values: list[str], slice_seconds: int = 86_400) -> DataFrame:
    """Every row of `left` with `values` of the newest row of `right` of its keys at or before its time (null without one).

    `order` names columns of `right` that break ties of time. Both sides are cut into slices of time: a window runs over
    one slice of one key, so a hot key is spread over its slices; what a slice starts with comes from the slices before,
    one row each. Rows of `left` with a null key or time find nothing and stay.
    """
    part = F.floor(_seconds(F.col(at)) / slice_seconds).alias("_slice")
    names = [f"_k{i}" for i in range(len(keys))]
    key = [F.col(k).alias(n) for k, n in zip(keys, names)]
    found = F.struct(*[F.col(c) for c in values])
    there = right.select(*key, part, F.col(at).alias("_at"), F.struct(*order).alias("_order"), found.alias("_found")).where(" AND ".join(f"{c} IS NOT NULL" for c in ["_at", *names]))
    last = there.groupBy(*names, "_slice").agg(F.max_by("_found", F.struct("_at", "_order")).alias("_last"))
    here = left.select(*key, part, F.col(at).alias("_at"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    # a slice's first value: the last of the slices before it
    starts = last.select(*names, "_slice", "_last").unionByName(here.select(*names, "_slice").distinct().withColumn("_last", F.lit(None)))
    starts = starts.groupBy(*names, "_slice").agg(F.any_value("_last", True).alias("_last"))
    before = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*names, "_slice", F.last("_last", True).over(before).alias("_start"))
    both = there.withColumn("_row", F.lit(None).cast(here.schema["_row"].dataType)).unionByName(here.withColumns({"_order": F.lit(None).cast(there.schema["_order"].dataType), "_found": F.lit(None).cast(there.schema["_found"].dataType)}))
    within = Window.partitionBy(*names, "_slice").orderBy("_at", F.col("_row").isNotNull(), "_order").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_near", F.last("_found", True).over(within)).where("_row IS NOT NULL")
    placed = placed.join(starts.where("_start IS NOT NULL"), [*names, "_slice"], "left")
    value = F.coalesce("_near", "_start")
    return placed.select("_row.*", *[value[c].alias(c) for c in values])


def interval_join(events: DataFrame, others: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Pairs of a row of `events` and one of `others` with equal keys that came up to `seconds` before it, both ends included.

    Both have `at`; the times are `at` and `other_at` and the other columns of `others` must have names of their own.
    Besides the keys the join is on bins of time: a row of `events` looks into its own bin and the one before, so a key is
    dealt out by time. On streams with watermarks the state ends where no pair can come any more.
    """
    bin_ = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / seconds)
    a = events.withColumn("_bin", F.explode(F.array(bin_(F.col("at")), bin_(F.col("at")) - 1)))
    b = others.withColumnRenamed("at", "other_at").withColumn("_bin", bin_(F.col("other_at")))
    b = b.select(*[F.col(k).alias(f"_o_{k}") for k in [*keys, "_bin"]], *[c for c in b.columns if c not in (*keys, "_bin")])
    near = (F.col("other_at") <= F.col("at")) & (F.col("other_at") >= F.col("at") - F.make_dt_interval(secs=F.lit(seconds)))
    same = [F.col(k) == F.col(f"_o_{k}") for k in [*keys, "_bin"]]
    on = near
    for s in same:
        on = s & on
    return a.join(b, on).drop("_bin", *[f"_o_{k}" for k in [*keys, "_bin"]])


_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}


def _panes(width: str, slide: str) -> list[int]:
    """How many seconds before a pane of `slide` the windows start that hold it; empty where panes don't fill them, or where the lengths are no number and unit."""
    try:
        w, s = (int(n) * _SECONDS[unit.lower().rstrip("s")] for n, unit in (x.split() for x in (width, slide)))
    except (KeyError, ValueError):
        return []
    return list(range(0, w, s)) if 0 < s <= w and w % s == 0 else []


def price_windows(history: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """(product_id, start, rows, least, greatest, last) of tumbling or sliding windows of `at`; on a stream with a watermark late rows are dropped.

    A table's rows are folded to panes of `slide` first where they fill windows, so panes and not rows are copied to the
    windows that hold them. A history dealt by product is moved no more.
    """
    newest = F.struct("at", "event_no", "price")
    ends = [F.min("price").alias("least"), F.max("price").alias("greatest")]
    back = _panes(width, slide) if slide and not history.isStreaming else []
    if back:
        panes = history.groupBy("product_id", F.window("at", slide)).agg(F.count("*").alias("rows"), *ends, F.max(newest).alias("newest"))
        start = F.explode(F.array(*[F.col("window.start") - F.make_dt_interval(secs=F.lit(x)) for x in back]))
        g = panes.withColumn("start", start).groupBy("product_id", "start").agg(
            F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.max("newest")["price"].alias("last")
        )
        return g.select("product_id", "start", "rows", "least", "greatest", "last")
    w = F.window("at", width, slide) if slide else F.window("at", width)
    g = history.groupBy("product_id", w).agg(F.count("*").alias("rows"), *ends, F.max(newest)["price"].alias("last"))
    return g.select("product_id", F.col("window.start").alias("start"), "rows", "least", "greatest", "last")


def failure_sessions(attempts: DataFrame, gap: str, least: int) -> DataFrame:
    """(key, start, stop, failures) of failures that follow one another within `gap`, of `least` at least."""
    g = attempts.where("failed").groupBy("key", F.session_window("at", gap)).agg(F.count("*").alias("failures"))
    return g.where(F.col("failures") >= least).select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "failures")
