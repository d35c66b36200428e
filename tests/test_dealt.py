"""What is dealt by product: a task's rows don't grow with the table, and what follows moves nothing again."""

from __future__ import annotations

import re

import oracle
import pytest
from pyspark.sql import functions as F

from tarifa.operators import alerts, temporal, timeseries
from tarifa.plans import registry
from tarifa.sources import tables as t


def _exchanges(df) -> list[str]:
    """Shuffles of the plan, without those of the few rows that are sorted or broadcast last."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(.*?\), \w+", plan)


def test_parts_follow_the_rows(spark):
    h = spark.range(10_000).select((F.col("id") % 500).alias("product_id"))
    assert t.dealt(h).rdd.getNumPartitions() == 8 and t.dealt(h, 100).rdd.getNumPartitions() == 101


@pytest.mark.parametrize("name", ["pressure_top5", "catalog_gap_sort", "competitor_assessment", "sliding_prices", "tumbling_prices"])
def test_history_is_shuffled_once(spark, name):
    found = _exchanges(registry.QUERIES[name](spark, oracle.SMALL))
    assert len(found) == 1 and "REPARTITION_BY_NUM" in found[0]


@pytest.mark.parametrize("width,slide", [("1 day", "6 hours"), ("90 minutes", "30 minutes"), ("1 hour", "25 minutes"), ("1 hour", "1 hour")])
def test_sliding_windows_by_panes(spark, width, slide):
    """As by copying each row to its windows; null prices, times and products, equal times, times before 1970."""
    rows = [(p, s, None if n % 7 == 0 else float(n % 13), n) for n, (p, s) in enumerate([(p, s) for p in (1, 2, None) for s in (-5, 0, 0, 1799, 1800, 7200, 86_399, 86_400, None)])]
    d = spark.createDataFrame(rows, "product_id long, s long, price double, event_no long").withColumn("at", F.timestamp_seconds("s"))
    w = d.groupBy("product_id", F.window("at", width, slide)).agg(F.count("*"), F.min("price"), F.max("price"), F.max_by("price", F.struct("at", "event_no")))
    want = sorted(map(repr, w.select("product_id", "window.start", *w.columns[2:]).collect()))
    got = temporal.price_windows(d, width, slide).toDF("product_id", "start", *w.columns[2:])
    assert sorted(map(repr, got.collect())) == want and want


@pytest.mark.parametrize("keys", [["product_id"], ["product_id", "seller_id"]])
def test_recent_moves_stay_in_their_part(spark, keys):
    h = t.dealt(t.price_history(spark, oracle.SMALL))
    since = t.as_of() - F.make_dt_interval(hours=F.lit(48))
    found = timeseries.recent_moves(h, keys, since)
    assert len(_exchanges(found)) == 1 and "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    # a row without a time is no row before another
    unseen = h.withColumn("scraped_at", F.when(F.col("l_linenumber") != 1, F.col("scraped_at")))
    seen = timeseries.moves(unseen.where("scraped_at IS NOT NULL"), keys).where(F.col("scraped_at") >= since)
    assert timeseries.recent_moves(unseen, keys, since).exceptAll(seen).isEmpty() and not seen.isEmpty()


def test_alerts_in_so_many_parts(spark):
    columns = "product_id long, event_no long, at long, rule_no int, rule_id string, rule_type string, fired boolean, cooldown_minutes int"
    d = spark.createDataFrame([(p, 1, 60, 1, "x", "LOW_MARGIN", True, 30) for p in range(40)], columns)
    assert alerts.alerts_sent(d, parts=33).rdd.getNumPartitions() == 33 and alerts.alerts_sent(d, parts=33).count() == 40
