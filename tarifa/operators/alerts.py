"""Alert rules in batch (ALR-01..06, AGG-20)."""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping, Sequence
from itertools import chain, groupby
from operator import attrgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import positive


def resolve_rules(rules: DataFrame, products: DataFrame) -> DataFrame:
    """ALR-02, JON-10: a product's own active rules, and its owner's global rules of types without an own rule.

    Two equi-joins instead of one join on OR; an inactive own rule mutes the global one.
    """
    p = products.select("product_id", "user_id")
    own = rules.where("product_id IS NOT NULL")
    everyone = rules.where("product_id IS NULL AND is_active").select("user_id", "rule_type", "rule_id")
    globals_ = p.join(everyone, "user_id").select("product_id", "rule_type", "rule_id").join(own.select("product_id", "rule_type"), ["product_id", "rule_type"], "left_anti")
    mine = own.where("is_active").join(p, ["product_id", "user_id"], "left_semi").select("product_id", "rule_type", "rule_id")
    return mine.withColumn("scope", F.lit("product")).unionByName(globals_.withColumn("scope", F.lit("account")))


MOVEMENT = ("PRICE_DROP", "PRICE_INCREASE", "PERCENTAGE_CHANGE")
LEVEL = ("PRICE_THRESHOLD", "COMPETITOR_CHEAPER", "LOW_MARGIN")


def event_types() -> Column:
    """ALR-01: what an observation tells: price-change, stock-change, competitor-price-change; empty for no event."""
    changed = F.col("price_change").isNotNull() & (F.col("price_change") != 0)
    stock = F.col("previous_stock").isNotNull() & (F.col("previous_stock") != F.col("in_stock"))
    return F.array_compact(F.array(
        F.when(changed, F.lit("price-change")), F.when(stock, F.lit("stock-change")), F.when(F.size("moves") > 0, F.lit("competitor-price-change"))
    ))


def significant_moves(moves: Column, user_floor: Column, rule_floor: Column) -> Column:
    """ALR-05: of competitors' (previous, current) prices those that moved by the larger floor at least."""
    floor_ = F.greatest(F.coalesce(user_floor, F.lit(0.0)), F.coalesce(rule_floor, F.lit(0.0)))
    real = lambda x: ~F.isnan(x) & (x > 0) & (x < float("inf"))
    pct = lambda m: F.abs((m["current"] - m["previous"]) / m["previous"] * 100)
    return F.filter(moves, lambda m: real(m["previous"]) & real(m["current"]) & (m["current"] != m["previous"]) & (pct(m) >= floor_))


def fires(rule: Column, threshold: Column, direction: Column, margin: Column, cheapest: Column) -> Column:
    """ALR-03, ALR-04: the truth table for one observation (price, price_change, price_change_pct, in_stock, previous_stock, moves, alert_threshold_pct)."""
    change, pct, price = F.col("price_change"), F.col("price_change_pct"), F.col("price")
    moved = change.isNotNull() & (change != 0)
    loud = pct.isNull() | (F.abs(pct) >= F.coalesce(F.col("alert_threshold_pct"), F.lit(0.0)))
    was, now = F.col("previous_stock"), F.col("in_stock")
    reached = F.when(direction == "below", price <= threshold).otherwise(price >= threshold)
    return F.coalesce(
        F.when(rule == "PRICE_DROP", moved & (change < 0) & loud)
        .when(rule == "PRICE_INCREASE", moved & (change > 0) & loud)
        .when(rule == "PERCENTAGE_CHANGE", moved & (F.abs(pct) >= threshold) & loud)
        .when(rule == "PRICE_THRESHOLD", moved & reached)
        .when(rule == "OUT_OF_STOCK", was & ~now)
        .when(rule == "BACK_IN_STOCK", ~was & now)
        .when(rule == "COMPETITOR_CHEAPER", (cheapest < price) & (price > 0))
        .when(rule == "COMPETITOR_PRICE_CHANGE", F.size(significant_moves(F.col("moves"), F.col("alert_threshold_pct"), threshold)) > 0)
        .when(rule == "LOW_MARGIN", moved & (margin < threshold)),
        F.lit(False),
    )


def context(assessed: DataFrame, name: Column) -> DataFrame:
    """ALR-07: what an alert tells of usable competitors, by product: the cheapest and its name, how many are cheaper than the own price, the nearest and its name.

    Of equal prices the least seller counts; without an own price nobody is cheaper or near. From the competitors of
    quality.assess with their own_price.
    """
    own = positive(F.col("own_price"))
    cheapest = F.min(F.struct("price", "seller_id", name.alias("name"))).alias("c")
    nearest = F.min(F.when(own.isNotNull(), F.struct(F.abs(F.col("price") - own).alias("d"), F.col("price"), F.col("seller_id"), name.alias("name")))).alias("n")
    cheaper = F.count_if(F.coalesce(F.col("price") < F.col("own_price"), F.lit(False))).alias("cheaper_count")
    g = assessed.where("usable").groupBy("product_id").agg(cheapest, nearest, cheaper)
    return g.select("product_id", F.col("c.price").alias("min_price"), F.col("c.name").alias("cheapest_name"), "cheaper_count", F.col("n.price").alias("nearest_price"), F.col("n.name").alias("nearest_name"))


#: Seconds after which a level rule's state is forgotten.
STATE_TTL = 14 * 86400


def send(rules: list, state: MutableMapping[str, tuple[bool, float, float]]) -> list:
    """ALR-06, STM-03, STM-04 for one event: those of its rules (in order) whose alerts go out.

    `state` holds for each rule id whether its condition held (level rules), until when its cooldown lasts and when it
    was last looked at; it is updated. Of the movement rules that fire and may be sent one wins: PERCENTAGE_CHANGE, or
    else the first. A level rule is sent when its condition becomes true; that moves the state before the cooldown is
    asked, so an edge within the cooldown is swallowed until the condition has been false once. A state that is
    STATE_TTL old counts as inactive.
    """
    now, sent = float(rules[0].at), []
    held = {r.rule_id: state.get(r.rule_id, (False, 0.0, 0.0)) for r in rules}
    movement = [r for r in rules if r.rule_type in MOVEMENT and r.fired and now >= held[r.rule_id][1]]
    winner = next((r for r in movement if r.rule_type == "PERCENTAGE_CHANGE"), movement[0] if movement else None)
    for r in rules:
        if r.rule_type in MOVEMENT and winner is not None and r.rule_id != winner.rule_id:
            continue
        active, until, seen = held[r.rule_id]
        alert = bool(r.fired) and now >= until
        if r.rule_type in LEVEL:
            alert, active = alert and not (active and now - seen < STATE_TTL), bool(r.fired)
        if alert:
            until = now + max(60, int(r.cooldown_minutes * 60))
            sent.append(r)
        state[r.rule_id] = (active, until, now)
    return sent


def sent_schema(event: Sequence[str]) -> str:
    return ", ".join(["product_id long", *(f"{c} long" for c in event), "rule_id string", "rule_type string"])


def sent_frame(sent: list, event: Sequence[str]) -> pd.DataFrame:
    """Typed columns, also when nothing is sent."""
    longs = {c: pd.Series([getattr(r, c) for r in sent], dtype="int64") for c in ("product_id", *event)}
    return pd.DataFrame(longs | {c: pd.Series([getattr(r, c) for r in sent], dtype="object") for c in ("rule_id", "rule_type")})


def alerts_sent(evaluated: DataFrame, event: Sequence[str] = ("event_no",), parts: int | None = None) -> DataFrame:
    """The alerts of every product, from (product_id, *event, at seconds, rule_no, rule_id, rule_type, fired, cooldown_minutes).

    `event` names the columns that tell apart and order the events of one second. Products are sorted by Spark and run
    through batch by batch, with the state of one product at a time, so no product is held whole. `parts` is the number of
    tasks they are dealt to, the session's number of shuffle partitions without it.
    """
    keys = ["product_id", "at", *event]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = chain.from_iterable(b.itertuples(index=False) for b in batches)
        product, state, sent = None, {}, []
        for key, group in groupby(rows, key=attrgetter(*keys)):
            if key[0] != product:
                product, state = key[0], {}
            sent += send(list(group), state)
            if len(sent) >= 10_000:
                yield sent_frame(sent, event)
                sent = []
        yield sent_frame(sent, event)

    by_product = evaluated.repartition(parts, "product_id") if parts else evaluated.repartition("product_id")
    ordered = by_product.sortWithinPartitions(*keys, "rule_no", "rule_id")
    return ordered.mapInPandas(run, sent_schema(event))


def delivery_summary(deliveries: DataFrame, key: str) -> DataFrame:
    """AGG-20: SENT if any was sent (with why others failed), else FAILED if any failed, else SKIPPED (with why); with the numbers."""
    s = F.col("status")
    why = lambda k: F.array_join(F.array_sort(F.collect_set(F.when(s == k, F.col("error")))), " · ")
    g = deliveries.groupBy(key).agg(F.count_if(s == "SENT").alias("sent"), F.count_if(s == "FAILED").alias("failed"), F.count_if(s == "SKIPPED").alias("skipped"), why("FAILED").alias("_failed"), why("SKIPPED").alias("_skipped"))
    status = F.when(F.col("sent") > 0, "SENT").when(F.col("failed") > 0, "FAILED").otherwise("SKIPPED")
    return g.select(key, "sent", "failed", "skipped", status.alias("status"), F.when(status == "SKIPPED", F.col("_skipped")).otherwise(F.col("_failed")).alias("reasons"))
