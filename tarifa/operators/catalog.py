"""Search hits, catalogue views, set-based writes and admissions (JON-07..17, DSC-*, SET-02, SNK-03..13, ENT-03, ALR-09..12, SRC-02/03/09)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.search import not_allowed
from ..functions.text import csv_escape, norm_url, url_match_key


def merged_hits(hits: DataFrame) -> DataFrame:
    """SET-02: of hits with one normalised URL for a product the first by query and position stays (one aggregate, no sort)."""
    rest = F.struct("query_no", "position", *[c for c in hits.columns if c not in ("product_id", "query_no", "position")])
    g = hits.groupBy("product_id", norm_url(F.col("url")).alias("_key")).agg(F.min_by(rest, F.struct("query_no", "position")).alias("h"))
    return g.select("product_id", "h.*")


def split_own(hits: DataFrame, own: DataFrame) -> DataFrame:
    """JON-08: marks the hits that are the own listing by URL key; `own` has product_id and own_url."""
    keys = own.select("product_id", url_match_key(F.col("own_url")).alias("_own"))
    return hits.join(keys, "product_id", "left").withColumn("is_own", F.coalesce(url_match_key(F.col("url")) == F.col("_own"), F.lit(False))).drop("_own")


def recovered_own_price(split: DataFrame) -> DataFrame:
    """DSC-07: the own price from the first own hit; URLs of one merchant don't tell it."""
    own = split.where("is_own AND price > 0").where(~F.col("url").rlike("merchantId="))
    return own.groupBy("product_id").agg(F.min_by("price", F.struct("query_no", "position", "url")).alias("own_price"))


def known_hits(hits: DataFrame, listings: DataFrame) -> DataFrame:
    """JON-07, JON-11: hits with the stored price and score of a listing of the same URL (null: new), and the move of known ones."""
    known = listings.select("product_id", "url", F.col("price").alias("stored_price"), "match_score")
    j = hits.join(known, ["product_id", "url"], "left")
    moved = F.col("stored_price").isNotNull() & (F.col("stored_price") != F.col("price"))
    return j.withColumn("is_new", F.col("stored_price").isNull()).withColumn("moved", moved)


def staged(accepted: DataFrame, enough: int = 3) -> DataFrame:
    """DSC-02: hits of the queries up to the first at which `enough` are accepted; `accepted` has product_id, query_no, accepted.

    Counts by query come first, so the running sum sees a row for each product and query.
    """
    n = accepted.groupBy("product_id", "query_no").agg(F.count_if("accepted").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("product_id").orderBy("query_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = n.withColumn("before", before).where(F.col("before") < enough).select("product_id", "query_no")
    return accepted.join(run, ["product_id", "query_no"], "left_semi")


def fan_out(observations: DataFrame, targets: DataFrame) -> DataFrame:
    """JON-09, AGG-06: the newest observation of each URL key for every row that shares it; `targets` has key columns and url."""
    seen = observations.groupBy(url_match_key(F.col("url")).alias("_key")).agg(F.max_by("price", F.struct("last_scraped_at", "price")).alias("new_price"), F.max("last_scraped_at").alias("seen_at"))
    return targets.withColumn("_key", url_match_key(F.col("url"))).join(seen, "_key").drop("_key")


def missing_listings(listings: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """JON-14: stored listings that no hit names, the k longest unseen of each product; listings of one URL and time go by their other columns, so reruns agree."""
    order = ("last_scraped_at", "url")
    gone = listings.join(hits.select("product_id", "url"), ["product_id", "url"], "left_anti")
    rn = F.row_number().over(Window.partitionBy("product_id").orderBy(F.asc_nulls_first("last_scraped_at"), "url", *[c for c in listings.columns if c not in ("product_id", *order)]))
    return gone.withColumn("rn", rn).where(F.col("rn") <= k)


def action_groups(rows: DataFrame, groups: dict[str, Column], order: list, k: int = 4) -> DataFrame:
    """SRT-13: the first k rows of each group of conditions, in one pass: a row is exploded to the groups it is in."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]))
    rn = F.row_number().over(Window.partitionBy("action").orderBy(*order))
    return rows.withColumn("action", F.explode(named)).withColumn("rn", rn).where(F.col("rn") <= k)


def nested(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """SRC-03, JON-01, JON-06: parents with an array of structs of each kind of child (empty where there are none)."""
    for name, rows in children.items():
        one = rows.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != key]))).alias(name))
        parents = parents.join(one, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce(name, F.array().cast(one.schema[name].dataType))).drop("_k")
    return parents


def pasted_urls(rows: DataFrame, key: str, text: str) -> DataFrame:
    """SRC-09: (key, n, url) of the lines that start with http, trimmed."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x))
    return rows.select(key, F.posexplode(F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit("http")))).alias("n", "url"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """SNK-01: one quoted line a row, under `line`."""
    return rows.select(F.concat_ws(",", *[csv_escape(F.col(c)) for c in rows.columns]).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    """SNK-01: CSV files of the same quoting, each with the header."""
    plain = {"header": True, "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**plain).csv(path)


def append(rows: DataFrame, path: str) -> None:
    """SNK-04."""
    rows.write.mode("append").parquet(path)


def updated(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """SNK-06, SNK-12, SNK-13: new values where a condition is true (null counts as false)."""
    return rows.select(*[F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def replaced_set(rows: DataFrame, wanted: DataFrame, parent: str, member: str, allowed: DataFrame) -> DataFrame:
    """SNK-08: members of the parents in `wanted` are replaced; a parent that asks for a member that isn't allowed keeps its own."""
    bad = wanted.join(allowed, member, "left_anti").select(parent).distinct()
    good = wanted.join(bad, parent, "left_anti").select(parent, member).distinct()
    return rows.join(good.select(parent).distinct(), parent, "left_anti").select(parent, member).unionByName(good)


def admissions(wanted: DataFrame, limits: DataFrame) -> DataFrame:
    """ENT-03: what becomes of each new URL of a user, in order; a group is one user's request.

    `wanted` has user_id, n, url, marketplace, tracked (the user has it), supported; `limits` has user_id, remaining, marketplace_limit,
    used (array of marketplaces). Rows beyond the remaining slots are skipped whatever they are; then duplicates, unsupported
    marketplaces and new marketplaces beyond the limit are refused.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        used, seen, out = set(pdf["used"].iloc[0]), set(), []
        cap, limit = int(pdf["remaining"].iloc[0]), int(pdf["marketplace_limit"].iloc[0])
        for i, r in enumerate(pdf.itertuples()):
            if i >= cap:
                out.append("skipped")
            elif r.tracked or r.url in seen:
                out.append("duplicate")
            elif not r.supported:
                out.append("unsupported")
            elif limit < 99 and r.marketplace not in used and len(used) >= limit:
                out.append("marketplace-limit")
            else:
                seen.add(r.url)
                used.add(r.marketplace)
                out.append("added")
        return pd.DataFrame({"user_id": pdf["user_id"], "n": pdf["n"], "url": pdf["url"], "status": out})

    return wanted.join(limits, "user_id").groupBy("user_id").applyInPandas(run, "user_id long, n int, url string, status string")


def deliveries(alerts: DataFrame) -> DataFrame:
    """ALR-09: one row a wanted channel: allowed ones are to be sent, the others skipped; (alert_id, wanted, allowed)."""
    blocked = not_allowed(F.col("wanted"), F.col("allowed"))
    one = F.transform(F.array_distinct("wanted"), lambda c: F.struct(c.alias("channel"), F.when(F.array_contains(blocked, c), "SKIPPED").otherwise("SEND").alias("status")))
    return alerts.select("alert_id", F.inline(one))


def default_rules(users: DataFrame, rules: DataFrame, defaults: list[tuple[str, int]]) -> DataFrame:
    """ALR-11: the first default rules that fit a user's slots, for users without any rule; `users` has user_id and slots."""
    none = users.join(rules.select("user_id").distinct(), "user_id", "left_anti")
    every = F.array(*[F.struct(F.lit(n).alias("rule_type"), F.lit(c).alias("cooldown_minutes")) for n, c in defaults])
    return none.select("user_id", F.inline(F.slice(every, F.lit(1), F.greatest(F.col("slots"), F.lit(0)))))


def rule_problems(new: DataFrame, rules: DataFrame, limits: DataFrame) -> DataFrame:
    """ALR-12: why a new rule is refused (null: it is not): a second global one of a type, a channel not allowed, no slot left.

    `new` has id, user_id, product_id, rule_type, channels; `limits` has user_id, allowed, slots.
    """
    taken = rules.where("product_id IS NULL").select("user_id", "rule_type").distinct().withColumn("_taken", F.lit(True))
    held = rules.groupBy("user_id").agg(F.count("*").alias("_held"))
    j = new.join(taken, ["user_id", "rule_type"], "left").join(held, "user_id", "left").join(limits, "user_id")
    why = F.when(F.col("product_id").isNull() & F.col("_taken"), "duplicate").when(F.size(F.array_except("channels", "allowed")) > 0, "channel").when(F.coalesce("_held", F.lit(0)) >= F.col("slots"), "limit")
    return j.select("id", "user_id", "rule_type", why.alias("problem"))
