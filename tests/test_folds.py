"""Operators without SQL, against plain versions; streams against their batch forms; writers; edge cases of the price side."""

from __future__ import annotations

import json
import random
import re
from collections import defaultdict

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from tarifa.functions import extract, labels, linkage, prices, search
from tarifa.operators import alerts, catalog, quality
from tarifa.plans import queries as q
from tarifa.plans import registry
from tarifa.sources import tables as t
from tarifa.streaming import state

LEVEL = {"PRICE_THRESHOLD", "COMPETITOR_CHEAPER", "LOW_MARGIN"}
MOVES = {"PRICE_DROP", "PRICE_INCREASE", "PERCENTAGE_CHANGE"}


def plain_alerts(rows):
    """The processing order of one product's events, with a dictionary for each kind of state."""
    active, until, out = {}, {}, []
    events = defaultdict(list)
    for r in rows:
        events[r["event_no"]].append(r)
    for no in sorted(events):
        rules = sorted(events[no], key=lambda r: r["rule_no"])
        now = rules[0]["at"]
        free = {r["rule_type"] for r in rules if until.get(r["rule_type"], now) <= now}
        able = [r["rule_type"] for r in rules if r["rule_type"] in MOVES and r["fired"] and r["rule_type"] in free]
        best = "PERCENTAGE_CHANGE" if "PERCENTAGE_CHANGE" in able else (able + [None])[0]
        for r in rules:
            kind = r["rule_type"]
            if kind in MOVES and best and kind != best:
                continue
            was = active.get(kind, False)
            if kind in LEVEL:
                active[kind] = r["fired"]
            if r["fired"] and not (kind in LEVEL and was) and kind in free:
                out.append((no, kind))
                until[kind] = now + max(60, r["cooldown_minutes"] * 60)
    return out


def random_events(n, seed):
    r = random.Random(seed)
    kinds = sorted(LEVEL | MOVES | {"OUT_OF_STOCK"})
    return [
        {"product_id": p, "event_no": e, "at": e * 400, "rule_no": i, "rule_id": k, "rule_type": k, "fired": r.random() < 0.4, "cooldown_minutes": r.choice([0, 10, 30])}
        for p in range(4) for e in range(n) for i, k in enumerate(kinds)
    ]


EVENTS = "product_id long, event_no long, at long, rule_no int, rule_id string, rule_type string, fired boolean, cooldown_minutes int"


def test_alerts(spark):
    rows = random_events(40, 1)
    d = spark.createDataFrame(rows, EVENTS)
    want = {(p, e, k, k) for p in range(4) for e, k in plain_alerts([r for r in rows if r["product_id"] == p])}
    assert {tuple(r) for r in alerts.alerts_sent(d).collect()} == want


def test_alerts_of_groups_that_send_nothing(spark):
    """A group without alerts, and two rules of one type, each with its own cooldown and edge."""
    row = lambda e, at, no, rule, fired: (7, e, at, no, rule, "LOW_MARGIN", fired, 30)
    quiet = spark.createDataFrame([(1, 1, 0, 1, "a", "PRICE_DROP", False, 0)], EVENTS)
    assert alerts.alerts_sent(quiet).collect() == [] and alerts.alerts_sent(quiet.where("false")).collect() == []
    both = spark.createDataFrame([row(1, 0, 1, "x", True), row(1, 0, 2, "y", False), row(2, 10, 1, "x", True), row(2, 10, 2, "y", True)], EVENTS)
    assert [tuple(r) for r in alerts.alerts_sent(both.unionByName(quiet)).collect()] == [(7, 1, "x", "LOW_MARGIN"), (7, 2, "y", "LOW_MARGIN")]


def test_failures_expire(spark):
    import pandas as pd

    rows = pd.DataFrame({"event_id": range(7), "at": [0, 1, 2, 3, 3 + 8 * 86400, 4 + 8 * 86400, 5 + 8 * 86400], "failed": [True] * 7})
    assert state.fold_failures(rows, 0, float("-inf"), 5)[0] == []
    assert [e for e, _ in state.fold_failures(rows, 0, float("-inf"), 3)[0]] == [2, 6]


def test_admissions(spark):
    rows = [r.asDict() for r in registry.QUERIES["admissions"](spark, oracle.SMALL).collect()]
    kinds = defaultdict(int)
    for r in rows:
        kinds[r["status"]] += 1
    assert {"added", "skipped", "duplicate", "unsupported", "marketplace-limit"} <= set(kinds)
    for u in {r["user_id"] for r in rows}:
        mine = sorted((r for r in rows if r["user_id"] == u), key=lambda r: r["n"])
        assert [r["n"] for r in mine] == list(range(1, len(mine) + 1))
        states = [r["status"] for r in mine]
        if "skipped" in states:
            first = states.index("skipped")
            assert set(states[first:]) == {"skipped"} and first in (4, 49, 499, 99998)


FOLD = str.maketrans("İIışŞçÇğĞüÜöÖ", "iiissccgguuoo")


def plain_queries(name, fallback, metadata):
    fold = lambda s: s.translate(FOLD).lower()
    words = lambda s: [w for w in re.split(r"[\W_]+", s) if w]
    generic = lambda s: len(s.strip()) < 3 or all(fold(w) in search.MARKETPLACE_WORDS + search.FILLER_WORDS for w in words(s))
    live = (name or fallback).strip()
    kept = " ".join(w for w in live.split() if fold("".join(words(w))) not in search.NOISE)
    clean = kept if len(kept) >= 3 else live
    asked = [clean]
    found = [c for c in re.findall(r"\b\d{8,14}\b", live, re.A)]
    for c in re.findall(r"\b[A-Za-z0-9][A-Za-z0-9-]{3,}[A-Za-z0-9]\b", live, re.A):
        n = c.replace("-", "").upper()
        if len(n) >= 5 and re.search("[A-Z]", n) and re.search(r"\d", n) and not any(re.search(p, n) for p in linkage.SHARED_HARDWARE):
            found.append(c)
    if found:
        best = max(found, key=lambda c: len(c.replace("-", "")))
        brand = [w for w in clean.split() if len(w) >= 2 and w.lower() not in {c.lower() for c in found}][:2]
        asked.append(" ".join([*brand, best]))
    tokens = set() if generic(live) else {w for w in words(fold(live)) if len(w) >= 3}
    try:
        meta = json.loads(metadata)
        keys = meta.get("searchKeywords") if isinstance(meta.get("searchKeywords"), list) else meta.get("analysis", {}).get("searchKeywords", [])
    except (ValueError, AttributeError):
        keys = []
    asked += [k for k in keys if isinstance(k, str) and k.strip() and (not tokens or tokens & {w for w in words(fold(k)) if len(w) >= 3})]
    out = []
    for a in asked:
        w = a.split()
        a = " ".join(w[:6]) if len(w) > 7 else a.strip()
        if a and not generic(a) and a.lower() not in [o.lower() for o in out]:
            out.append(a)
    return out[:3]


def test_search_queries(spark):
    rows = registry.QUERIES["search_queries"](spark, oracle.SMALL).collect()
    assert all(r["queries"] == plain_queries("" if r["product_id"] % 9 == 0 else r["title"], "Trendyol ürün", r["metadata"]) for r in rows)
    assert {len(r["queries"]) for r in rows} >= {0, 1, 2}


def test_documents_leave_empty_blocks_out(spark):
    rows = registry.QUERIES["alert_documents"](spark, oracle.SMALL).collect()
    bodies = [json.loads(r["body"]) for r in rows]
    assert bodies and all(b["price"]["current"] > 0 and "name" in b["product"] for b in bodies)
    assert any("margin" not in b for b in bodies) and all(r["title"] and r["message"] for r in rows)


def test_csv_writer_and_append(spark, tmp_path):
    rows = [("a,b", 'say "hi"', None), ("plain", "two\nlines", 3)]
    d = spark.createDataFrame(rows, "x string, y string, z int")
    assert [r[0] for r in catalog.csv_lines(d).collect()] == ['"a,b","say ""hi""",', 'plain,"two\nlines",3']
    catalog.write_csv(d.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text == 'x,y,z\n"a,b","say ""hi""",\nplain,"two\nlines",3\n'
    for _ in range(2):
        catalog.append(d, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 4


CASES = [
    ("1,299", 1.299, 1299.0), ("5 TL", 5.0, None), ("99 TL - TL 150", 99150.0, 99.0), ("", 0.0, None), (None, 0.0, None), (".", 0.0, None), ("1.2.3", 123.0, 23.0), ("₺1.299,90", 1299.9, 1299.9),
]


def test_price_labels(spark):
    d = spark.createDataFrame([(c[0],) for c in CASES], "x string")
    rows = d.select("x", prices.parse_price_page(F.col("x")).alias("p"), prices.parse_price_search(F.col("x")).alias("s"), prices.parse_price_web(F.col("x")).alias("w")).collect()
    for r, (label, page, _) in zip(rows, CASES):
        assert r["p"] == page and r["w"] == (page or None), label
    assert [r["s"] for r in rows][:3] == [1299.0, None, 99.0]


TITLES = [
    (None, None, False), ("", "", False), ("Koli", "Koli", False), ("Telefon", "Telefon için kılıf", False), ("Brokoli tohumu", "Brokoli", False), ("Çay makinesi", "20x15x10 kutu", True), ("Ütü", "KARGO POŞETİ", True),
]


def test_titles_at_the_edges(spark):
    d = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(TITLES)], "i int, a string, b string")
    rows = d.select("i", linkage.is_packaging(F.col("b"), F.col("a")).alias("p"), linkage.is_accessory(F.col("b"), F.col("a")).alias("c"), linkage.codes(F.col("a")).alias("codes")).orderBy("i").collect()
    assert [bool(r["p"]) for r in rows] == [x[2] for x in TITLES]
    assert [bool(r["c"]) for r in rows] == [False, False, False, True, False, False, False]
    assert rows[0]["codes"] is None and rows[1]["codes"] == []


def test_zero_reasons(spark):
    d = spark.createDataFrame([(0, 0, 0, 0, 0), (2, 2, 2, 2, 0), (3, 1, 0, 0, 0), (0, 0, 1, 2, 0), (5, 0, 1, 0, 1), (5, 0, 3, 0, 1)], "k int, p int, r int, u int, a int")
    got = [r[0] for r in d.select(labels.zero_reason(*[F.col(c) for c in "kprua"])).collect()]
    assert got == ["no-exact-match", "rejected", "packaging", "no-price", "classifier-unavailable", "packaging"]


def test_walk_takes_the_latest_object_first():
    text = '{"a": {"x": {"priceText": "1.299,90 TL"}}, "b": [{"amount": 7}], "name": 3}'
    assert extract.walk_price(text, extract.plain_price) == 7.0
    assert extract.walk_price('{"price": true, "b": {"price": "abc"}, "c": "x"}', extract.plain_price) is None
    assert extract.walk_price("no json", extract.plain_price) is None and extract.walk_price(None, extract.plain_price) is None


@pytest.mark.parametrize("name", ["pressure_top5", "alert_candidates", "match_decisions", "html_products", "catalog_filtered", "price_moves", "merged_hits"])
def test_empty_tables(spark, tmp_path, name):
    """Empty tables give empty results of the same columns."""
    con = duckdb.connect()
    for table in oracle.TABLES:
        con.execute(f"COPY (SELECT * FROM '{oracle.SMALL}/{table}.parquet' WHERE false) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    empty = registry.QUERIES[name](spark, str(tmp_path))
    assert empty.collect() == [] and empty.columns == registry.QUERIES[name](spark, oracle.SMALL).columns


def test_nulls_and_ties_in_quality(spark):
    """Null prices, scores and times, equal prices and repeated rows."""
    rows = [(1, s, p, m, a) for s, (p, m, a) in enumerate([(100.0, 90, True), (100.0, 90, True), (100.0, None, True), (None, 90, True), (100.0, 90, False), (float("nan"), 90, True), (5.0, 90, True)])]
    d = spark.createDataFrame(rows + rows[:1], "product_id long, seller_id int, price double, match_score int, seen boolean")
    d = d.withColumn("last_scraped_at", F.when(F.col("seen"), t.as_of()))
    own = spark.createDataFrame([(1, None)], "product_id long, current_price double")
    got = sorted((r["seller_id"], ",".join(r["issues"])) for r in quality.assess(d, own, t.as_of()).collect())
    assert got == [(0, ""), (0, ""), (1, ""), (2, ""), (3, "no-price"), (4, "stale"), (5, "no-price"), (6, "peer-outlier")]
    assert q.QUERIES
