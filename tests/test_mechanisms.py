"""Sketches within their bounds, sinks that a repeated batch leaves alone, JSON bodies, exact rounding, alert context, shops' stores."""

from __future__ import annotations

import csv
from collections import defaultdict
from datetime import timedelta

import oracle
import pytest
from pyspark.sql import functions as F

from tarifa.functions import extract, labels, prices
from tarifa.operators import alerts, reports
from tarifa.plans import queries as q
from tarifa.plans import registry
from tarifa.sinks import batches
from tarifa.sources import bodies


def test_sketches_within_their_bounds(spark):
    """Movers within 5 % (three standard errors) and quartiles within 2 % of rank of the exact answers, for every day and span."""
    got = registry.QUERIES["mover_sketches"](spark, oracle.MEDIUM).collect()
    moved = defaultdict(list)
    for r in q._moves(spark, oracle.MEDIUM).where("price_change <> 0").select("product_id", "price", F.to_date("scraped_at").alias("day")).collect():
        moved[r["day"]].append((r["product_id"], r["price"]))
    assert len(got) > 20
    for r in got:
        own = [x for k in range(r["span"]) for x in moved.get(r["until"] - timedelta(days=k), [])]
        exact = len({p for p, _ in own})
        assert r["moves"] == len(own) and abs(r["movers"] - exact) <= max(1, 0.05 * exact)
        values = sorted(v for _, v in own)
        for share, value in zip((0.25, 0.5, 0.75), r["quartiles"]):
            below, upto = sum(v < value for v in values), sum(v <= value for v in values)
            assert below - 0.02 * len(values) <= share * len(values) <= upto + 0.02 * len(values)


def test_sketches_merge_as_the_whole(spark):
    """Sketches of days merge to all days' answer within the bound, also with days without rows between."""
    d = spark.sql("SELECT id % 700 AS product_id, CAST(id AS DOUBLE) AS price, TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(CAST(id % 5 * 2 AS INT)) AS scraped_at FROM range(5000)")
    spans = {(r["span"], str(r["until"])): r for r in reports.sketch_spans(reports.daily_sketches(d)).collect()}
    assert abs(spans[30, "2024-01-20"]["movers"] - 700) <= 35 and spans[30, "2024-01-20"]["moves"] == 5000
    assert spans[7, "2024-01-07"]["moves"] == 4000 and (7, "2024-01-16") not in spans
    assert reports.sketch_spans(reports.daily_sketches(d.where("false"))).collect() == []


def test_a_batch_delivered_twice_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "out")
    write = batches.batch_files(path)
    one, two = [spark.createDataFrame(r, "k long, v string, gone boolean") for r in ([(1, "a", False), (2, "b", False), (None, "n", False)], [(2, "c", False), (1, None, True), (3, "d", None)])]
    write(one, 0)
    write(one.union(two), 1)  # a try that ended early, with other rows
    write(two, 1)
    rows = batches.read_batches(spark, path, one.schema)
    assert sorted(((r["k"], r["v"], r["batch"]) for r in rows.collect()), key=repr) == sorted([(1, "a", 0), (2, "b", 0), (None, "n", 0), (2, "c", 1), (1, None, 1), (3, "d", 1)], key=repr)
    assert sorted(((r["k"], r["v"]) for r in batches.current(rows, ["k"], "gone").collect()), key=repr) == sorted([(2, "c"), (None, "n"), (3, "d")], key=repr)


def test_stream_into_csv_batches(spark, tmp_path):
    """A stream whose notes of the last batch are lost delivers it again."""
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate([[("x,y", 1)], [('say "hi"\nthere', 2), (None, 3)]]):
        spark.createDataFrame(rows, "name string, n int").coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema("name string, n int").option("maxFilesPerTrigger", 1).parquet(str(source))
        write = batches.csv_files(str(tmp_path / "csv"), [F.col("name"), F.col("n")], ["product", "number"])
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)

    def lines():
        files = sorted((tmp_path / "csv").glob("batch=*/part-*.csv"))
        return sorted(tuple(r) for f in files for r in list(csv.reader(f.open(newline="")))[1:])

    run()
    want = lines()
    assert want == sorted([("x,y", "1"), ('say "hi"\nthere', "2"), ("", "3")])
    commits = sorted((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    run()
    assert lines() == want


@pytest.mark.parametrize(("kind", "body", "problems"), [
    ("add", '{"productUrl": "https://a.b/c"}', []), ("add", '{"productUrl": "https://"}', ["productUrl: url"]), ("add", '{"productUrl": 5}', ["productUrl: type"]), ("add", None, ["not an object"]), ("add", "[1]", ["not an object"]),
    ("compare", '{"productId": "123e4567-e89b-12d3-a456-426614174000"}', []), ("compare", '{"productId": "123"}', ["productId: uuid"]), ("update", '{"cost": null}', []), ("update", '{"cost": 99999999.5}', ["cost: range"]),
    ("update", '{"ownPrice": 1e-9, "cost": 0}', []), ("update", '{"cost": false, "ownPrice": -1}', ["cost: type", "ownPrice: range"]), ("update", "{}", ["nothing to update"]), ("checkout", '{"planId": "PRO", "billing": ""}', ["billing: billing"]),
    ("settings", '{"emailNotifications": null}', ["emailNotifications: type"]), ("settings", "{}", []),
])
def test_bodies(spark, kind, body, problems):
    r = bodies.read(spark.createDataFrame([(1, body)], "key long, body string"), kind).first()
    assert list(r["problems"]) == problems and r["ok"] == (not problems) and (r["corrupt"] is not None) == (problems == ["not an object"] and body is not None)
    if kind == "checkout":
        assert r["planId"] == "PRO" and r["billing"] is None


def test_numbers_with_fixed_digits(spark):
    cases = [(692.025, 2, "692.02"), (48.125, 2, "48.13"), (-48.125, 2, "-48.13"), (0.995, 2, "0.99"), (1.005, 2, "1.00"), (9.995, 2, "9.99"), (99.999, 2, "100.00"), (0.25, 1, "0.3"), (2.5, 0, "3"), (0.0, 2, "0.00"), (-0.001, 2, "-0.00"), (None, 2, None), (123456789.12, 2, "123456789.12")]
    for x, digits, want in cases:
        assert spark.createDataFrame([(x,)], "x double").select(prices.to_fixed(F.col("x"), digits)).first()[0] == want


def test_alert_context(spark):
    rows = [(1, 9, 5.0, True, 10.0), (1, 3, 5.0, True, 10.0), (1, 4, 11.0, True, 10.0), (1, 5, 9.0, True, 10.0), (1, 6, 10.0, False, 10.0), (2, 1, 3.0, True, None), (3, 1, 3.0, False, 1.0), (4, 1, 3.0, True, 0.0), (4, 2, 2.0, True, 0.0)]
    d = spark.createDataFrame(rows, "product_id long, seller_id long, price double, usable boolean, own_price double")
    got = {tuple(r) for r in alerts.context(d, F.concat(F.lit("s"), F.col("seller_id").cast("string"))).collect()}
    assert got == {(1, 5.0, "s3", 3, 9.0, "s5"), (2, 3.0, "s1", 0, None, None), (4, 2.0, "s2", 0, None, None)}


def test_stores_and_challenges(spark):
    store = lambda u, t: tuple(spark.createDataFrame([(u, t)], "u string, t string").select(labels.store_of(F.col("u"), F.col("t")).alias("s")).first()["s"])
    assert store("https://x.com/", "N11.COM Ürün") == ("N11", "N11") and store("https://www.foo.co/a", "b") == ("CUSTOM", "Foo") and store("no url", None) == ("CUSTOM", "Diğer")
    marker = lambda h: spark.createDataFrame([(h,)], "h string").select(extract.challenge_marker(F.col("h"))).first()[0]
    long = "x" * 50_000
    assert marker("a ROBOT CHECK") == "robot check" and marker(long + "captcha") is None and marker(long + "PX-Captcha") == "px-captcha" and marker("robot") is None and marker(None) is None
    assert marker("x" * (50_000 - 8) + "captcha") == "captcha" and marker("x" * (50_000 - 7) + "captcha") is None


def test_facts_of_titles_stand_once_in_the_plan(spark):
    """Every search of a title is bound once, not repeated for each comparison that needs it."""
    from tarifa.operators import linkage as pairs

    d = spark.createDataFrame([("Acme ZX000002TRK 16GB 3 parçalı", "Acme ZX000002TRK 015 0,5 TB 3 parçalı kılıfı", 10.0, 11.0)], "title string, listing string, own_price double, listing_price double")
    made = pairs.decisions(pairs.compare(d))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 10, plan.count("regexp_extract_all(")
    r = made.first()
    assert (r["relation"], r["strong"], r["specs"], r["accessory"], r["reason"]) == ("config-variant", True, True, True, "config-variant")


def test_challenge_in_long_pages(spark, tmp_path):
    """The recovery's check has no bound on a page's length; the general one has."""
    from tarifa.plans import registry

    html = "<p>" + "x" * 60_000 + "</p>"
    spark.createDataFrame([(6, "https://a.b/6", html), (7, "https://a.b/7", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r["page_id"]: r["challenge"] for r in registry.QUERIES["recovered_prices"](spark, str(tmp_path)).collect()} == {6: True, 7: False}
