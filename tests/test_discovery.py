"""Discovery's last steps on small cases, with nulls, ties and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarifa.operators import discovery, reports


@pytest.mark.parametrize(("url", "ld", "meta", "want"), [
    ("https://www.trendyol.com/a", 5.0, 6.0, (9.0, "search")), ("https://shop.example.com/a", 5.0, 6.0, (9.0, "search")), ("https://www.n11.com/a", 5.0, 6.0, (5.0, "json-ld")),
    ("https://m.n11.com/a", 0.0, 6.0, (6.0, "meta-tag")), ("https://cimri.com/a", None, None, (9.0, "page-failed")), ("https://cimri.com/a", -1.0, float("nan"), (9.0, "page-failed")),
])
def test_verified_price(spark, url, ld, meta, want):
    d = spark.createDataFrame([(url, 9.0, ld, meta)], "url string, price double, ld double, meta double")
    assert tuple(d.select(discovery.verified_price(*[F.col(c) for c in d.columns]).alias("v")).first()["v"]) == want


def test_same_listing(spark):
    sellers = [(1, "https://x/y?z#q", m, None if m == 3 else f"S{m}", p) for m, p in ((1, 5.0), (2, 5.0), (3, 1.0), (4, None), *((k, 10.0 + k) for k in range(5, 16)))]
    d = spark.createDataFrame(sellers, "product_id long, product_url string, merchant_id long, seller_name string, price double")
    stored = spark.createDataFrame([(1, "https://x/y?merchantId=1", 5.0), (1, "https://x/y?merchantId=2", 4.0), (1, "https://x/y?merchantId=3", None), (2, "https://x/y?merchantId=5", 1.0)], "product_id long, url string, price double")
    got = {r["rank"]: r for r in discovery.same_listing(d, stored).collect()}
    assert len(got) == 10 and [got[k]["url"][-1] for k in (1, 2, 3)] == ["3", "1", "2"]
    assert [got[k]["is_new"] for k in range(1, 5)] == [False, False, False, True] and [k for k in got if got[k]["moved"]] == [3]
    assert (got[1]["name"], got[1]["chart_name"]) == ("Trendyol satıcısı", "Satıcı 3") and sorted(k for k in got if got[k]["charted"]) == [1, 2, 3, 4, 5]
    assert discovery.same_listing(d.where("false"), stored).collect() == []


def test_direct_scrapes(spark):
    rows = [(1, "a", 5.0, None, None, 6.0, "P"), (1, "b", 5.0, 69, "Manuel rakip", 6.0, None), (1, "c", 5.0, 70, "N", 5.0, "P"), (1, "d", None, 70, "", 6.0, "x" * 300), (1, "e", 5.0, 70, "N", 0.0, "P"), (1, "f", 5.0, 70, "N", 7.0, "P")]
    d = spark.createDataFrame(rows, "product_id long, url string, previous_price double, match_score int, competitor_name string, page_price double, page_name string")
    got = {r["url"]: tuple(r)[2:] for r in discovery.direct_scrapes(d).collect()}
    assert got == {
        "a": (True, 6.0, "P", 2, True), "b": (True, 6.0, "Manuel rakip", 2, False), "c": (True, 5.0, "N", 2, False), "d": (True, 6.0, "x" * 200, 2, False), "e": (False, 5.0, "N", 0, False), "f": (True, 7.0, "N", 2, True),
    }


def test_refresh(spark):
    hits = [(1, 1, 1, "https://a.com/1", 110.0, None, None), (1, 1, 2, "https://A.com/1/", 999.0, None, None), (1, 1, 3, "https://n11.com/2", 100.0, 90.0, None), (1, 1, 4, "https://b.com/3", 999.0, None, None), (1, 2, 1, "https://b.com/4", 100.0, None, None), (1, 1, 5, "https://b.com/5", None, None, None)]
    h = spark.createDataFrame(hits, "product_id long, query_no int, position int, url string, price double, ld_price double, meta_price double")
    listings = [(1, "https://a.com/1", 100.0, 80, None, 50.0), *((1, f"https://old.com/{k}", 10.0, None, f"2024-01-{k + 1:02d} 00:00:00", 11.0 if k % 2 else None) for k in range(12))]
    v = spark.createDataFrame(listings, "product_id long, url string, price double, match_score int, last_scraped_at string, page_price double")
    p = spark.createDataFrame([(1, 100.0)], "product_id long, current_price double")
    rows = discovery.refresh(h, v, p)
    got = {r["url"]: (r["action"], r["price"], r["moved"]) for r in rows.collect() if "old" not in r["url"]}
    assert got == {"https://a.com/1": ("update", 110.0, True), "https://n11.com/2": ("create", 90.0, False), "https://b.com/3": ("price-filtered", 999.0, False), "https://b.com/5": ("no-price", None, False)}
    c = discovery.refresh_counters(rows).first().asDict()
    assert c == {"product_id": 1, "updated": 1, "created": 1, "price_filtered": 1, "without_price": 1, "recovered": 5, "lost": 5, "moves": 6, "competitor_rows": 7, "history_rows": 7, "verified": 1}
    assert discovery.refresh(h.where("false"), v.where("false"), p).collect() == []


def test_rule_list(spark):
    rows = [(1, None, "PRICE_DROP", "a", True, None), (1, 5, "PRICE_DROP", "b", True, "2024-01-02"), (1, 6, "LOW_MARGIN", "c", False, "2024-01-03"), (1, 7, "PRICE_DROP", "d", False, "2024-01-03"), (1, None, "PRICE_INCREASE", "e", True, "2023-01-01")]
    d = spark.createDataFrame(rows, "user_id long, product_id long, rule_type string, rule_id string, is_active boolean, last_triggered string")
    ids = lambda shown, asked: [r["rule_id"] for r in reports.rule_list(d, shown, asked).orderBy("place").collect()]
    assert ids("all", "PRICE") == ["e", "a", "d", "b"] and ids("active", "PRICE") == ["e", "a", "b"] and ids("inactive", "") == ["c", "d"] and ids("recent", "drop 7") == ["d"]


def test_missing_listings_of_one_url_and_time(spark):
    """Which of equal URLs and times is kept doesn't depend on the order of the rows."""
    from tarifa.operators.catalog import missing_listings

    rows = [(1, "https://a.b/c", float(i), 40 + i, "2001-01-01") for i in range(6)]
    none = spark.createDataFrame([], "product_id long, url string")
    kept = []
    for given in (rows, rows[::-1]):
        d = spark.createDataFrame(given, "product_id long, url string, price double, match_score int, last_scraped_at string").coalesce(1)
        kept.append([r["price"] for r in missing_listings(d, none, 2).orderBy("rn").collect()])
    assert kept == [[0.0, 1.0], [0.0, 1.0]]
