"""What is costly to find stands once in a plan: a lambda or a chain of cases that names it from outside would find it again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarifa.functions import labels, search, text


def url():
    return F.concat(F.lit("https://www."), F.col("host"), F.lit("/a-p-"), F.col("id").cast("string"))


CASES = {
    "marketplace": (lambda: labels.marketplace_of(url()), "https://www.", 1, "N11"),
    "strict marketplace": (lambda: labels.marketplace_of(url(), strict=True), "HOST", 2, "N11"),
    "store": (lambda: labels.store_of(url(), F.lit("x"))["store"], "HOST", 2, "N11"),
    "url key": (lambda: text.url_match_key(url()), "HOST", 2, "n11.com/a-p-7"),
    "queries": (lambda: F.array_join(search.search_queries(F.col("name"), F.lit("f"), F.lit("{}")), "|"), "regexp_extract_all(", 2, "Acme Lamp ZX000002TRK"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_stands_once(spark, name):
    make, part, most, want = CASES[name]
    d = spark.createDataFrame([(7, "n11.com", "Acme Lamp ZX000002TRK")], "id int, host string, name string").repartition(1)
    df = d.select(make().alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count(part) <= most
    assert df.first()["v"] == want
