"""Texts of titles: what is costly stands once in the plan, and rows of a small file are dealt to all cores."""

from __future__ import annotations

import oracle
import pytest
from pyspark.sql import functions as F

from tarifa.functions import search
from tarifa.plans import registry


@pytest.mark.parametrize("make, part", [(search.search_variations, "regexp_extract("), (search.strip_noise, "[^\\p{L}\\p{N}]+")])
def test_stands_once(spark, make, part):
    d = spark.createDataFrame([("Acme Lamp ZX000002TRK",), ("ab",), ("",), (None,)], "name string").repartition(1)
    df = d.select(make(F.col("name")).alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count(part) == 1
    want = {"regexp_extract(": [["Acme Lamp ZX000002TRK", "Acme Lamp", "ZX000002TRK"], ["ab"], [""], []]}.get(part, ["Acme Lamp ZX000002TRK", "ab", "", None])
    assert sorted((r["v"] for r in df.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["search_texts", "search_queries"])
def test_small_files_use_all_cores(spark, name):
    df = registry.QUERIES[name](spark, oracle.SMALL)
    assert df.rdd.getNumPartitions() >= 8
    if name in registry.ORACLE_SQL:
        assert oracle.compare(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], oracle.MEDIUM) == ""
