"""Nulls, empty texts, repeated rows, clashing column names and empty tables."""

from __future__ import annotations

import pytest

from tarifa.llm import exact_dedup, license_scan, pii, quality_rules

ROWS = [(None, None, None, 1), (1, "", "en", 1), (2, "Card 4111 1111 1111 1111 on 2020-01-31", "xx", 2), (2, "Card 4111 1111 1111 1111 on 2020-01-31", "xx", 2), (3, "Released under the MIT License.\nrest", "en", 3)]
OPERATORS = {
    "quality": lambda d: quality_rules.judge(d, ["doc_id"]),
    "pii": lambda d: pii.pseudonymise(d, "k", ["doc_id"]),
    "licences": lambda d: license_scan.scan(d, ["doc_id"]),
    "exact": exact_dedup.dedup,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, key long").selectExpr("*", "key AS bucket", "key AS n_words", "key AS kept")
    rows = OPERATORS[name](d).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "2", "3", "None"]
    assert OPERATORS[name](d.where("false")).collect() == []
    by = {r["doc_id"]: r for r in rows}
    if name == "pii":
        assert by[None]["text"] is None and by[1]["text"] == "" and by[2]["n_replaced"] == 2 and by[3]["n_replaced"] == 0
    if name == "licences":
        assert by[3]["licences"] == ["MIT"] and by[None]["best"] is None
    if name == "exact":
        assert by[None]["keep_id"] == 1 and by[2]["group_size"] == 2 and by[2]["kept"]
    if name == "quality":
        assert all(r["base_failed"] and not r["kept"] for r in rows)
