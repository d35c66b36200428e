"""Operators 5 to 10 on nulls, empty and long texts, repeated rows, clashing column names and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarifa.llm import bpe, chain_dedup, jaccard_join, mixing, site_quality, suffix_dedup

LONG = " ".join(f"word{i}" for i in range(3000))
ROWS = [(None, None, None, None), (1, "", "en", "a"), (2, LONG, "xx", "b"), (2, LONG, "xx", "b"), (3, "a short one", "en", "a"), (4, "tail " + LONG, None, None)]
RANKS = {bytes([i]): i for i in range(256)} | {b"wo": 256, b"rd": 257, b"word": 258}


def _score(d):
    labels = d.sparkSession.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1), (99, 1)], "doc_id long, quality int")
    return site_quality.score(d, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


OPERATORS = {
    "site": _score,
    "suffix": suffix_dedup.dedup,
    "mixing": mixing.mix,
    "chain": chain_dedup.dedup,
    "bpe": lambda d: bpe.tokenise(d, RANKS, r"\S+|\s+", ["doc_id"]),
    "jaccard": jaccard_join.join,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    clashing = ("key", "bucket", "size", "kept", "n_words", "class_id", "target", "ids", "n_bytes", "spans", "payload", "kind", "n", "h", "host", "path", "quality")
    d = d.select("*", *[F.lit(1).alias(c) for c in clashing])
    rows = OPERATORS[name](d).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "2", "3", "4", "None"]
    assert OPERATORS[name](d.where("false")).collect() == []
    by = {r["doc_id"]: r for r in rows}
    if name == "suffix":
        assert by[2]["spans"] == [] and bytes(by[4]["kept"]).startswith(b"tail") and by[None]["n_bytes"] == 0
    if name == "mixing":
        assert by[None]["size"] == by[1]["size"] == by[1]["taken"] == 0 and all(r["taken"] <= 2 * r["size"] for r in rows)
    if name == "chain":
        assert by[2]["spans"] == [] and by[4]["spans"][0]["earlier"] == 2 and by[4]["n_repeated"] == 3000
    if name == "bpe":
        assert by[None]["n_tokens"] == by[1]["n_tokens"] == 0 and bytes(by[4]["decoded"]).decode() == "tail " + LONG
    if name == "jaccard":
        assert by[4]["class_id"] == by[2]["class_id"] == 2 and by[3]["class_id"] == 3
