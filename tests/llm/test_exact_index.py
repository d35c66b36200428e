"""Operator 4: its directory splits, chains collisions and gives the same rows as a plain version."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import plain

from tarifa.llm import exact_dedup


@pytest.mark.parametrize(("key_bits", "capacity"), [(64, 4), (8, 4), (2, 1), (64, 100_000)])
def test_index(spark, key_bits, capacity):
    r = random.Random(4)
    docs = [(i, r.choice(["Same TEXT", "same text", "", None, f"own {i}", f"pair {i // 2}", "\u00c4 " * (i % 5)])) for i in range(400)]
    docs.append((1000, "long " * 200_000))
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS norm", "3 AS bucket", "4 AS prefix")
    rows = exact_dedup.dedup(d, keep=["key", "bucket"], key_bits=key_bits, capacity=capacity)
    # clashing columns pass under their own names
    assert rows.columns.count("key") == 1 and rows.columns.count("bucket") == 2
    rows = exact_dedup.dedup(d, key_bits=key_bits, capacity=capacity).collect()
    assert {x["doc_id"]: (x["keep_id"], x["group_size"], x["text_sha256"]) for x in rows} == plain.exact(docs)
    assert all(x["kept"] == (x["doc_id"] == x["keep_id"]) for x in rows)
    buckets = {x["bucket"] for x in rows}
    assert len(buckets) > (1 if capacity < 100 else 0) and max(int(b.split("/")[0]) for b in buckets) <= key_bits


def test_directory_goes_deeper_than_one_pass(spark):
    """Keys that share their first 30 bits are split below them; a bucket holds at most its capacity."""
    keys = [(5 << 59) // 2 * 0 + (i << 20) for i in range(64)] + [-(1 << 62) + i * (1 << 50) for i in range(64)]
    d = spark.createDataFrame([(k,) for k in keys], "key long")
    buckets = exact_dedup.directory(d, 8)
    routed = exact_dedup.route(d, buckets).groupBy("bucket").count().collect()
    assert sum(r["count"] for r in routed) == 128 and max(r["count"] for r in routed) <= 8
    assert max(r["depth"] for r in buckets.collect()) > 30


def test_ties_and_repeats(spark):
    """Rows that repeat the staying id are all kept; null ids are smaller than every other."""
    d = spark.createDataFrame([(None, "a"), (None, "a"), (3, "A"), (3, "a"), (None, "b")], "doc_id long, text string")
    rows = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup.dedup(d).collect())
    assert rows == [("3", "3", 4, True), ("3", "3", 4, True), ("None", "3", 4, False), ("None", "3", 4, False), ("None", "None", 1, True)]
    assert exact_dedup.dedup(d.where("false")).collect() == []
