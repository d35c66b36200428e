"""Operator 6: anchors spread over all buckets, with and without the bits that don't travel; hot anchors."""

from __future__ import annotations

import pickle
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarifa.llm import suffix_dedup
from tarifa.llm.bytesets import mix

sys.path.insert(0, str(Path(__file__).parent))
import plain


def test_fetched_regions_use_every_bucket():
    n, buckets = 4000, 32
    h = mix(np.arange(n, dtype=np.uint64))
    row = np.zeros(n, np.int64)
    zero = np.zeros(n, np.uint32)
    payload = suffix_dedup._pack(row, np.array([1]), np.array([2]), h=h, a=zero, n=np.full(n, 9, np.uint8), o=zero.astype(np.uint8))
    docs = pd.DataFrame({"doc_id": [1], "key": [2], "text": [b"some text"]})
    got = suffix_dedup._fetch(50, buckets)(docs, pd.DataFrame({"kind": [2], "payload": [payload]}))
    assert sorted(got["bucket"]) == list(range(buckets))
    assert sum(len(pickle.loads(p)["h"]) for p in got["payload"]) == n
    # the same bucket before and after the travel
    assert (suffix_dedup._anchor_home(h, buckets) == suffix_dedup._anchor_home(h >> np.uint64(16) << np.uint64(16), buckets)).all()


@pytest.mark.parametrize("hot", [0, 3, 500])
def test_hot_passages(spark, hot):
    """Near copies and a passage that most documents share, its regions dealt out by their bytes or not."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefgh  \u00e9"))
    passage = "".join(rng.choice(letters, 400))
    docs = []
    for i in range(240):
        own = "".join(rng.choice(letters, rng.integers(0, 90)))
        text = list(passage)
        for at in rng.integers(0, len(text), rng.integers(0, 4)):
            text[at] = rng.choice(letters)
        docs.append((i, own + "".join(text[rng.integers(0, 40) :]) + own[::-1]))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    kept = F.sha2("kept", 256).alias("sha")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]).alias("removed")
    rows = suffix_dedup.dedup(d, hot=hot).select("doc_id", "n_bytes", removed, F.size("spans").alias("n"), kept).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == plain.cut(docs)
