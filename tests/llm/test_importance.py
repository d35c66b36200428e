"""Operator 11 against a plain version."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import plain
import pytest

from tarifa.llm import importance, queries
from tarifa.llm.common import table

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall((text or "").translate(plain.ASCII))
    grams = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    return len(w), [zlib.crc32(g.encode()) % 10000 for g in grams]


def resample(docs, target):
    """doc_id: (n_features, weight, score, rank) of distinct ids."""
    found = {i: features(x) for i, x in docs}
    s, t = Counter(b for _, f in found.values() for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000.0) / ((s[b] + 1.0) * (big_t + 10000.0)))) for b in s}
    out, able = {}, []
    for i, (n, f) in found.items():
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if n >= 20:
            able.append(i)
    able.sort(key=lambda i: (-out[i][2], i is None, i or 0))
    for k, i in enumerate(able[: 25 * len(able) // 100]):
        out[i][3] = k + 1
    return {i: tuple(v) for i, v in out.items()}


def got(df):
    rows = df.select("doc_id", "n_features", "weight", "score", "rank").collect()
    return {r[0]: tuple(r[1:]) for r in rows}, len(rows)


def test_query_agrees_with_plain(spark):
    docs = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    target = [r[0] for r in table(spark, SMALL, "benchmark").select("text").collect()]
    found, n = got(queries.op11_importance_resampling(spark, SMALL))
    assert n == len(docs) and found == resample(docs, target)
    assert sum(v[3] is not None for v in found.values()) > 10


def test_edges(spark, monkeypatch):
    """Nulls, empty, symbols only, one long word, long texts cut into pieces, repeated rows, clashing columns, empty tables."""
    long = " ".join(f"Wört{i % 7}, x{i}" for i in range(3000))
    docs = [(None, "a b " * 20), (1, None), (2, ""), (3, "?! -- \n"), (4, "ä" * 5000), (5, long), (6, "A b-C d_e " * 9), (7, "one"), (8, "same text " * 15), (9, "same text " * 15), (10, "x" * 63 + " " + "y" * 64 + " " + "z" * 65)]
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id long, text string, codes long, weight long, _range long")
    aim = spark.createDataFrame([("same words and others",), (None,)], "text string")
    want = resample(docs, ["same words and others", None])
    assert got(importance.resample(d, aim)) == (want, len(docs))
    huge = spark.createDataFrame([(2**60 + 1, "one two"), (None, "one")], "doc_id long, text string").coalesce(1)
    assert set(got(importance.resample(huge, aim))[0]) == {2**60 + 1, None}
    twice, n = got(importance.resample(d.unionByName(d.where("doc_id = 8")), aim))
    assert n == len(docs) + 1 and set(twice) == set(want)
    assert importance.resample(d.where("false"), aim).collect() == []
    assert got(importance.resample(d, aim.where("false")))[0] == resample(docs, [])
    kept = importance.resample(d, aim, keep=["weight", "text"]).where("doc_id = 10").first()
    assert kept["kept"]["weight"] == 2 and kept["kept"]["text"] == docs[-1][1]


def test_pieces_and_windows():
    """A text in pieces has the features of the whole, for windows of up to three words."""
    text = ("some Wörds and " + "q" * 90 + " more; ") * 40
    whole = importance.Features(10_000, 3)
    n, want = whole(text.encode())
    saved, importance.pieces.__defaults__ = importance.pieces.__defaults__, (37,)
    try:
        m, found = whole(text.encode())
    finally:
        importance.pieces.__defaults__ = saved
    assert n == m and Counter(found.tolist()) == Counter(want.tolist())
    w = WORD.findall(text.translate(plain.ASCII))
    assert Counter(want.tolist()) == Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1))


@pytest.mark.parametrize("n", [1, 3, 50])
def test_ranks_are_dense(spark, n):
    d = spark.createDataFrame([(i, "word " * 25) for i in range(n)], "doc_id long, text string")
    ranks = sorted(r["rank"] for r in importance.resample(d, d).collect() if r["rank"])
    assert ranks == list(range(1, n * 25 // 100 + 1))
