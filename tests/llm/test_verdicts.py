"""Operators 1 and 5: verdicts and posteriors against plain versions on the whole small table."""

from __future__ import annotations

import math
import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain

from tarifa.llm import quality_rules
from tarifa.llm import queries as q
from tarifa.llm.common import table, words


def shares(counts: list[float]) -> list[float]:
    total = sum(counts)
    return [c / total if total else 0.0 for c in counts]


def js(p: list[float], r: list[float]) -> float:
    m = [(a + b) / 2 for a, b in zip(p, r)]
    side = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m) if a > 0)
    return math.sqrt(max(0.0, (side(p) + side(r)) / 2))


def test_op1_verdicts(spark):
    docs = duckdb.sql(f"SELECT doc_id, text, lang FROM '{oracle.SMALL}/documents.parquet'").fetchall()
    names = [w for ws in quality_rules.COMMON.values() for w in ws]
    of, means = {}, defaultdict(list)
    for i, text, lang in docs:
        text = text or ""
        w = plain.words(text)
        classes = [sum(map(len, re.findall(p, text))) for p in quality_rules.CLASSES.values()]
        inside = sum(map(len, w))
        c = shares([*classes, len(text) - inside, inside - sum(classes)])
        low = [x.lower() for x in w]
        hits = [low.count(n) for n in names]
        v = [h / len(w) for h in [*hits, len(w) - sum(hits)]] if w else None
        lang = lang if lang in quality_rules.COMMON else "*"
        failed = plain.base_counts(text)[-1]
        of[i] = (lang, c, v, failed, len(w))
        if not failed:
            means[lang].append((c, v))
    refs = {k: [[sum(col) / len(rows) for col in zip(*(r[j] for r in rows))] for j in (0, 1)] for k, rows in means.items()}
    got = {r["doc_id"]: r for r in quality_rules.judge(table(spark, oracle.SMALL, "documents"), ["doc_id"]).collect()}
    assert set(got) == set(of)
    for i, (lang, c, v, failed, n) in of.items():
        d = [js(x, r) for x, r in zip((c, v), refs[lang])] if n >= 50 and lang in refs else [None, None]
        for have, want in zip((got[i]["class_distance"], got[i]["word_distance"]), d):
            assert (have is None) == (want is None) and (want is None or have == pytest.approx(want, abs=1e-6))
        odd = d[0] is not None and (d[0] > 0.3 or d[1] > 0.35)
        if d[0] is None or min(abs(d[0] - 0.3), abs(d[1] - 0.35)) > 1e-6:
            assert got[i]["kept"] == (not failed and not odd)


@pytest.mark.parametrize("hash_bits", [1, 4, 38])
def test_repeated_words_with_colliding_hashes(spark, hash_bits):
    """Windows that share a hash and interleave; short, long and empty texts."""
    r = random.Random(7)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randrange(0, 60))) for _ in range(200)] + ["", "a", "a b c d a b c", "x " * 30_000]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("w", words(F.col("text")))
    got = {x["i"]: x["n"] for x in d.select("i", quality_rules.repeat_words(F.col("w"), hash_bits).alias("n")).collect()}
    assert got == {i: plain.base_counts(t)[4] for i, t in enumerate(texts)}


def test_op5_posteriors(spark):
    """The site's share of the evidence, recomputed from the documents' own probabilities."""
    docs = {i: (s, lang) for i, s, lang in duckdb.sql(f"SELECT doc_id, source, lang FROM '{oracle.SMALL}/documents.parquet'").fetchall()}
    rows = q.op5_site_quality(spark, oracle.SMALL).collect()
    assert len(rows) == len(docs)
    host = {i: s for i, (s, _) in docs.items()}
    path = {i: "/".join(x for x in v if x is not None) for i, v in docs.items()}
    p = {r["doc_id"]: r["p_document"] for r in rows}
    micro = {i: math.floor(x * 1e6 + 0.5) / 1e6 for i, x in p.items()}

    def sums(key):
        out = defaultdict(lambda: [0, 0.0])
        for i in p:
            out[key(i)][0] += 1
            out[key(i)][1] += micro[i]
        return out

    hosts, paths = sums(lambda i: host[i]), sums(lambda i: (host[i], path[i]))
    m0 = sum(micro.values()) / len(p)

    def pseudo(groups, parent):
        n = sum(g[0] for g in groups.values())
        var = sum(parent(k) * (1 - parent(k)) for k in groups)
        spread = sum(g[0] * (g[1] / g[0] - parent(k)) ** 2 for k, g in groups.items()) / n
        between = max(spread - var / n, 1e-4)
        return min(max(var / len(groups) / between - 1, 2.0), 10_000.0)

    k0 = pseudo(hosts, lambda _: m0)
    mean = {h: (s + k0 * m0) / (n + k0) for h, (n, s) in hosts.items()}
    k1 = pseudo(paths, lambda k: mean[k[0]])
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    for r in rows:
        i = r["doc_id"]
        n, s = paths[host[i], path[i]]
        site = (s - p[i] + k1 * mean[host[i]]) / (n - 1 + k1)
        final = logit(p[i]) + 0.5 * (logit(site) - logit(m0))
        assert r["n_site"] == n and r["p_site"] == pytest.approx(site, abs=1e-6)
        assert r["p_quality"] == pytest.approx(1 / (1 + math.exp(-final)), abs=1e-6)
        assert r["kept"] == (r["p_quality"] >= 0.25)
