"""Operator 10: pairs at the threshold in buckets that stay large down to the deepest split."""

from __future__ import annotations

import numpy as np

from tarifa.llm import jaccard_join


def test_few_pairs_are_missed_at_the_deepest_level():
    r = np.random.default_rng(3)
    pairs, levels = 1500, 4
    a, b = (r.integers(0, 1 << 31, (pairs, jaccard_join.TOKENS), dtype=np.uint32) for _ in range(2))
    b = np.where(r.permuted(np.tile(np.arange(jaccard_join.TOKENS) < 51, (pairs, 1)), axis=1), a, b)
    met = np.zeros(pairs, bool)
    for run in range(1, jaccard_join._runs(0.9999, levels) + 1):
        pair, path = np.arange(pairs), np.full(pairs, run, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for c in [jaccard_join._C] + [jaccard_join._DEEPER] * levels:
            own, child = jaccard_join._chosen(path, a[pair], c)
            other, theirs = jaccard_join._chosen(path, b[pair], c)
            both = np.intersect1d(np.unique(child), np.unique(theirs))
            keep = np.isin(child, both)
            pair, path = pair[own[keep]], child[keep]
        met[pair] = True
    assert (~met).sum() <= 2  # 0.1 of 1,500 at 0.01 %; 12 at one c for every level and 8 runs


def test_rows_with_one_id_and_different_texts(spark):
    """Each row is compared by its own text, and the pipeline's near stage drops rows by id and text."""
    import corpus_pipeline

    r = np.random.default_rng(4)
    texts = [[f"w{x}" for x in r.integers(0, 10**9, 80)] for _ in range(12)]
    rows = []
    for k, w in enumerate(texts):
        # a row with the id of many and a near copy of it with an id of its own, or with none
        rows += [([5, None][k % 2], " ".join(w)), ([100 + k, None][k // 2 % 2], " ".join([*w[:-1], "other"]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = jaccard_join.join(docs).collect()
    assert len(got) == 24 and all(x["n_links"] == 1 and x["class_size"] == 2 for x in got)
    kept = sorted(x["text"] for x in corpus_pipeline.near(spark, docs, "").collect())
    assert len(kept) == 12 and {t.rpartition(" ")[0] for t in kept} == {" ".join(w[:-1]) for w in texts}


def test_a_common_passage_sends_no_row_without_a_partner_down(spark, monkeypatch):
    """Documents that share a passage alone meet in large buckets; only those with a near copy are split again."""
    r = np.random.default_rng(6)
    fresh = lambda n: [f"w{x}" for x in r.integers(0, 10**9, n)]
    passage = fresh(40)
    texts = [passage + fresh(110) for _ in range(600)]
    texts += [w[:130] + fresh(3) + w[133:] for w in texts[:50]]
    rows, settle = [], jaccard_join.settle

    def counted(df, name, **more):
        out = settle(df, name, **more)
        rows.extend([out.count()] if name == "paths" else [])
        return out

    monkeypatch.setattr(jaccard_join, "settle", counted)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard_join.join(docs).collect()}
    want = {i: (i - 600 if i >= 600 else i, int(i < 50 or i >= 600)) for i in range(650)}
    assert got == want
    assert rows and sum(rows) < 3000  # one node in six has a partner


def test_partners_share_as_many_tokens_as_counted_on():
    least = jaccard_join._least_shared()
    assert len(least) == jaccard_join.TOKENS + 1 and least[5] == 0 and 30 < least[64] < 0.6 * 64
    r = np.random.default_rng(7)
    for n in (12, 30, 64):
        assert (r.binomial(n, 0.8, 200_000) < least[n]).mean() < 3e-5
