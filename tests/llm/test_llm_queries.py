"""The queries of the training-data operators against plain versions on whole small tables."""

from __future__ import annotations

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb
import oracle
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import plain

from tarifa.llm import queries as q

DOCS = f"{oracle.SMALL}/documents.parquet"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{DOCS}'").fetchall()


@pytest.fixture(scope="module")
def texts(docs):
    return [(d[0], d[1]) for d in docs]


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    assert oracle.compare(spark, q.QUERIES[name], q.ORACLE_SQL[name], oracle.SMALL) == ""


def test_op1(spark, texts):
    got = {r["doc_id"]: r for r in q.op1_quality_rules(spark, oracle.SMALL).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {i: tuple(r[n] for n in names) for i, r in got.items()} == {i: plain.base_counts(t) for i, t in texts}
    assert not any(r["kept"] and r["base_failed"] for r in got.values())
    good = [r for r in got.values() if not r["base_failed"]]
    assert sum(r["kept"] for r in good) > 0.8 * len(good)


def test_op4(spark, texts):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in q.op4_exact_dedup(spark, oracle.SMALL).collect()}
    assert got == plain.exact(texts)


def test_op5_held_out(spark):
    """Documents that the bounded sample of labels doesn't hold are told apart."""
    from pyspark.sql import functions as F

    from tarifa.llm import site_quality
    from tarifa.llm.common import table

    sf = "/root/testdata/sf0.01"
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels").where("quality IS NOT NULL")
    train, test = labels.where("xxhash64(doc_id) % 2 = 0"), labels.where("xxhash64(doc_id) % 2 <> 0")
    got = site_quality.score(d, train, F.col("source"), F.concat_ws("/", "source", "lang"))
    rows = got.join(test, "doc_id").select("p_quality", "quality").collect()
    good, bad = [r[0] for r in rows if r[1]], [r[0] for r in rows if not r[1]]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / max(1, len(good) * len(bad))
    assert auc > 0.85


def test_op6(spark, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in q.op6_suffix_dedup(spark, oracle.SMALL).collect()}
    assert got == plain.cut(texts)


def test_op7(spark, docs):
    rows = q.op7_mixing(spark, oracle.SMALL).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in docs)
    size = {d[0]: len(plain.words(d[1])) for d in docs}
    source = {d[0]: d[3] for d in docs}
    whole = Counter()
    for i, n in size.items():
        whole[source[i]] += n
    order = sorted(whole, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, open_ = {}, set(order)
    while open_:
        left = 1.5 * sum(whole.values()) - sum(goal.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * whole[s] * (1 + 1e-12)]
        if not full:
            goal |= share
            break
        goal |= {s: 2.0 * whole[s] for s in full}
        open_ -= set(full)
    taken = Counter()
    for r in rows:
        i = r["doc_id"]
        assert r["size"] == size[i] and r["source_size"] == whole[source[i]] and 0 <= r["taken"] <= 2 * size[i]
        assert math.isclose(r["target"], goal[source[i]], rel_tol=1e-6)
        taken[source[i]] += r["taken"]
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(n for i, n in size.items() if source[i] == s)
    assert sorted(rows) == sorted(q.op7_mixing(spark, oracle.SMALL).collect())


def test_op9(spark, texts):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in q.op9_byte_bpe(spark, oracle.SMALL).collect()}
    assert got == {i: plain.digests(t or "") for i, t in texts}


def test_op10(spark, texts):
    got = {r["doc_id"]: (r["class_id"], r["class_size"], r["n_links"]) for r in q.op10_jaccard_join(spark, oracle.SMALL).collect()}
    assert got == plain.near(texts)


def test_pipeline(spark, docs):
    """Each stage on its own input, by plain rules; the mix itself is tested above."""
    import corpus_pipeline as p
    from tarifa.llm.common import settle, table

    d = table(spark, oracle.SMALL, "documents")
    kept = settle(p.quality(spark, d, oracle.SMALL), "t1")
    judged = {r["doc_id"] for r in q.op1_quality_rules(spark, oracle.SMALL).where("kept").select("doc_id").collect()}
    one = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert {i for i, _ in one} == judged
    single = settle(p.exact(spark, kept, oracle.SMALL), "t2")
    two = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert {i for i, _ in two} == {i for i, (keep, _, _) in plain.exact(one).items() if keep == i}
    alone = settle(p.near(spark, single, oracle.SMALL), "t3")
    three = [(r["doc_id"], r["text"]) for r in alone.collect()]
    assert {i for i, _ in three} == {i for i, (c, _, _) in plain.near(two).items() if c == i}
    mixed = settle(p.mix(spark, alone, oracle.SMALL), "t4")
    four = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert set(four) <= set(three) and max(Counter(four).values()) <= 2
    last = Counter(tuple(r) for r in p.encode(spark, mixed, oracle.SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert last == Counter((i, *plain.digests(t)) for i, t in four)
    run = Counter(tuple(r) for r in p.run(spark, oracle.SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert run == last
