"""Operator 12 against SQL and a plain version."""

from __future__ import annotations

import random
import re

import oracle
import plain
import pytest

from tarifa.llm import decontaminate, queries

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(plain.ASCII))


def contamination(docs, items, size=10):
    """Per document: (doc_id, n_words, n_hit, items, contaminated)."""
    wanted = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in wanted}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    found |= wanted[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf", [SMALL, oracle.MEDIUM])
def test_query_agrees_with_sql(spark, sf):
    assert oracle.compare(spark, queries.op12_decontamination, queries.ORACLE_SQL["op12_decontamination"], sf) == ""


def corpus(seed):
    """Few words, so that windows overlap, repeat and share shingles; items shorter than a window and than a shingle."""
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice("a b c ä x1 é".split()) for _ in range(n))
    items = [(1, text(30)), (2, text(12)), (3, text(10)), (4, text(7)), (5, "zeta b c"), (6, "lone"), (7, ""), (8, None), (None, text(11)), (2, text(14))]
    docs = [(i, text(r.choice([0, 3, 9, 40]))) for i in range(20)]
    for i, (item, passage) in enumerate(items * 3):
        docs.append((100 + i, f"{text(5)} -- {(passage or '').upper().replace(' ', ', ')}! {text(3)}"))
    docs += [(None, items[0][1]), (None, "lone"), (7, None), (8, ""), (100, docs[20][1]), (9, "ALL.LONE;zeta,b--c lone")]
    return docs, items


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_plain(spark, broadcast):
    docs, items = corpus(3)
    d = spark.createDataFrame([(*x, 1, 2, "k") for x in docs], "doc_id long, text string, row long, n_words long, key string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, words long")
    want = contamination(docs, items)
    assert got(decontaminate.contamination(d, b, broadcast=broadcast)) == want
    assert sum(x[2] for x in want) > 40


def test_empty_tables(spark):
    docs, items = corpus(4)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(d.where("false"), b).collect() == []
    assert got(decontaminate.contamination(d, b.where("false"))) == contamination(docs, [])


def test_long_texts_and_words(spark):
    """A text of more than a block, a word of more than a block, and a hot passage in one of them."""
    item = " ".join(f"w{i}" for i in range(25))
    long = " ".join(f"v{i}" for i in range(200_000))
    docs = [(1, f"{long} {item} {'q' * 1_500_000} {item} {item} end"), (2, "q" * 1_200_000), (3, item)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, "q" * 1_200_000)], "item_id long, text string")
    assert got(decontaminate.contamination(d, b)) == contamination(docs, [(1, item), (2, "q" * 1_200_000)])
