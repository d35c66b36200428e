"""Operator 9: the dictionary in the plan is small, and finds each word whatever its neighbours in a slot."""

from __future__ import annotations

import hashlib

import plain
import public_tokenizers
import pytest

from tarifa.llm import bpe

WORDS = ["a", "ab", "b", "ba", "abab", "\x01", "\x02a", "é", "\xfe", "\xff", "þa", "€", "\U0001f600", "ÿ", "7", ",", "!", "!!"]


@pytest.fixture
def sizes(monkeypatch):
    """Bytes of the tables that go into the plan, by name."""
    found, settle = {}, bpe.settle

    def measured(df, name, *more):
        out = settle(df, name, *more)
        if name in ("frequent", "rest", "ranks"):
            found[name] = out._jdf.queryExecution().executedPlan().executeCollect()[0].getSizeInBytes()
        return out

    monkeypatch.setattr(bpe, "settle", measured)
    return found


@pytest.mark.parametrize("slots", [4, 1 << 18])
def test_dictionary(spark, monkeypatch, sizes, slots):
    """With few slots each holds many words; some words are in no part of the dictionary."""
    monkeypatch.setattr(bpe, "HOT", 8, raising=False)
    monkeypatch.setattr(bpe, "BUCKETS", slots)
    made = [hashlib.sha256(str(i).encode()).hexdigest()[: 3 + i % 5].translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(3000)]
    texts = [" ".join(WORDS[i:] + WORDS[:i]) for i in range(len(WORDS))] + ["".join(WORDS), None, ""] + [" ".join(made[i : i + 50]) for i in range(0, 3000, 50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    got = {r["doc_id"]: r for r in bpe.tokenise(docs, ranks, public_tokenizers.PATTERN, ["doc_id"], frequent=2500).collect()}
    for i, (ids, decoded) in enumerate(plain.bpe([t or "" for t in texts])):
        assert (got[i]["ids"], bytes(got[i]["decoded"])) == (",".join(map(str, ids)), decoded), texts[i]
    assert sizes["ranks"] < 8_000_000 and sum(sizes.values()) - sizes["ranks"] < 9 * slots + 60 * 2500
