"""Operator 13 against a plain version that walks the grammar's states."""

from __future__ import annotations

import functools
import hashlib
import random
import sys
import zlib
from collections import defaultdict

import pytest

from tarifa.llm import conversations, queries
from tarifa.llm.common import table

SMALL = "/root/testdata/sf0.001"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
sys.setrecursionlimit(20_000)
STEPS = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(turns):
    """(cost, audit) by recursion over (turn, last initial): the cheapest rest, then the least letters."""

    @functools.cache
    def rest(i, last, inserts):
        ways = []
        if i == len(turns) and last in ("", "a"):
            ways.append((0, ""))
        if inserts < 3:
            for to in STEPS[last].replace("s", ""):
                cost, audit = rest(i, to, inserts + 1)
                ways.append((cost + 2, "I" + audit))
        if i < len(turns):
            initial, gone, flaw = turns[i]
            cost, audit = rest(i + 1, last, 0)
            ways.append((cost + 3, "D" + audit))
            for to in "" if gone else STEPS[last]:
                cost, audit = rest(i + 1, to, 0)
                if initial == to:
                    ways.append((cost + flaw, "K" + audit))
                elif to != "s":
                    ways.append((cost + flaw + 2, "R" + audit))
        return min(ways, default=(10**9, ""))

    return rest(0, "", 0)


def damaged(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def summary(rows):
    by = {r[0]: [] for r in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in own:
            end = text.rstrip(SPACE)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = cheapest([(r[2][:1], f in ("blank", "duplicate"), int(f == "truncated")) for r, f in zip(own, faults)])
        aim, fixed, left = iter("s" * (sum(c != "D" for c in audit) % 2) + "ua" * len(audit)), [], iter(own)
        for c in audit:
            role = {"u": "user", "a": "assistant", "s": "system"}[next(aim)] if c != "D" else ""
            r = next(left) if c != "I" else None
            if c != "D":
                fixed.append(f"{r[2] if c == 'K' else role}:{r[3] if r else ''}")
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.01"])
def test_query_agrees_with_plain(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_conversation_repair(spark, sf)) == summary(rows)


@pytest.mark.parametrize("seed", range(40))
def test_alignment(seed):
    """Both forms of the table give the recursion's cost and least audit."""
    r = random.Random(seed)
    for _ in range(60):
        turns = [(r.choice("ssuuuaaa x") if r.random() < 0.9 else "", r.random() < 0.2, int(r.random() < 0.2)) for _ in range(r.randint(1, 14))]
        want = cheapest(tuple(turns))
        assert conversations.repair(turns) == want
        assert conversations.repair_folded(turns) == want
        assert conversations.incumbent(turns) >= want[0]


def test_long_conversation():
    r = random.Random(1)
    turns = [("ua"[i % 2] if r.random() < 0.85 else r.choice("sua"), r.random() < 0.05, int(r.random() < 0.05)) for i in range(300)]
    assert conversations.repair(turns) == conversations.repair_folded(turns) == conversations.repair(turns, whole=10)
    assert len(conversations.repair_folded(turns * 300)[1]) >= 90_000


def test_edges(spark):
    """Null conversations, turns, roles and texts, ties, repeated rows, roles without an initial, a long text, a long conversation; clashing columns."""
    rows = [(None, 0, "user", "Hi."), (None, None, None, "x?"), (None, None, "assistant", None), (1, 5, "user", "A."), (1, 5, "user", "A."), (1, 5, "assistant", "B. \n"), (1, 9, "", "C!")]
    rows += [(2, None, "system", "S."), (3, 0, "tool", "T "), (4, 1, "user", "long. " * 100_000), (4, 2, "assistant", "z" * 300_000)]
    rows += [(5, i, "user" if i % 3 else "assistant", f"t{i % 50}.") for i in range(700)]
    rows += [(100 + i, 0, "user", "only.") for i in range(60)]  # some lose their only row
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, n long, fault long")
    want = summary(rows)
    assert got(conversations.summary(d, conversations.damage(d))) == want
    assert any(w[7] == "" for w in want)
    assert conversations.summary(d.where("false"), conversations.damage(d.where("false"))).collect() == []
    turns = conversations.repair_all(conversations.damage(d))[1].where("conv_id = 5").orderBy("n", "place").collect()
    assert [r["role"] for r in turns][:4] == ["user", "assistant"] * 2
