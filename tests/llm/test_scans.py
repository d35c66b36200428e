"""Operators 2 and 3 against plain versions over the whole small table."""

from __future__ import annotations

import hashlib
import re
from datetime import date, timedelta

import duckdb
import oracle
import regex

from tarifa.llm import license_scan, pii
from tarifa.llm import queries as q

DOCS = f"{oracle.SMALL}/documents.parquet"
KEY = "a key that a caller would keep secret"
DIGITS, HEX = ["0123456789"], ["0123456789abcdef"]
LETTERS = [*DIGITS, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]


def noise(*parts) -> int:
    return int(hashlib.sha256("|".join(map(str, (KEY, *parts))).encode()).hexdigest()[:13], 16)


def permute(s: str, kind: str, sets: list[str]) -> str:
    cut = (len(s) + 1) // 2
    halves = [s[:cut], s[cut:]]
    for r in range(8):
        part, other = halves[r % 2], halves[1 - r % 2]
        moved = ""
        for i, c in enumerate(part):
            own = next((x for x in sets if c in x), None)
            moved += own[(own.index(c) + noise(kind, r, i, other)) % len(own)] if own else c
        halves[r % 2] = moved
    return "".join(halves)


def luhn(digits: str) -> int:
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))


def refill(shape: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c in DIGITS[0] else c for c in shape)


def address(m: str) -> str:
    x = list(map(int, m.split(".")))
    for r in range(8):
        other = f"{x[2]}.{x[3]}"
        x = [x[2], x[3], (x[0] + noise("ip", r, 0, other)) % 256, (x[1] + noise("ip", r, 1, other)) % 256]
    return ".".join(map(str, x))


def day(m: str) -> str:
    first = date(1900, 1, 1)
    days, x = (date(2100, 1, 1) - first).days, (date.fromisoformat(m) - first).days
    while True:
        left, right = divmod(x, 283)
        for r in range(8):
            left, right = right, (left + noise("date", r, right)) % 283
        x = left * 283 + right
        if x < days:
            return str(first + timedelta(x))


def walked(digits: str, kind: str, fits) -> str:
    while True:
        digits = permute(digits, kind, DIGITS)
        if fits(digits):
            return digits


def pseudonym(m: str) -> str:
    full = lambda k: re.search(f"^(?:{pii.KINDS[k]})$", m, re.A)
    digits = re.sub("[^0-9]", "", m)
    if full("email"):
        user, host = m.split("@")
        if len(user) > 64 or len(host) > 253:
            return m
        host, _, top = host.rpartition(".")
        return f"{permute(user, 'email', LETTERS)}@{permute(host, 'host', LETTERS)}.{top}"
    if full("secret") and re.search("[a-f]", m):
        return permute(m, "secret", HEX)
    if full("ip"):
        return address(m) if all(int(o) < 256 and str(int(o)) == o for o in m.split(".")) else m
    if full("date"):
        try:
            return day(m)
        except ValueError:
            return m
    if full("phone"):
        country, national = digits[:-10], digits[-10:]
        fits = (lambda n: n[0] > "1" and n[3] > "1") if country in ("", "1") else (lambda n: True)
        return refill(m, country + walked(national, "phone", fits)) if fits(national) else m
    if full("ssn"):
        fits = lambda n: n[:3] not in ("000", "666") and n[0] != "9" and n[3:5] != "00" and n[5:] != "0000"
        return refill(m, walked(digits, "ssn", fits)) if fits(digits) else m
    if full("card") and luhn(digits) % 10 == 0:
        body = permute(digits[:-1], "card", DIGITS)
        return refill(m, body + str(-luhn(body + "0") % 10))
    return m


def test_op2(spark):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{DOCS}'").fetchall()
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in q.op2_pii(spark, oracle.SMALL).collect()}
    want, seen = {}, {}
    for i, t in texts:
        n = 0

        def put(m):
            nonlocal n
            new = pseudonym(m[0])
            n += new != m[0]
            seen[m[0]] = new
            return new

        want[i] = (None if t is None else re.sub(pii.PATTERN, put, t, flags=re.A), n)
    assert got == want
    assert any(a != b for a, b in seen.items())
    assert len(set(seen.values())) == len(seen)  # different values stay different
    assert all(len(a) == len(b) for a, b in seen.items() if not re.search(r"^\d+(\.\d+){3}$", a))


def test_op3(spark):
    known = license_scan.templates(license_scan.NOTICES)
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{DOCS}'").fetchall()
    want = {}
    for i, t in texts:
        units = (t or "").split("\n")
        found, matched = [], 0
        for u in [*units, t] if len(units) > 1 else units:
            w = regex.sub(r"[^\p{L}\p{N}]+", " ", u.lower()).strip(" ").split(" ")
            b = {f"{x} {y}" for x, y in zip(w, w[1:])}
            hits = [(2 * len(b & set(bs)) / (len(b) + len(bs)), name) for name, bs in known]
            hits = [h for h in hits if h[0] >= 0.8]
            found += hits
            matched += bool(hits)
        want[i] = (matched, sorted({h[1] for h in found}), max((h[0] for h in found), default=None))
    got = {r["doc_id"]: (r["n_matches"], r["licences"], r["best"]) for r in q.op3_license_scan(spark, oracle.SMALL).collect()}
    assert got == want and any(w[0] for w in want.values())


HARD = {
    1: "a@" + "b." * 10_000 + "c",
    2: "x" * 1_000_000,
    3: "x" * 200_000 + "@" + "y" * 200_000,
    4: "010.1.1.1 and 10.1.1.1 and 256.1.1.1",
    5: "000-00-0000, 666-12-3456, 123-45-6789 and 123-45-6780",
    6: "(012) 345-6789, (234) 567-8901, 234-567-8902 and +44 012 345 6789",
    7: "1 " * 100_000 + "2000-01-01-" * 20_000,
    8: "user@one.example, user@one.example; and user@" + "h" * 300 + ".example",
    9: "0123456789abcdef" * 5,
}


def test_op2_hard_texts(spark):
    """Texts that a backtracking pattern would not survive, and values that are no valid ones."""
    d = spark.createDataFrame(list(HARD.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in pii.pseudonymise(d, "a key that a caller would keep secret", ["doc_id"]).collect()}
    want = {}
    for i, t in HARD.items():
        n = 0

        def put(m):
            nonlocal n
            new = pseudonym(m[0])
            n += new != m[0]
            return new

        want[i] = (re.sub(pii.PATTERN, put, t, flags=re.A), n)
    assert got == want
    assert [got[i][1] for i in (1, 2, 3, 4, 5, 9)] == [0, 0, 0, 1, 2, 0]
    one, two = got[8][0].split(";")[0].split(", ")
    assert one == two != "user@one.example" and got[8][0].endswith("h" * 300 + ".example")
    numbers = re.findall(r"\d{3}-\d{2}-\d{4}", got[5][0])
    assert len(set(numbers)) == 4 and numbers[:2] == ["000-00-0000", "666-12-3456"]
