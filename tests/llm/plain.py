"""Plain Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict

SPACE = "[\x20\x09-\x0d]+"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return [w for w in re.split(SPACE, text or "") if w]


def base_counts(text: str | None) -> tuple:
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


def exact(docs: list[tuple[int, str | None]]) -> dict:
    """doc_id: (keep_id, group_size, sha256)."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(ASCII)].append(i)
    return {i: (max(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def cut(docs: list[tuple[int, str | None]], length: int = 50) -> dict:
    """doc_id: (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    seen: set[bytes] = set()
    out = {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        starts = [k for k in range(len(b) - length + 1) if b[k : k + length] in seen]
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
        gone = bytearray(len(b))
        for k in starts:
            gone[k : k + length] = b"\1" * length
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def shingles(text: str | None) -> frozenset:
    w = words((text or "").translate(ASCII))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(docs: list[tuple[int, str | None]], threshold: float = 0.8) -> dict:
    """doc_id: (class_id, class_size, n_links)."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)):
            both = len(x & y)
            if 5 * both >= 4 * (len(x) + len(y) - both):
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)))
                root[high] = low
    size = Counter(find(i) for i in sets)
    return {i: (find(i), size[find(i)], links[i]) for i in sets}


def bpe(texts: list[str]):
    """(ids, decoded bytes) of each text by the tiktoken library."""
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in texts:
        ids = enc.encode_ordinary(t)
        yield ids, enc.decode_bytes(ids)


def digests(text: str) -> tuple:
    ids, decoded = next(bpe([text]))
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()
