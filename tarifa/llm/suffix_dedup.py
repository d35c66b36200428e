"""Operator 6: exact substring dedup by hash-compared suffix sorting.

A byte is removed if a `length`-byte string that covers it also starts in a document with a smaller id.

1. Anchors: of the GRAM-byte strings in each window of `length` bytes, the one with the least hash. Equal windows have
   the same anchor, so only suffixes near equal anchors can match. The windows with one anchor form a region.
2. Anchors meet by hash bucket. A region whose anchor and whole region agree with those of a smaller document
   (two 48-bit hashes besides the bucket) is covered as a whole.
3. Where an anchor occurs in different regions, one region of each kind fetches its bytes. Its suffixes are sorted
   by mergesort: prefix polynomial hashes and binary search give the common extension of two suffixes, so a comparison
   takes log(length) steps. Neighbours with a common extension of `length` are confirmed byte by byte.
   The regions of an anchor that occurs in over `hot` kinds of them do not meet in one place: they are cut into spans of
   STEP neighbouring windows. Equal spans are folded, byte by byte, to the least id where they are fetched, and a span
   goes to a bucket by the bytes that all its windows share, so equal windows still meet.
4. Documents meet their covered intervals by bucket of their id and are cut.

Rows travel as packed arrays, one row for each task and bucket, so no row stands for a single suffix.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import Prefix, chunks, mix, release
from .common import settle

GRAM = 20
#: Windows to a span of a hot anchor's region.
STEP = 4
#: Regions that a task holds before it folds and sends them, and suffixes that are sorted at once.
_HELD, _SORTED = 1_000_000, 200_000
_NULL = np.iinfo(np.int64).min


def _planes(x: np.ndarray, low: int = 0) -> np.ndarray:
    """Bytes of an array by place value (compresses well), from byte `low` on."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, low:].T)


def _unplane(p: np.ndarray, kind, low: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    out = np.zeros((p.shape[1], size), dtype=np.uint8)
    out[:, low:] = p.T
    return out.view(kind)[:, 0]


def _pack(row: np.ndarray, ids: np.ndarray, keys: np.ndarray, **columns) -> bytes:
    """Columns of one bucket, sorted by row; each row's id and key are stored once."""
    order = np.argsort(row, kind="stable")
    rows, counts = np.unique(row, return_counts=True)
    return pickle.dumps((ids[rows], keys[rows], counts.astype(np.uint32), {k: _planes(v[order], 2 if k in "hr" else 0) for k, v in columns.items()}), 5)


def _unpack(payloads, kinds: dict) -> dict[str, np.ndarray]:
    parts = [pickle.loads(p) for p in payloads]
    out = {"id": np.concatenate([np.repeat(p[0], p[2]) for p in parts]), "key": np.concatenate([np.repeat(p[1], p[2]) for p in parts])}
    for k, kind in kinds.items():
        out[k] = np.concatenate([_unplane(p[3][k], kind, 2 if k in "hr" else 0) for p in parts])
    return out


_REGION = {"h": np.uint64, "r": np.uint64, "a": np.uint32, "n": np.uint8, "o": np.uint8}
_SPAN = {"a": np.uint32, "n": np.uint8}
_ASK = {"h": np.uint64, "a": np.uint32, "n": np.uint8, "o": np.uint8}


def regions(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, region hash, start, size, anchor's place) of the regions of all rows in one byte array."""
    width = length - GRAM + 1
    n = len(data)
    none = (np.zeros(0, np.int64),) * 6
    if n < length:
        return none
    prefix = Prefix(data)
    h = mix((prefix.sums[GRAM:] - prefix.sums[: n - GRAM + 1]) * prefix.inverse[: n - GRAM + 1])
    low, at, span = h.copy(), np.arange(len(h), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        less = low[step:] < low[: len(low) - step]
        at = np.where(less, at[step:], at[: len(at) - step])
        low = np.where(less, low[step:], low[: len(low) - step])
        span += step
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + length <= offsets[row + 1])
    if not len(start):
        return none
    p = at[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    a, b, p = start[first], start[last] + length, p[first]
    r = mix(prefix(a, b) + (b - a).astype(np.uint64))
    row = row[a]
    return row, h[p], r, a - offsets[row], b - a, p - a


def _emit(bucket: np.ndarray, kind: int, row, ids, keys, **columns) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)) if len(order) else []
    for x, y in zip(edges, edges[1:]):
        part = order[x:y]
        yield int(bucket[part[0]]), kind, _pack(row[part], ids, keys, **{k: v[part] for k, v in columns.items()})


def _home(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of an id: the same as home_of."""
    high = (ids.view(np.uint64) >> np.uint64(33)).view(np.int64)
    return (ids ^ high) % (buckets | 1)


def home_of(ids: Column, buckets: int) -> Column:
    """Bucket of an id (null as the least integer); the number of buckets is odd, so strides of ids spread."""
    ids = F.coalesce(ids, F.lit(int(_NULL)))
    return F.pmod(ids.bitwiseXOR(F.shiftrightunsigned(ids, 33)), F.lit(buckets | 1))


def _anchor_home(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of an anchor; its low 16 bits don't travel."""
    return ((h >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


_SCHEMA = "bucket long, kind int, payload binary"


def _batch(rows: list) -> pa.RecordBatch:
    b, k, p = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], names=["bucket", "kind", "payload"])


def _find_regions(length: int, buckets: int):
    """Regions by bucket of their anchor; those that a smaller document of the same task covers are done (kind 1)."""

    def send(held: list) -> pa.RecordBatch:
        row, h, r, a, n, o, ids, keys = (np.concatenate(x) for x in zip(*held))
        covered, _, _ = _covered(h, r, ids[row])
        out = list(_emit(_home(ids, buckets)[row[covered]], 1, row[covered], ids, keys, a=a[covered], n=n[covered]))
        rest = ~covered
        out += _emit(_anchor_home(h[rest], buckets), 0, row[rest], ids, keys, h=h[rest], r=r[rest], a=a[rest], n=n[rest], o=o[rest])
        return _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, count = [], 0, 0
        for batch in batches:
            ids = batch.column("doc_id").fill_null(int(_NULL)).to_numpy()
            keys = batch.column("key").to_numpy()
            for i, j, data, offsets in chunks(batch.column("text")):
                row, h, r, a, n, o = regions(data, offsets, length)
                if not len(row):
                    continue
                held.append((row + rows, h, r, a.astype(np.uint32), n.astype(np.uint8), o.astype(np.uint8), ids[i:j], keys[i:j]))
                rows, count = rows + j - i, count + len(row)
                if count > _HELD:
                    yield send(held)
                    held, rows, count = [], 0, 0
        if held:
            yield send(held)
        release()

    return run


def _covered(h: np.ndarray, r: np.ndarray, ids: np.ndarray, hot: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which regions occur in a smaller document, which of the others share their anchor with other regions, and whose anchor is hot."""
    order = np.lexsort((ids, r, h))
    h, r, ids = h[order], r[order], ids[order]
    new_h = np.diff(h, prepend=~h[:1]) != 0
    new = new_h | (np.diff(r, prepend=~r[:1]) != 0)
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    covered = ids > ids[first][group]
    anchor = np.cumsum(new_h) - 1
    kinds = np.bincount(anchor[first], minlength=anchor[-1] + 1 if len(anchor) else 0)
    starts = np.flatnonzero(new_h)
    apart = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts) if len(starts) else np.zeros(0, bool)
    ask = ~covered & ((kinds > 1) & apart)[anchor]
    back = np.zeros((3, len(order)), bool)
    back[:, order] = covered, ask, (kinds > hot)[anchor]
    return back[0], back[1], back[2]


def _rows_of(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of (id, key) pairs, and the ids and keys of the rows."""
    both = np.empty(len(ids), dtype=[("i", np.int64), ("k", np.int64)])
    both["i"], both["k"] = ids, keys
    rows, row = np.unique(both, return_inverse=True)
    return row, rows["i"].copy(), rows["k"].copy()


def _match_regions(buckets: int, hot: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(int(b), 1, p) for b, k, p in zip(pdf["bucket"], pdf["kind"], pdf["payload"]) if k == 1]
        open_ = pdf.loc[pdf["kind"] == 0, "payload"]
        if len(open_):
            x = _unpack(open_, _REGION)
            covered, ask, many = _covered(x["h"], x["r"], x["id"], hot)
            for kind, mask, names in ((1, covered, _SPAN), (2, ask & ~many, _ASK), (4, ask & many, _ASK)):
                row, ids, keys = _rows_of(x["id"][mask], x["key"][mask])
                out += _emit(_home(ids, buckets)[row], kind, row, ids, keys, **{k: x[k][mask] for k in names})
        release()
        return pd.DataFrame(out, columns=["bucket", "kind", "payload"])

    return run


def _spans(x: dict[str, np.ndarray], texts: dict, length: int) -> tuple[list, list]:
    """Spans of STEP windows of hot regions: (those with the least id of equal ones, those that such a one covers).

    A window's place is counted back from its anchor, so equal windows lie in spans of the same number.
    """
    least: dict[tuple, int] = {}
    every = []
    for i, k, h, a, n, o in zip(*(x[c].tolist() for c in ("id", "key", "h", "a", "n", "o"))):
        text, last = texts[i, k], n - length
        for q in range((o - last) // STEP, o // STEP + 1):
            lo, hi = max(0, o - STEP * q - STEP + 1), min(last, o - STEP * q) + length
            same = (h, q, text[a + lo : a + hi])
            every.append((same, i, k, a + lo, o - lo))
            if i < least.setdefault(same, i):
                least[same] = i
    kept = [x for x in every if x[1] == least[x[0]]]
    return kept, [x for x in every if x[1] > least[x[0]]]


def _fetch(length: int, buckets: int):
    """Cut the asked regions out of the documents of a bucket, for the bucket of their anchor (or of their bytes, if it is hot)."""

    def send(x: dict[str, np.ndarray], cut: list[bytes], home: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        order = np.argsort(home, kind="stable")
        edges = np.flatnonzero(np.diff(home[order], prepend=-1, append=-1))
        for s, e in zip(edges, edges[1:]):
            part = order[s:e]
            yield int(home[part[0]]), 3, pickle.dumps({k: v[part] for k, v in x.items()} | {"bytes": b"".join([cut[p] for p in part])}, 5)

    def run(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if asked.empty:
            return pd.DataFrame({"bucket": [], "kind": [], "payload": []})
        texts = dict(zip(zip(docs["doc_id"].fillna(_NULL).astype("int64"), docs["key"]), docs["text"]))
        plain, hot = (asked.loc[asked["kind"] == kind, "payload"] for kind in (2, 4))
        out = []
        if len(plain):
            x = _unpack(plain, _ASK)
            cut = [texts[i, k][a : a + n] for i, k, a, n in zip(x["id"], x["key"], x["a"].tolist(), x["n"].tolist())]
            out += send(x, cut, _anchor_home(x["h"], buckets))
        if len(hot):
            kept, covered = _spans(_unpack(hot, _ASK), texts, length)
            if covered:
                row, ids, keys = _rows_of(np.array([x[1] for x in covered], np.int64), np.array([x[2] for x in covered], np.int64))
                a, n = np.array([x[3] for x in covered], np.uint32), np.array([len(x[0][2]) for x in covered], np.uint8)
                out += _emit(_home(ids, buckets)[row], 1, row, ids, keys, a=a, n=n)
            cut = [x[0][2] for x in kept]
            # the bytes that all windows of the span share
            shared = [zlib.crc32(c[x[4] - STEP * x[0][1] :][: length - STEP + 1], x[0][1]) for x, c in zip(kept, cut)]
            columns = {"id": (1, None, np.int64), "key": (2, None, np.int64), "h": (0, 0, np.uint64), "a": (3, None, np.uint32), "o": (4, None, np.uint8)}
            x = {name: np.array([r[c] if f is None else r[c][f] for r in kept], kind) for name, (c, f, kind) in columns.items()}
            x["n"] = np.array([len(c) for c in cut], np.uint8)
            out += send(x, cut, _anchor_home(mix(np.array(shared, np.uint64) ^ x["h"]), buckets))
        release()
        return pd.DataFrame(out, columns=["bucket", "kind", "payload"])

    return run


def suffix_sort(data: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int, prefix: Prefix | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mergesort of the suffixes at `starts` within each group, by at most `limit` bytes.

    Returns the order (groups in sequence) and the common extension of each suffix with the one before it in the
    order (0 at the start of a group). All merges of a level run side by side; every place is found by binary search.
    """
    prefix = prefix or Prefix(data)

    def extension(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) // 2
            same = prefix(a, a + mid) == prefix(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)

    def before(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix b sorts before suffix a (or, where `ties`, equals it)."""
        n = extension(a, b)
        end = n == limit
        at = np.minimum(n, limit - 1)
        return np.where(end, ties, data[b + at] < data[a + at])

    order = np.argsort(group, kind="stable")
    group = group[order]
    first = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if len(group) else 0))
    size = np.diff(np.append(first, len(group)))
    head, total = np.repeat(first, size), np.repeat(size, size)
    local = np.arange(len(group)) - head
    width = 1
    while len(size) and width < size.max():
        run = local // width
        other = np.where(run % 2 == 0, run + 1, run - 1)
        low = np.minimum(other * width, total)
        end = np.minimum(low + width, total)
        base, ties = low.copy(), run % 2 == 1
        live = np.flatnonzero(low < end)
        while len(live):
            mid = (low[live] + end[live]) // 2
            less = before(starts[order[live]], starts[order[head[live] + mid]], ties[live])
            low[live] = np.where(less, mid + 1, low[live])
            end[live] = np.where(less, end[live], mid)
            live = live[low[live] < end[live]]
        place = head + (local // (2 * width)) * 2 * width + (local - run * width) + (low - base)
        moved = np.empty_like(order)
        moved[place] = order
        order = moved
        width *= 2
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        inner = np.flatnonzero(group[1:] == group[:-1]) + 1
        common[inner] = extension(starts[order[inner]], starts[order[inner - 1]])
    return order, common


def _repeats(data: np.ndarray, starts: np.ndarray, group: np.ndarray, ids: np.ndarray, length: int, prefix: Prefix) -> np.ndarray:
    """Which suffixes agree to `length` bytes with one of a smaller id in their group."""
    order, common = suffix_sort(data, starts, group, length, prefix)
    same = common == length
    # collision check: neighbours with equal hashes are compared byte by byte
    here = np.flatnonzero(same)
    reach = np.arange(length)
    for s in range(0, len(here), 50_000):
        t = here[s : s + 50_000]
        a, b = starts[order[t]], starts[order[t - 1]]
        same[t] = (data[a[:, None] + reach] == data[b[:, None] + reach]).all(1)
    kind = np.cumsum(~same) - 1
    least = np.minimum.reduceat(ids[order], np.flatnonzero(~same))
    covered = np.zeros(len(starts), bool)
    covered[order] = ids[order] > least[kind]
    return covered


def _match_suffixes(length: int, buckets: int):
    """Compare the suffixes of fetched regions that lie at the same distance from the same anchor; others pass."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done = pdf["kind"] == 1
        out = [(int(b), 1, p) for b, p in zip(pdf.loc[done, "bucket"], pdf.loc[done, "payload"])]
        parts = [pickle.loads(p) for p in pdf.loc[~done, "payload"]]
        if not parts:
            return pd.DataFrame(out, columns=["bucket", "kind", "payload"])
        x = {k: np.concatenate([p[k] for p in parts]) for k in ("id", "key", "h", "a", "n", "o")}
        data = np.frombuffer(b"".join(p["bytes"] for p in parts), dtype=np.uint8)
        n = x["n"].astype(np.int64)
        at = np.cumsum(n) - n
        windows = n - length + 1
        of = np.repeat(np.arange(len(n)), windows)
        shift = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        place = shift - x["o"][of].astype(np.int64)
        anchor = np.unique(x["h"], return_inverse=True)[1]
        group = anchor[of] * 256 + place + 128
        by = np.argsort(group, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(group[by])) + 1, len(by))
        covered = np.zeros(len(of), bool)
        prefix, s = Prefix(data), 0
        while s < len(by):  # whole groups, some at a time
            e = int(ends[max(np.searchsorted(ends, s + _SORTED, side="right") - 1, np.searchsorted(ends, s, side="right"))])
            t = by[s:e]
            covered[t] = _repeats(data, at[of[t]] + shift[t], group[t], x["id"][of[t]], length, prefix)
            s = e
        hit = np.flatnonzero(covered)
        new = np.ones(len(hit), bool)
        new[1:] = (of[hit][1:] != of[hit][:-1]) | (shift[hit][1:] != shift[hit][:-1] + 1)
        f = np.flatnonzero(new)
        l = np.append(f[1:], len(hit)) - 1 if len(f) else f
        who, lo, hi = of[hit[f]], shift[hit[f]], shift[hit[l]] + length
        row, rid, rkey = _rows_of(x["id"][who], x["key"][who])
        out += _emit(_home(rid, buckets)[row], 1, row, rid, rkey, a=(x["a"][who] + lo).astype(np.uint32), n=(hi - lo).astype(np.uint8))
        release()
        return pd.DataFrame(out, columns=["bucket", "kind", "payload"])

    return run


def _cut(docs: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    by: dict[tuple, list] = {}
    if not spans.empty:
        x = _unpack(spans["payload"], _SPAN)
        order = np.lexsort((x["a"], x["key"], x["id"]))
        i, k, a = x["id"][order], x["key"][order], x["a"][order].astype(np.int64)
        e = a + x["n"][order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (k[1:] != k[:-1])
        # spans of one row merge where they touch: running maximum of ends, lifted by row so that rows don't mix
        lift = (np.cumsum(new) - 1) * (1 << 33)
        reach = np.maximum.accumulate(e + lift)
        start = new.copy()
        start[1:] |= (a + lift)[1:] > reach[:-1]
        f = np.flatnonzero(start)
        l = np.append(f[1:], len(i)) - 1
        for r, s, t in zip(f, a[f].tolist(), (reach[l] - lift[l]).tolist()):
            by.setdefault((int(i[r]), int(k[r])), []).append((s, t))
    ids, kept, found = docs["doc_id"].fillna(_NULL).astype("int64").tolist(), [], []
    for d, k, text in zip(ids, docs["key"].tolist(), docs["text"]):
        cuts = by.get((d, k), [])
        edges = [0, *(v for c in cuts for v in c), len(text)]
        kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if cuts else text)
        found.append([{"start": s, "stop": t} for s, t in cuts])
    release()
    return pd.DataFrame({"doc_id": docs["doc_id"], "n_bytes": [len(t) for t in docs["text"]], "spans": found, "kept": kept})


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50, bucket_bytes: int = 4_000_000, hot: int = 500) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, spans (maximal removed runs of bytes, start and stop), kept (binary).

    Texts count as UTF-8 bytes, null as none; matches never cross rows. Ids are integers; a null id counts as smaller
    than every other. Rows with one id are one document: they never remove bytes from each other. A text shorter
    than `length` is left whole. An empty table gives an empty result. `length` lies between 24 and 127.
    """
    if not GRAM + STEP <= length < 128:
        raise ValueError("length lies between 24 and 127")
    t = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("key"), t.alias("text"))
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets = max(32, -(-total // bucket_bytes))
    found = base.mapInArrow(_find_regions(length, buckets), _SCHEMA)
    # a group is a bucket of anchors, or (below 0) what is already done
    group = F.when(F.col("kind") == 0, F.col("bucket")).otherwise(-1 - F.col("bucket"))
    matched = settle(found.groupBy(group.alias("group")).applyInPandas(_match_regions(buckets, hot), _SCHEMA), "regions", free=True)
    homes = base.select(home_of(F.col("doc_id"), buckets).alias("bucket"), "doc_id", "key", "text")
    asked, spans = matched.where("kind <> 1"), matched.where("kind = 1")
    fetched = homes.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(_fetch(length, buckets), _SCHEMA)
    more = fetched.groupBy("bucket").applyInPandas(_match_suffixes(length, buckets), _SCHEMA)
    # one plan, so that Spark deals the documents to their buckets once for both uses
    return homes.groupBy("bucket").cogroup(spans.unionByName(more).groupBy("bucket")).applyInPandas(
        _cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
    )
