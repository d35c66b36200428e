"""Operator 12: benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of `size` consecutive words (a shorter item is one window). A window is a set of
shingles (runs of `width` words, each with its place in the window), ordered by how rare they are in the documents. A
document that holds a window holds all its shingles, so one of them is prefix enough: the rarest. Steps:

1. Windows and shingles of all items; equal windows of several items are one.
2. Documents are read once to count the benchmark's shingles in them; windows with a shingle that no document holds
   can't occur and go.
3. Documents are read again; every place of a prefix shingle is a candidate with the words around it.
4. Candidates join windows on the shingle. The window's start follows from the shingle's place in it: it must not lie
   before the text (positional bound) and the text must have all its words (length bound). The words are then compared.

Tasks look shingles up in a bitmap of fixed size before rows are made, so what is sent to them does not grow with the
benchmark; the join tells false hits apart. Windows are broadcast only when their measured size is below `broadcast`
bytes; beyond it the join shuffles. Nothing is sampled or capped.

Defined results: a null or empty text has no words and isn't contaminated; an item without words is ignored; a null
item id counts as the empty string and rows with one id are one item; repeated documents are rows of their own; empty
tables give no rows, or documents without hits. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesets import Prefix, mix
from .common import settle

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IN_WORD = np.array([c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])
_FACTOR = np.uint64(0xD1342543DE82EF95)
_BLOCK, _BIG = 1 << 20, 1 << 16
#: Bits of the bitmap that tasks look shingles up in, as a power of two (4 MB).
_BITS = 25


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of lower-cased bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IN_WORD[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, a block of about a megabyte at a time; very long words are hashed on their own."""
    out, a = np.zeros(len(starts), np.uint64), 0
    big = np.flatnonzero(ends - starts > _BIG)
    for stop in [*big.tolist(), len(starts)]:
        while a < stop:
            b = min(stop, max(a + 1, int(np.searchsorted(ends, starts[a] + _BLOCK))))
            prefix = Prefix(data[starts[a] : ends[b - 1]])
            out[a:b] = mix(prefix(starts[a:b] - starts[a], ends[a:b] - starts[a]) + (ends[a:b] - starts[a:b]).astype(np.uint64))
            a = b
        if stop < len(starts):
            out[stop] = xxhash.xxh64_intdigest(data[starts[stop] : ends[stop]].tobytes())
            a = stop + 1
    return out


def shingle_keys(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` words (as a signed long); there are width - 1 fewer than words."""
    n = len(hashes) - width + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(width):
        out = out * _FACTOR + hashes[k : k + len(out)]
    return mix(out + np.uint64(width)).view(np.int64)


class Words:
    """The words of a run of texts: rows, places and hashes."""

    def __init__(self, texts: Sequence[bytes]):
        self.raw = b" ".join(texts).translate(_LOWER)  # the blank parts texts
        data = np.frombuffer(self.raw, np.uint8)
        self.starts, self.ends = spans(data)
        self.hashes = word_hashes(data, self.starts, self.ends)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, begin)  # each text's first word; the last is the number of all
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, first word) of the runs of `width` words that lie in one text."""
        keys = shingle_keys(self.hashes, width)
        at = np.flatnonzero(self.row[: len(keys)] == self.row[width - 1 :]) if len(keys) else np.zeros(0, np.int64)
        return keys[at], at

    def text(self, a: int, b: int) -> str:
        return " ".join([self.raw[s:e].decode("utf-8", "replace") for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())])


def blocks(column: pd.Series, size: int = 700_000) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, words) of runs of rows with about `size` bytes; null counts as empty."""
    texts = [bytes(t) if t is not None else b"" for t in column]
    a = 0
    while a < len(texts):
        b, held = a, 0
        while b < len(texts) and (b == a or held + len(texts[b]) <= size):
            held += len(texts[b])
            b += 1
        yield a, b, Words(texts[a:b])
        a = b


def windows_of(items: DataFrame, size: int, width: int) -> DataFrame:
    """(item, words, size, place, key): every shingle of every window of every item, once for each item."""
    picked = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, w in blocks(batch["text"]):
                out = []
                for k in range(b - a):
                    first, last = w.first[k], w.first[k + 1]
                    long = min(size, last - first)
                    short = min(width, long)
                    keys = shingle_keys(w.hashes[first:last], short) if long else []
                    for i in range(last - first - long + 1) if long else ():
                        text = w.text(first + i, first + i + long)
                        out += [(batch["item"].iloc[a + k], text, long, p, keys[i + p]) for p in range(long - short + 1)]
                        if len(out) > 50_000:
                            yield pd.DataFrame(out, columns=["item", "words", "size", "place", "key"])
                            out = []
                yield pd.DataFrame(out, columns=["item", "words", "size", "place", "key"]).astype({"size": "int32", "place": "int32", "key": "int64"})

    return picked.mapInPandas(run, "item string, words string, size int, place int, key long")


def bitmap(keys: DataFrame) -> bytes:
    """Which of the 2^_BITS slots hold a key: at most 2^(_BITS - 15) rows of 4 KB come to the driver."""
    slot = F.shiftrightunsigned("key", 64 - _BITS) + 1  # the functions count from 1
    parts = keys.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = bytearray(1 << (_BITS - 3))
    for r in parts:
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = r["bits"]
    return bytes(out)


def _within(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.view(np.uint64) >> np.uint64(64 - _BITS)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def shingle_counts(docs: DataFrame, widths: Sequence[int], held: bytes) -> DataFrame:
    """(key, n): how often the documents hold the shingles in the bitmap; every task folds its own first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(held, np.uint8)
        for batch in batches:
            for _, _, w in blocks(batch["text"]):
                found = [keys[_within(bits, keys)] for keys, _ in map(w.shingles, widths)]
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"key": key, "n": n})

    texts = docs.select(F.col("text").cast("binary").alias("text"))
    return texts.mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


_CANDIDATE = {"at": "Int64", "key": "Int64", "first": "Int64"}


def candidates(docs: DataFrame, widths: Sequence[int], held: bytes, size: int) -> DataFrame:
    """Two kinds of rows: (row, doc_id, n_words) of every document and (row, n_words, at, key, first, around) of places of shingles in the bitmap.

    `around` is the words from number `first` on that a window over the shingle can hold.
    """
    picked = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, row = np.frombuffer(held, np.uint8), TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, w in blocks(batch["text"]):
                counts = np.diff(w.first)
                yield pd.DataFrame({"row": row + np.arange(b - a), "doc_id": batch["doc_id"].iloc[a:b].array, "n_words": counts, "at": None, "key": None, "first": None, "around": None}).astype(_CANDIDATE)
                for keys, at in map(w.shingles, widths):
                    hit = np.flatnonzero(_within(bits, keys))
                    for i in range(0, len(hit), 20_000):
                        at_, keys_ = at[hit[i : i + 20_000]], keys[hit[i : i + 20_000]]
                        k = w.row[at_]
                        low, high = np.maximum(w.first[k], at_ - size + 1), np.minimum(w.first[k + 1], at_ + size)
                        yield pd.DataFrame({
                            "row": row + k, "doc_id": None, "n_words": counts[k], "at": at_ - w.first[k], "key": keys_, "first": low - w.first[k],
                            "around": [w.text(x, y) for x, y in zip(low.tolist(), high.tolist())],
                        }).astype(_CANDIDATE)
                row += b - a

    found = picked.mapInPandas(run, "row long, doc_id string, n_words long, at long, key long, first long, around string")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def matches(found: DataFrame, prefixes: DataFrame, broadcast: int) -> DataFrame:
    """(row, start, size, window) of all windows in documents, from candidates and windows by their rarest shingle."""
    held = prefixes.agg(F.sum(F.length("words") * 4 + 100)).first()[0] or 0
    side = F.broadcast(prefixes) if held <= broadcast else prefixes
    j = found.where("at IS NOT NULL").drop("doc_id").join(side, "key").withColumn("start", F.col("at") - F.col("place"))
    bounded = j.where("start >= 0 AND start + size <= n_words")
    same = F.slice(F.split("around", " "), (F.col("start") - F.col("first") + 1).cast("int"), F.col("size")) == F.split("words", " ")
    return bounded.where(same).select("row", "start", "size", "window")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, width: int = 5, broadcast: int = 32 << 20) -> DataFrame:
    """doc_id, n_words, n_hit (words within an occurrence of a window), items (sorted ids whose windows occur), contaminated.

    `docs` has doc_id and text, `items` has item_id and text.
    """
    cut = settle(windows_of(items, size, width), "decontamination-windows")
    widths = sorted(r[0] for r in cut.select(F.least(F.col("size"), F.lit(width))).distinct().collect())  # at most `width` numbers
    parts = cut.select("words", "size", "place", "key").distinct()
    counts = shingle_counts(docs, widths or [width], bitmap(cut.select("key")))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "place")).alias("r")
    prefixes = parts.join(counts, "key", "left").groupBy("words", "size").agg(rarest).where("r.n > 0")
    prefixes = settle(prefixes.select("words", "size", "r.key", "r.place", F.monotonically_increasing_id().alias("window")), "decontamination-prefixes")

    found = settle(candidates(docs, widths or [width], bitmap(prefixes.select("key")), size), "decontamination-candidates")
    hits = settle(matches(found, prefixes, broadcast), "decontamination-matches")

    # words covered: each window adds what lies beyond the furthest end before it
    by_start = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest("start", F.coalesce(F.max(F.col("start") + F.col("size")).over(by_start), F.lit(0)))
    covered = hits.select("row", F.greatest(F.col("start") + F.col("size") - seen, F.lit(0)).alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    holders = cut.where("place = 0").select("item", "words").distinct().join(prefixes.select("words", "window"), "words").select("item", "window")
    listed = hits.select("row", "window").distinct().join(holders, "window").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))

    every = found.where("at IS NULL").select("row", "doc_id", "n_words")
    none = F.array().cast("array<string>")
    return every.join(covered, "row", "left").join(listed, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated")
    )
