"""Operator 11: target-distribution importance resampling over hashed word features.

Words come from the `tokenizers` library's Split pre-tokeniser: an untrained pattern over the text with A-Z lowered,
which returns every word with its offsets. Each character of what it is given stands for one byte of the text, so that
offsets count bytes and a text need not be valid UTF-8. Windows over the offset pairs are the features (a word; two
words joined by a space), hashed by CRC-32 into buckets. The corpus and the target are summed into bucket histograms,
their ratio gives each bucket a gain, and a document's weight is the mean gain of its features. Gumbel noise from a
hash of the id turns the top scores into a draw without replacement.

Texts are read once: the buckets of every document (two bytes a feature) are settled; histograms and weights read those.
Only the gains, as many as there are buckets, pass through the driver.

Defined results: a null or empty text has no words, weight 0 and no rank; a null id hashes as the empty string and comes
last among equal scores; repeated rows are rows of their own (among equal ids and scores by their place in the input's
files); empty tables give no rows, an empty target makes all gains come from the corpus alone. Only the named columns
are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import settle

#: A word: ASCII letters and digits (lower case by then) and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IN_WORD = np.array([c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])
_PIECE = 1 << 20
_LONG = 64


def _crc_table() -> np.ndarray:
    """The table of the reflected polynomial that zlib's CRC-32 uses."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc32_from(before: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[start:end] appended to what had the CRC-32 `before` (0 for nothing)."""
    out = ~before.astype(np.uint32)
    size = ends - starts
    for k in np.flatnonzero(size > _LONG):  # rare, and a loop over their bytes would run for all
        out[k] = ~np.uint32(zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(before[k])))
    short = np.flatnonzero(size <= _LONG)
    short = short[np.argsort(-size[short], kind="stable")]
    longest_first = -size[short]
    for k in range(int(size[short].max(initial=0))):
        at = short[: np.searchsorted(longest_first, -k, side="left")]  # those with more than k bytes
        state = out[at]
        out[at] = _CRC[(state ^ data[starts[at] + k]) & np.uint32(255)] ^ (state >> np.uint32(8))
    return ~out


def pieces(data: bytes, size: int = _PIECE) -> Iterator[bytes]:
    """`data` in runs of about `size` bytes that end between words."""
    codes, a = np.frombuffer(data, dtype=np.uint8), 0
    while a < len(data):
        b = min(a + size, len(data))
        while b < len(data) and _IN_WORD[codes[b]]:
            b += 1
        yield data[a:b]
        a = b


class Features:
    """Buckets of all runs of 1 to `most` consecutive words of a text."""

    def __init__(self, buckets: int, most: int):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(WORD), behavior="removed", invert=True)
        self.buckets, self.most = buckets, most

    def __call__(self, text: bytes) -> tuple[int, np.ndarray]:
        """(number of words, bucket of every feature)."""
        words, found = 0, []
        tail: list[bytes] = []  # the last words of the piece before, which windows may begin with
        for piece in pieces(text.translate(_LOWER)):
            offsets = [o for _, o in self.split.pre_tokenize_str(piece.decode("latin-1"))]
            if not offsets:
                continue
            data = np.frombuffer(b" ".join([*tail, piece]), dtype=np.uint8)
            shift = sum(len(w) + 1 for w in tail)
            ends = np.cumsum([len(w) + 1 for w in tail]) - 1
            spans = np.concatenate([np.column_stack([ends - [len(w) for w in tail], ends]).reshape(-1, 2), np.array(offsets) + shift]).astype(np.int64)
            starts, stops = spans[:, 0], spans[:, 1]
            old, n = len(tail), len(spans)
            state = np.zeros(n, np.uint32)
            for k in range(self.most):  # windows of k + 1 words; those that end in the piece are new
                if n <= k:
                    break
                if k:
                    space = np.full(n - k, ord(" "), np.uint8)
                    at = np.arange(n - k)
                    state = crc32_from(state[: n - k], space, at, at + 1)
                state = crc32_from(state[: n - k], data, starts[k:], stops[k:])
                found.append((state[max(0, old - k) :] % np.uint32(self.buckets)).astype(np.uint32))
            words += n - old
            tail = [data[a:b].tobytes() for a, b in spans[max(0, n - self.most + 1) :]]
        return words, np.concatenate(found) if found else np.zeros(0, np.uint32)


def schema_with(df: DataFrame, **more: str) -> StructType:
    out = StructType(list(df.schema.fields))
    for name, kind in more.items():
        out.add(name, kind)
    return out


def extended(batch: pa.RecordBatch, without: str | None = None, **more: pa.Array) -> pa.RecordBatch:
    """A batch with more columns; the others pass as they are, so ids keep all digits beside nulls."""
    kept = {n: batch.column(n) for n in batch.schema.names if n != without}
    return pa.RecordBatch.from_pydict(kept | more)


def featured(texts: DataFrame, keep: Sequence[str], buckets: int, most: int) -> DataFrame:
    """`keep`, n_words, n_features and `codes` (the features' buckets, packed as `codes_type`) of every text."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    picked = texts.select(*keep, F.col("text").cast("binary").alias("_text"))
    out = schema_with(picked.drop("_text"), n_words="long", n_features="long", codes="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets, most)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):  # small blocks: a task holds the codes of one at a time
                block = batch.slice(a, 64)
                found = [features(t or b"") for t in block.column("_text").to_pylist()]
                yield extended(block, "_text", n_words=pa.array([w for w, _ in found], pa.int64()), n_features=pa.array([len(f) for _, f in found], pa.int64()), codes=pa.array([f.astype(kind).tobytes() for _, f in found], pa.binary()))

    return picked.mapInArrow(run, out)


def histogram(coded: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all features; every task sends at most as many rows as there are buckets."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for codes in batch["codes"]:
                total += np.bincount(np.frombuffer(codes, kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    return coded.select("codes").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of every bucket, from two histograms."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    out = np.zeros((2, buckets), np.int64)
    for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():  # at most `buckets` rows
        out[:, r["bucket"]] = r["s"], r["t"]
    (s, t), (all_s, all_t) = out.astype(float), out.sum(axis=1).astype(float)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weighed(coded: DataFrame, gain: np.ndarray) -> DataFrame:
    """`codes` replaced by `weight`, the floored mean gain."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32
    out = schema_with(coded.drop("codes"), weight="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.frombuffer(c, kind) for c in batch.column("codes").to_pylist()]
            yield extended(batch, "codes", weight=pa.array([int(gain[c].sum()) // len(c) if len(c) else 0 for c in codes], pa.int64()))

    return coded.mapInArrow(run, out)


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """1, 2, 3... in a strict order, without one task that sees all rows.

    Ranges of the order are sorted side by side and numbered from 1 each; the ranges' sizes, one row a range, then tell
    how many rows precede each.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = schema_with(rows, _range="long", _place="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.num_rows
            yield extended(batch, _range=pa.array(np.full(size, at, np.int64)), _place=pa.array(np.arange(done + 1, done + 1 + size, dtype=np.int64)))
            done += size

    placed = settle(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, out), name)
    sizes = sorted(placed.groupBy("_range").agg(F.max("_place")).collect())  # one row a range
    before = [(at, sum(size for _, size in sizes[:k])) for k, (at, _) in enumerate(sizes)]
    offsets = rows.sparkSession.createDataFrame(before, "_range long, _before long")
    return placed.join(F.broadcast(offsets), "_range").select(*rows.columns, (F.col("_place") + F.col("_before")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, keep: Sequence[str] = (), buckets: int = 10_000, most: int = 2, least_words: int = 20, share: int = 25, seed: str = "7") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank and `kept` (a struct of the columns `keep`) of every document.

    An undrawn document's rank is null.
    floor(share * N / 100) of the N documents with at least `least_words` words are drawn: those with the highest
    scores, ties to the smaller id. `docs` has doc_id and text, `target` has text.
    """
    names = [f"_keep{i}" for i in range(len(keep))]
    source = docs.select("doc_id", "text", *(F.col(c).alias(n) for c, n in zip(keep, names)), F.monotonically_increasing_id().alias("_row"))
    coded = settle(featured(source, ["doc_id", *names, "_row"], buckets, most), "importance-codes")
    aim = settle(featured(target, [], buckets, most), "importance-target")
    gain = gains(histogram(coded, buckets), histogram(aim, buckets), buckets)

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = settle(weighed(coded, gain).withColumn("score", F.col("weight") + noise), "importance-scores")

    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * share // 100
    places = ranked(scored.where(able), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")], "importance-ranks")
    places = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return places.unionByName(rest).select(
        "doc_id", "n_words", "n_features", "weight", "score", "rank", *([F.struct(*(F.col(n).alias(c) for c, n in zip(keep, names))).alias("kept")] if keep else [])
    )
