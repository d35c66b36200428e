"""Operator 4: exact dedup through an extendible-hash index on shared files, in built-in functions only.

1. The directory: every distinct 64-bit key is counted by the prefixes of its bits. A bucket with more than `capacity`
   keys is split by one more bit, which doubles the directory there, until it fits; only overfull prefixes are counted
   again, so the depth has no bound but the key's. Keys are hashes, so the buckets stay near each other in size.
2. Entries (id, key, normalised text) are routed through the directory to their bucket. The owner of a bucket and a
   range of keys chains the texts of one key: copies are told by their bytes, different texts under one key make links
   of their own. The copies that one task reads become one entry before they move, so a text that a third of all rows
   hold arrives as one row a task. The chains are the index: files sorted by bucket and key in the shared folder.
3. Every entry looks its chain up in the files by bucket, key and SHA-256 (a join that Spark may split where a key is hot).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, shared_path

#: Bits by which overfull prefixes are counted further in one pass, and buckets that the directory has at most, about.
_STEP, _BUCKETS = 12, 1 << 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone take the quick way."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """Buckets (depth, prefix) of an extendible-hash directory over distinct keys.

    In each pass the counts of the longest prefixes are folded to every shorter one; a bucket is a prefix that fits
    while its parent does not. A prefix of all 64 bits is one key and always fits.
    """
    found, over, depth = [], None, 0
    while True:
        deep = min(depth + _STEP, 64)
        # overfull prefixes are at most keys / capacity
        inside = keys if over is None else keys.join(F.broadcast(over), _prefix(F.col("key"), depth) == F.col("over"), "left_semi")
        finest = inside.groupBy(_prefix(F.col("key"), deep).alias("p")).agg(F.count("*").alias("n"))
        shorter = finest.select(F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("depth"), "p", "n")
        counts = shorter.groupBy("depth", F.expr(f"shiftrightunsigned(p, {deep} - depth)").alias("prefix")).agg(F.sum("n").alias("n"))
        counts = settle(counts, "directory")
        full = F.col("n") > capacity
        below = counts.where(full & (F.col("depth") < deep)).select(
            (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")
        )
        split = counts.join(below, ["depth", "prefix"], "left_semi")
        if over is None:
            split = counts.where("depth = 0").unionByName(split)
        found.append(split.where(~full if deep < 64 else (~full | (F.col("depth") == 64))).select("depth", "prefix"))
        over = counts.where(full & (F.col("depth") == deep)).select(F.col("prefix").alias("over"))
        depth = deep
        if depth == 64 or over.isEmpty():
            return reduce(DataFrame.unionByName, found)


def route(entries: DataFrame, buckets: DataFrame) -> DataFrame:
    """`entries` with the bucket of their key, by one lookup for each depth that the directory has (a few, as keys are hashes)."""
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())
    for d in depths:
        level = buckets.where(F.col("depth") == d).select(F.col("prefix").alias("_p"), F.concat(F.lit(f"{d}/"), F.col("prefix").cast("string")).alias(f"_b{d}"))
        entries = entries.join(F.broadcast(level), _prefix(F.col("key"), d) == F.col("_p"), "left").drop("_p")
    bucket = F.coalesce(*[F.col(f"_b{d}") for d in depths]) if depths else F.lit("0/0")
    return entries.withColumn("bucket", bucket).drop(*[f"_b{d}" for d in depths])


def dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, key_bits: int = 64, capacity: int = 100_000,
) -> DataFrame:
    """One row per row of `docs`: doc_id, `keep` columns, keep_id, group_size, kept, text_sha256, bucket.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id stays; null text counts as
    empty, a null id is smaller than every other, and rows that repeat the staying id are all marked kept. Other
    columns do not take part. An empty table gives an empty result. `key_bits` under 64 forces collisions (tests).
    A bucket holds `capacity` keys, or more where the directory would outgrow what may be broadcast (65,536 buckets).
    """
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    hashed = F.shiftleft(F.xxhash64(norm), 64 - key_bits) if key_bits < 64 else F.xxhash64(norm)
    keys = settle(docs.select(hashed.alias("key")).distinct(), "keys")
    buckets = settle(directory(keys, max(capacity, keys.count() // _BUCKETS)), "buckets")
    named = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep or [])]
    entries = route(docs.select(F.col(doc_id).alias("doc_id"), *named, norm.alias("norm"), hashed.alias("key")), buckets)
    chains = entries.groupBy("bucket", "key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("sha")
    chains = settle(chains.select("bucket", "key", sha, "keep_id", "group_size"), "chains", free=True)
    path = shared_path(docs.sparkSession, "index")
    chains.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key").write.parquet(path)
    index = docs.sparkSession.read.schema(chains.schema).parquet(path)
    index = index.select(F.col("bucket").alias("_bucket"), F.col("key").alias("_key"), F.col("sha").alias("_sha"), "keep_id", "group_size")
    asked = entries.withColumn("sha", sha).drop("norm")
    found = asked.join(index, (F.col("bucket") == F.col("_bucket")) & (F.col("key") == F.col("_key")) & (F.col("sha") == F.col("_sha")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    named = [F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep or [])]
    return found.select("doc_id", *named, "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), "bucket")
