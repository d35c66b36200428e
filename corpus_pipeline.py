"""A training-data pipeline over `documents`: quality rules, exact and near dedup, mixing, then tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of `documents`; the last one
returns a digest for each document of the mix (a document that is taken twice has two rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifa.llm import exact_dedup, jaccard_join, mixing, quality_rules
from tarifa.llm.common import settle, table
from tarifa.llm.queries import tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A verdict depends on text and language alone, so thin verdicts meet the documents again by id and hash."""
    hashed = docs.select("*", F.xxhash64("text", "lang").alias("_hash"))
    judged = quality_rules.judge(hashed, ["doc_id", "_hash"]).where("kept").select(F.col("doc_id").alias("k_id"), F.col("_hash").alias("k_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("_hash") == F.col("k_hash"))
    return hashed.join(judged, same, "left_semi").select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs, keep=COLUMNS[1:]).where("kept").select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the least id (and text hash) stays."""
    hashed = docs.select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    kept = jaccard_join.join(docs, stays=True).where("stays").select(F.col("doc_id").alias("k_id"), F.col("key").alias("k_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("_hash") == F.col("k_hash"))
    return hashed.join(kept, same, "left_semi").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    taken = mixing.mix(docs, keep=COLUMNS[1:])
    return taken.select("*", F.explode(F.array_repeat(F.lit(1), F.col("mix.copies").cast("int")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens(spark, docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("byte-level BPE", encode)]

#: SQL has no form for the near-duplicate join and the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
