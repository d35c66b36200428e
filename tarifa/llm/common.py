"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's white space; a word is a run of other characters.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """Bind `value` once and use it many times in `body` (a lambda argument is never evaluated again).

    An aggregate over nothing, whose finish is `body`: the first element of a transform would do as well, but that
    derives the type of its whole body for every value.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def words(text: Column) -> Column:
    """Runs of characters other than the contract's white space; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which every machine of a cluster can read; only a local master does without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):  # tests and single machines
        base = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage and survives lost executors.

    With `free` Spark deletes the shuffle files of this write at its end; otherwise they lie beside the next plan's until
    the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    if free:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
