"""Sinks of streams that a repeated batch leaves as they are (SNK-01, SNK-02, SNK-04, SNK-05).

A stream that ends between writing a batch and noting its end delivers that batch again, under the same number. Each
batch therefore has a folder of its own, written whole in place of whatever an earlier try left there: the same batch
twice leaves one copy, and readers see a column `batch`. For a table that is updated in place the newest batch of a
key counts when it is read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def batch_files(path: str, kind: str = "parquet", **options: str) -> Callable[[DataFrame, int], None]:
    """For `writeStream.foreachBatch`: every batch into `path`/batch=<number>, replacing an earlier try; an empty one leaves no rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.format(kind).options(**options).mode("overwrite").save(f"{path.rstrip('/')}/batch={number}")

    return write


def csv_files(path: str, cells: Sequence[Column], names: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """SNK-01: the same for CSV lines with a header; a cell with a comma, quote or line break is quoted, null is empty."""
    write = batch_files(path, "csv", header="true", escape='"', emptyValue="", nullValue="", lineSep="\n")
    return lambda batch, number: write(batch.select(*[c.cast("string").alias(n) for c, n in zip(cells, names)]), number)


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows that batches left, with their batch."""
    return spark.read.schema(StructType(list(schema.fields)).add("batch", "long")).parquet(path)


def current(rows: DataFrame, keys: Sequence[str], deleted: str | None = None) -> DataFrame:
    """SNK-05: of each key the row of the newest batch (a maximum with a map side), without keys whose newest row is `deleted`.

    Null keys are a key of their own. Within a batch a key must have one row.
    """
    rest = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out
