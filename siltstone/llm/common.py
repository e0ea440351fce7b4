"""Helpers shared by the training-data operators: word counting, row numbers and the held-out fold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import free, materialize, scope

__all__ = ["WORD", "free", "is_held_out", "materialize", "numbered", "root_buckets", "scope", "table", "word_count"]

#: A word is a maximal run of anything but space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def root_buckets(n: int) -> int:
    """About the square root of ``n``: buckets and rows in each bucket grow alike."""
    return max(1, math.isqrt(max(0, n - 1)) + 1)


def numbered(df: DataFrame, group: list[str], order: list[Column], rows: int, out: str) -> DataFrame:
    """Number rows 0, 1, ... within each group, without gathering a group in one task.

    Rows are salted into about sqrt(rows) buckets; counts by (group, bucket) become offsets, and
    only rows of one bucket are sorted together. ``df`` holds ``__salt``, a long hash of the row.
    """
    n = root_buckets(rows)
    df = df.withColumn("__b", F.pmod(F.col("__salt"), F.lit(n)))
    keys = [*group, "__b"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.join(counts, keys).withColumn(out, F.col("__off") + F.row_number().over(own) - 1).drop("__b", "__off", "__salt")


def is_held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the held-out fold: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
