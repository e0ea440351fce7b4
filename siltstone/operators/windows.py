"""Ordered computations over whole tables without gathering them in one task.

Rows are dealt to ranges of their order by Spark's range partitioner and written; sums and last rows by
range give each range what came before it, and only rows of one range are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

#: Rows of a range, about, and the most ranges.
RANGE_ROWS, RANGES = 200_000, 100_000


def with_range(df: DataFrame, order: list[Column], rows: int | None = None) -> DataFrame:
    """Add ``__r``: the number of a row's range; ranges rise as ``order`` does (which must be total)."""
    n = df.count()
    parts = min(RANGES, max(1, -(-n // (rows or RANGE_ROWS))))
    return materialize(df.repartitionByRange(parts, *order).withColumn("__r", F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, value: str, order: list[Column], out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before a row (0 for the first)."""
    ranged = with_range(df, order)
    sums = ranged.groupBy("__r").agg(F.sum(value).alias("__s"))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sums = sums.select("__r", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__off"))
    own = Window.partitionBy("__r").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(sums), "__r")  # at most RANGES rows
    return joined.withColumn(out, F.col("__off") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("__r", "__off")


def previous(df: DataFrame, value: str, order: list[Column], out: str) -> DataFrame:
    """Add the value of the row before (null for the first). ``order`` are plain columns, rising."""
    ranged = with_range(df, order)
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    last = ranged.groupBy("__r").agg(F.max_by(F.struct(F.col(value).alias("v")), place).alias("__last"))
    last = last.select("__r", F.lag("__last").over(Window.orderBy("__r")).alias("__last"))  # one row per range
    own = Window.partitionBy("__r").orderBy(*order)
    joined = ranged.join(F.broadcast(last), "__r")  # at most RANGES rows
    prior = F.lag(F.struct(F.col(value).alias("v"))).over(own)
    return joined.withColumn(out, F.coalesce(prior, F.col("__last"))["v"]).drop("__r", "__last")
