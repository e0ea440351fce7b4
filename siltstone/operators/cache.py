"""Eviction of a cache by recency and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import running_sum


def trim(entries: DataFrame, size: str, order: list[Column]) -> DataFrame:
    """Entries to drop from a cache of chunks, which keeps the newest up to twice the size of its largest."""
    largest = entries.agg(F.max(size)).first()[0]
    return evict(entries, 2 * largest, size, order) if largest else entries.limit(0)


def evict(entries: DataFrame, limit: float, size: str, order: list[Column]) -> DataFrame:
    """Entries to drop: by ``order`` (newest first), those before which the sizes already reach ``limit``.

    The entry that crosses the limit stays, so at least one does. A limit of 0 is an error."""
    if limit <= 0:
        raise ValueError("the cache needs a size above zero")
    return running_sum(entries, size, order, "__before").where(F.col("__before") >= limit).drop("__before")
