"""Deduplication of blobs: new ones against stored ones, and who introduced what.

Nothing here sorts or gathers the rows of one blob: first occurrences come from partial aggregates
(least struct), so a blob that holds a third of all references does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_blobs(refs: DataFrame, blob: str, first: str, *carried: str) -> DataFrame:
    """One row per blob: the least ``first`` value, the number of references, and columns that the blob determines."""
    return refs.groupBy(blob).agg(F.min(first).alias(f"first_{first}"), F.count(F.lit(1)).alias("copies"), *[F.max(c).alias(c) for c in carried])


def new_blobs(blobs: DataFrame, stored: DataFrame, blob: str = "blob_id") -> DataFrame:
    """Incoming blobs that are not stored, each once."""
    return blobs.dropDuplicates([blob]).join(stored.select(blob).distinct(), blob, "left_anti")


def introduced(refs: DataFrame, blob: str, length: str, order: list[Column], keys: list[str]) -> DataFrame:
    """Bytes introduced and reused by ``keys``: a reference introduces its blob if no earlier one, by
    ``order`` (total together with the keys), has it; every other reference, in the same group too, reuses it.

    ``introduced`` sums the first references' lengths in their own groups; ``reused`` is the rest.
    """
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(k).alias(f"k_{k}") for k in keys])
    first = refs.groupBy(blob).agg(F.min(place).alias("p"), F.max(length).alias("__len"))
    new = first.select(*[F.col(f"p.k_{k}").alias(k) for k in keys], F.col("__len").alias("__new"), F.lit(0).cast("long").alias("__all"))
    every = refs.groupBy(*keys).agg(F.sum(length).alias("__all")).select(*keys, F.lit(0).cast("long").alias("__new"), "__all")
    both = new.unionByName(every).groupBy(*keys).agg(F.sum("__new").alias("introduced"), F.sum("__all").alias("total"))
    return both.select(*keys, F.col("introduced").cast("long").alias("introduced"), (F.col("total") - F.col("introduced")).cast("long").alias("reused"))


def uniqueness_violations(manifest: DataFrame, blob: str = "blob_id", pack: str = "pack_id") -> DataFrame:
    """Blobs that more than one manifest entry holds."""
    found = manifest.groupBy(blob).agg(F.count(F.lit(1)).alias("entries"), F.min(pack).alias("first_pack"), F.max(pack).alias("last_pack"))
    return found.where("entries > 1")


def blob_map(manifest: DataFrame, *values: str, blob: str = "blob_id", pack: str = "pack_id") -> DataFrame:
    """Blob to pack and further values; a blob of several packs counts for the least."""
    return manifest.groupBy(blob).agg(F.min(F.struct(pack, *values)).alias("m")).select(blob, "m.*")
