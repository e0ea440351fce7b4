"""Which entries count: skips, changed files, special files, object names and leading bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors


def skipped(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches anywhere in the path or in one of its ancestors (whose subtree is not entered)."""
    out = F.lit(False)
    for pattern in patterns:
        out = out | F.exists(ancestors(path), _matches(pattern))
    return out


def _matches(pattern: str):
    return lambda prefix: prefix.rlike(pattern)


def keep_unskipped(entries: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    return entries.where(~skipped(F.col(path), patterns))


def merge_skips(config: list[str], args: list[str]) -> list[str]:
    return sorted(set(config) | set(args))


def changed(kind: Column, mtime: Column, size: Column, old_kind: Column, old_mtime: Column, old_size: Column) -> Column:
    """Whether a file must be read: no file before, or another kind, modification time or size."""
    return old_kind.isNull() | ~(old_kind.eqNullSafe(kind) & old_mtime.eqNullSafe(mtime) & old_size.eqNullSafe(size))


def with_previous(now: DataFrame, before: DataFrame, key: str = "path", force_hash: bool = False) -> DataFrame:
    """Entries of a walk joined to those of the previous snapshot; adds ``changed`` and the old chunks."""
    old = before.select(
        F.col(key),
        F.col("kind").alias("old_kind"),
        F.col("mtime_ns").alias("old_mtime_ns"),
        F.col("size").alias("old_size"),
        F.col("chunks").alias("old_chunks"),
    )
    joined = now.join(old, key, "left")
    test = changed(F.col("kind"), F.col("mtime_ns"), F.col("size"), F.col("old_kind"), F.col("old_mtime_ns"), F.col("old_size"))
    return joined.withColumn("changed", F.lit(True) if force_hash else test)


def ordinary(entries: DataFrame) -> DataFrame:
    """Entries that are files, directories or links; sockets and devices have no kind."""
    return entries.where(F.col("kind").isNotNull())


def finished_objects(objects: DataFrame, name: str = "name") -> DataFrame:
    """Objects that are not temporaries of an unfinished write."""
    return objects.where(~F.col(name).endswith(".part"))


def has_magic(content: Column, magic: bytes) -> Column:
    return F.substring(content, 1, len(magic)) == F.lit(magic)


def introducing(sizes: DataFrame) -> DataFrame:
    """Files that add anything, largest first; ties in reverse path order."""
    return sizes.where("introduced > 0").orderBy(F.desc("introduced"), F.desc("parts"))
