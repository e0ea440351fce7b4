"""Comparing two hierarchies entry by entry.

Entries are rows (path or parts, kind, chunks, target, meta). Codes: ``+`` added, ``-`` removed, ``C``
contents changed, and for metadata O, P, T, A, M. A change of kind or of a link's target is a removal and an
addition. The rows below a removed or added directory follow from the join itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import metadata_code


def compare(left: DataFrame, right: DataFrame, keys: list[str], metadata: bool = False, contents: str = "chunks") -> DataFrame:
    """Rows (keys, code, kind, target) by which ``right`` differs from ``left``."""
    fields = ["kind", contents, "target", *(["meta"] if metadata else [])]
    a = left.select(*keys, F.struct(*fields).alias("a"))
    b = right.select(*keys, F.struct(*fields).alias("b"))
    joined = a.join(b, keys, "full_outer")
    same_kind = F.col("a.kind") == F.col("b.kind")
    replaced = ~same_kind | ((F.col("a.kind") == "symlink") & ~F.col("a.target").eqNullSafe(F.col("b.target")))
    meta = metadata_code(F.col("a.meta"), F.col("b.meta")) if metadata else F.lit(None).cast("string")
    edited = (F.col("a.kind") == "file") & ~F.col(f"a.{contents}").eqNullSafe(F.col(f"b.{contents}"))
    old = F.struct(F.lit("-").alias("code"), F.col("a.kind").alias("kind"), F.col("a.target").alias("target"))
    new = F.struct(F.lit("+").alias("code"), F.col("b.kind").alias("kind"), F.col("b.target").alias("target"))
    kept = F.struct(F.when(edited, "C").otherwise(meta).alias("code"), F.col("b.kind").alias("kind"), F.col("b.target").alias("target"))
    rows = F.when(F.col("b").isNull(), F.array(old)).when(F.col("a").isNull(), F.array(new)).when(replaced, F.array(old, new)).otherwise(F.array(kept))
    return joined.select(*keys, F.explode(rows).alias("r")).where("r.code is not null").select(*keys, "r.code", "r.kind", "r.target")


def report_order(parts: Column, code: Column, kind: Column) -> list[Column]:
    """Order of a report: by component, old before new, a directory's metadata after what it holds."""
    after = (kind == "directory") & ~code.isin("+", "-")
    return [F.when(after, F.concat(parts, F.array(F.lit("\U0010ffff")))).otherwise(parts), F.when(code == "-", 0).otherwise(1)]


def report(changes: DataFrame) -> DataFrame:
    """Lines of a comparison whose key is ``parts``."""
    path = F.array_join("parts", "/")
    text = F.concat(
        F.col("code"),
        F.lit(" "),
        path,
        F.when(F.col("kind") == "directory", "/").otherwise(""),
        F.when(F.col("kind") == "symlink", F.concat(F.lit(" -> "), F.col("target"))).otherwise(""),
    )
    return changes.orderBy(*report_order(F.col("parts"), F.col("code"), F.col("kind"))).select(text.alias("line"))


def consecutive(
    snapshots: DataFrame, entries: DataFrame, snapshot: str, order: list[str], keys: list[str], metadata: bool = False, contents: str = "chunks",
) -> DataFrame:
    """Each snapshot against the one before (the first against nothing), selected or not: (snapshot, keys, code ...).

    Entries are shifted to the next snapshot's name and all pairs are compared by one join."""
    follows = snapshots.select(snapshot, F.lead(snapshot).over(Window.orderBy(*order)).alias("__next"))  # snapshots are few
    later = entries.join(follows, snapshot).where("__next is not null").drop(snapshot).withColumnRenamed("__next", snapshot)
    return compare(later, entries, [snapshot, *keys], metadata, contents)


def counts(changes: DataFrame, *by: str) -> DataFrame:
    return changes.groupBy(*by, "code").agg(F.count(F.lit(1)).alias("entries"))
