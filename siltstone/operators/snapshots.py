"""Choosing snapshots: by recency, by selector, by paths; and finding repeats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import last_component
from .windows import previous

_RECENT = re.compile(r"(?:LAST|HEAD)(~(\d*))?")
_FULL_ID = re.compile(r"[0-9a-v]{44}[02468acegikmoqsu]")


class SelectorError(ValueError):
    """A selector that names no snapshot, or not one."""


def chronological(snapshots: DataFrame, time: str = "time_ns", key: str = "snapshot_id") -> DataFrame:
    return snapshots.orderBy(time, key)


def nth_from_last(snapshots: DataFrame, n: int, time: str = "time_ns", key: str = "snapshot_id") -> DataFrame:
    """The snapshot that has ``n`` later ones (0: the last); empty if there are too few."""
    return snapshots.orderBy(F.desc(time), F.desc(key)).limit(n + 1).offset(n)


def by_prefix(snapshots: DataFrame, prefix: str, key: str = "snapshot_id") -> DataFrame:
    """Snapshots whose id starts with ``prefix``, with how many there are."""
    hits = snapshots.where(F.col(key).startswith(prefix))
    count = hits.agg(F.count(F.lit(1)).alias("matches"))
    return hits.crossJoin(F.broadcast(count))  # one row


def select(snapshots: DataFrame, text: str, time: str = "time_ns", key: str = "snapshot_id") -> DataFrame:
    """The snapshot that ``text`` selects: a full id, LAST or HEAD with ~ or ~N, or a prefix of at
    least four characters. Raises SelectorError unless it is exactly one."""
    if _FULL_ID.fullmatch(text):
        found, why = snapshots.where(F.col(key) == text), f"no snapshot {text}"
    elif m := _RECENT.fullmatch(text):
        n = 0 if m[1] is None else 1 if m[2] == "" else int(m[2])
        found, why = nth_from_last(snapshots, n, time, key), f"{text}: there are not that many snapshots"
    elif len(text) < 4:
        raise SelectorError(f"{text}: give at least four characters of an id")
    else:
        found, why = snapshots.where(F.col(key).startswith(text)), f"no snapshot starts with {text}"
    n = len(found.select(key).take(2))
    if n != 1:
        raise SelectorError(why if n == 0 else f"{text} starts more than one snapshot's id")
    return found


def select_all(snapshots: DataFrame, texts: list[str], time: str = "time_ns", key: str = "snapshot_id") -> DataFrame:
    """The selected snapshots in order of time, each once."""
    out = None
    for text in texts:
        one = select(snapshots, text, time, key)
        out = one if out is None else out.unionByName(one)
    return chronological((snapshots.limit(0) if out is None else out).dropDuplicates([key]), time, key)


def path_set(paths: Column) -> Column:
    """A set of paths as a sorted array, so that equal sets are equal arrays."""
    return F.array_sort(F.array_distinct(paths))


def latest_by(snapshots: DataFrame, group: str, time: str, key: str, *carried: str) -> DataFrame:
    """The newest snapshot of each group, by partial aggregation."""
    best = snapshots.groupBy(group).agg(F.max(F.struct(time, key, *carried)).alias("b"))
    return best.select(group, "b.*")


def parent(snapshots: DataFrame, paths: list[str], time: str = "time_ns", key: str = "snapshot_id") -> DataFrame:
    """The newest snapshot of exactly these paths; empty if there is none."""
    same = snapshots.where(path_set(F.col("paths")) == path_set(F.array(*[F.lit(p) for p in paths]) if paths else F.array().cast("array<string>")))
    return same.orderBy(F.desc(time), F.desc(key)).limit(1)


def repeats(snapshots: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """Snapshots whose tree equals that of the one before in time (A, B, A keeps all three)."""
    marked = previous(snapshots, tree, order, "__before")
    return marked.where(F.col(tree) == F.col("__before")).drop("__before")


def same_but_time(a: dict, b: dict) -> bool:
    """Whether two snapshots agree in author, tags, paths and tree."""
    return all(a[k] == b[k] for k in ("author", "tree_id")) and all(sorted(set(a[k] or ())) == sorted(set(b[k] or ())) for k in ("tags", "paths"))


def clashing_roots(paths: DataFrame, path: str = "path") -> DataFrame:
    """Last components that several roots share: these may not be backed up together."""
    return paths.groupBy(last_component(F.col(path)).alias("name")).agg(F.count(F.lit(1)).alias("roots")).where("roots > 1")
