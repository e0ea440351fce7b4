"""Restoring: which actions bring a file system to a snapshot, and putting contents together."""

from __future__ import annotations

import contextlib
import os
import shutil
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .diff import compare

#: Ending of a file that is not whole yet.
PART = ".part"


def plan(
    filesystem: DataFrame, snapshot: DataFrame, keys: list[str], delete: bool = False, times: bool = False, permissions: bool = False, contents: str = "chunks",
) -> DataFrame:
    """Actions (keys, code, kind, target): the file system is the old side, the snapshot the new one.

    Without ``delete`` nothing is removed, save a file or link that something replaces, and no directory
    gives way to a file or link. Metadata is set on request only, and ownership never.
    """
    changes = compare(filesystem, snapshot, keys, metadata=times or permissions, contents=contents)
    wanted = ["+", "-", "C", *(["T", "A"] if times else []), *(["P"] if permissions else [])]
    changes = changes.where(F.col("code").isin(*wanted))
    if delete:
        return changes
    old = filesystem.select(*keys, F.col("kind").alias("__old"))
    new = snapshot.select(*keys, F.col("kind").alias("__new"))
    both = changes.join(old, keys, "left").join(new, keys, "left")
    blocked = (F.col("__old") == "directory") & F.col("__new").isNotNull() & (F.col("__new") != "directory")
    removal = (F.col("code") == "-") & (F.col("__new").isNull() | blocked)
    return both.where(~F.coalesce(removal | blocked, F.lit(False))).drop("__old", "__new")


def reassemble(chunks: DataFrame, key: list[str], seq: str, text: str, out: str = "content") -> DataFrame:
    """Texts of chunks joined in order of ``seq``, per key."""
    pieces = F.array_sort(F.collect_list(F.struct(seq, F.coalesce(text, F.lit("")).alias("t"))))
    return chunks.groupBy(*key).agg(F.array_join(F.transform(pieces, lambda x: x["t"]), "").alias(out))


def remap(parts: Column, target: Column) -> Column:
    """A path with its first component replaced by the target it is restored to."""
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.concat_ws("/", F.concat(F.array(target), rest))


def remove(rows: Iterator) -> None:
    """Remove what stands at places (place, depth); directories with all that they hold, links without following them."""
    for r in rows:
        with contextlib.suppress(FileNotFoundError):  # gone with its directory
            if os.path.isdir(r["place"]) and not os.path.islink(r["place"]):
                shutil.rmtree(r["place"], ignore_errors=True)
            else:
                os.unlink(r["place"])


def create(rows: Iterator) -> None:
    """Make directories, links, and empty files under temporary names (place, kind, target)."""
    for r in rows:
        os.makedirs(os.path.dirname(r["place"]), exist_ok=True)
        if r["kind"] == "directory":
            os.makedirs(r["place"], exist_ok=True)
        elif r["kind"] == "symlink":
            with contextlib.suppress(FileNotFoundError):  # of an attempt before
                os.unlink(r["place"])
            os.symlink(r["target"], r["place"])
        else:
            with open(r["place"] + PART, "wb"):
                pass


def write_pieces(rows: Iterator) -> None:
    """Write chunks (place, offset, bytes) where they belong in files under temporary names, in any order."""
    for r in rows:
        with open(r["place"] + PART, "r+b") as f:
            f.seek(r["offset"])
            f.write(r["bytes"])


def finish(rows: Iterator) -> None:
    """Put written files (path) in place."""
    for r in rows:
        with contextlib.suppress(FileNotFoundError):  # done by an attempt before
            os.replace(r["path"] + PART, r["path"])


def setter(times: bool, permissions: bool) -> Callable[[Iterator], None]:
    """Set modes and times of places (place, kind, meta)."""

    def run(rows: Iterator) -> None:
        for r in rows:
            if r["meta"] is None:
                continue
            if permissions and r["kind"] != "symlink":
                os.chmod(r["place"], r["meta"]["mode"] & 0o7777)
            if times:
                os.utime(r["place"], ns=(r["meta"]["atime_ns"], r["meta"]["mtime_ns"]), follow_symlinks=False)

    return run
