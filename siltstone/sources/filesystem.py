"""File trees of a machine as a Spark data source: one row per entry, from lstat.

``spark.dataSource.register(FileTree)``, then ``spark.read.format("filetree").option("roots", json_list)``. Each
entry right below a root is a partition, so big roots are walked in parallel (on machines that
share the file system). Options: ``follow`` (links are followed), ``skip`` (a JSON list of regular expressions;
what matches is not entered).
"""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Iterator
from itertools import accumulate
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.cbor import object_id
from ..operators.chunking import MAXIMUM, MINIMUM, TARGET, cuts

SCHEMA = "root string, full_path string, parts array<string>, kind string, mode long, size long, uid long, gid long, atime_ns long, mtime_ns long, target string"


class WalkError(OSError):
    """An entry that can't be backed up."""


class Slice(InputPartition):
    def __init__(self, root: str, names: list[str] | None):
        self.root, self.names = root, names  # None: the root's own row


def entry(root: str, path: str, parts: list[str], follow: bool) -> tuple:
    st = os.stat(path) if follow else os.lstat(path)
    bits = stat.S_IFMT(st.st_mode)
    kind = {stat.S_IFLNK: "symlink", stat.S_IFDIR: "directory", stat.S_IFREG: "file"}.get(bits)
    size = st.st_size if kind == "file" else None
    return (root, path, parts, kind, st.st_mode, size, st.st_uid, st.st_gid, st.st_atime_ns, st.st_mtime_ns, os.readlink(path) if kind == "symlink" else None)


def walk(root: str, path: str, parts: list[str], follow: bool, skips: list[re.Pattern]) -> Iterator[tuple]:
    """Rows of a path and all below it, by name, not entering what is skipped; names must be UTF-8."""
    todo = [(path, parts)]
    while todo:
        path, parts = todo.pop()
        try:
            path.encode()
        except UnicodeEncodeError as bad:
            raise WalkError(f"{os.fsencode(path)!r} is not UTF-8") from bad
        if any(s.search(path) for s in skips):
            continue
        row = entry(root, path, parts, follow)
        yield row
        if row[3] == "directory":
            todo += [(os.path.join(path, n), [*parts, n]) for n in sorted(os.listdir(path), reverse=True)]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.follow = options.get("follow", "false") == "true"
        self.skips = json.loads(options.get("skip", "[]"))

    def partitions(self) -> list[Slice]:
        out = []
        for root in self.roots:
            out.append(Slice(root, None))
            if os.path.isdir(root) and (self.follow or not os.path.islink(root)):
                out += [Slice(root, [n]) for n in sorted(os.listdir(root))]
        return out

    def read(self, part: Slice) -> Iterator[tuple]:
        skips = [re.compile(s) for s in self.skips]
        name = os.path.basename(part.root)
        if any(s.search(part.root) for s in skips):
            return
        if part.names is None:
            yield entry(part.root, part.root, [name], self.follow)
            return
        for n in part.names:
            yield from walk(part.root, os.path.join(part.root, n), [name, n], self.follow, skips)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, roots: list[str], skips: list[str] = (), follow: bool = False) -> DataFrame:
    """All entries of the roots: columns of ``SCHEMA`` with ``path`` and ``meta``."""
    spark.dataSource.register(FileTree)
    rows = spark.read.format("filetree").option("roots", json.dumps(list(roots))).option("skip", json.dumps(list(skips))).option(
        "follow", str(follow).lower(),
    ).load()
    meta = F.struct(
        F.lit("posix").alias("meta_type"),
        "mode",
        "size",
        "uid",
        "gid",
        "atime_ns",
        "mtime_ns",
        F.lit(None).cast("long").alias("attributes"),
        F.lit(None).cast("long").alias("creation_ns"),
    )
    return rows.select(F.array_join("parts", "/").alias("path"), "parts", "full_path", "kind", "size", "mtime_ns", "target", meta.alias("meta"))


def totals(entries: DataFrame) -> DataFrame:
    """Pre-flight: files, bytes, and entries of no kind we back up."""
    return entries.agg(
        F.count_if(F.col("kind") == "file").alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count_if(F.col("kind").isNull()).alias("special"),
    )


#: Bytes of a file that are read at a time.
WINDOW = 32 << 20


def chunks_of(stream: BinaryIO, minimum: int, target: int, maximum: int, window: int = WINDOW) -> Iterator[list[bytes]]:
    """The chunks of a stream, some at a time. Those of a window are final but for the last, whose end may be the
    window's; it goes before the next window. As a chunk's end depends on its own bytes alone, windows don't show."""
    rest = b""
    while more := stream.read(max(window, maximum)):
        data = rest + more
        ends = cuts(data, minimum, target, maximum)
        begins = [0, *ends]
        yield [data[a:b] for a, b in zip(begins, ends[:-1], strict=False)]
        rest = data[begins[-2] :]
    if rest:
        yield [rest[a:b] for ends in [cuts(rest, minimum, target, maximum)] for a, b in zip([0, *ends], ends, strict=False)]


def chunk_files(entries: DataFrame, minimum: int = MINIMUM, target: int = TARGET, maximum: int = MAXIMUM, window: int = WINDOW) -> DataFrame:
    """Read files where they lie, in windows, and cut them: (path, seq, offset, length, blob_id, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path, full in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seq, at = 0, 0
                with open(full, "rb") as f:
                    for parts in chunks_of(f, minimum, target, maximum, window):
                        n = [len(p) for p in parts]
                        begins = [at, *(at + x for x in accumulate(n))][: len(n)]
                        columns = ([path] * len(n), list(range(seq, seq + len(n))), begins, n, [object_id(p) for p in parts], parts)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                            names=["path", "seq", "offset", "length", "blob_id", "bytes"],
                        )
                        seq, at = seq + len(n), at + sum(n)

    return entries.where("kind = 'file'").select("path", "full_path").mapInArrow(
        run, "path string, seq int, offset long, length long, blob_id string, bytes binary",
    )
