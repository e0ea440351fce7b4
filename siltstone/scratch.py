"""Tables that cut lineage: written to the folder that the cluster shares, dropped when they are done with.

A table goes when the ``scope`` ends in which it was written, and at the latest when the application ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[int, str] = {}
#: Path: session, in the order of writing.
_WRITTEN: dict[str, SparkSession] = {}


class ScratchError(RuntimeError):
    """There is no folder that all executors share."""


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only where that is unset and the executors are this
    machine's, a folder of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master.partition("[")[0] != "local":
        raise ScratchError(f"set spark.checkpoint.dir to a folder that all executors share (the master is {master})")
    key = id(spark.sparkContext)
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return _OWN[key]


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop(path: str) -> None:
    if spark := _WRITTEN.pop(path, None):
        with contextlib.suppress(Exception):  # the session may be gone
            delete_path(spark, path)


@atexit.register
def _drop_all() -> None:
    for path in reversed(list(_WRITTEN)):
        _drop(path)


def folder(spark: SparkSession, tag: str) -> str:
    """The path of a new folder in the shared one, dropped like a table."""
    path = f"{scratch_dir(spark)}/siltstone/{tag}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    A lost executor costs only the tasks it ran, since finished tables stay in the shared folder.
    """
    spark = df.sparkSession
    path = folder(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Drop tables that ``materialize`` returned; nothing may read them any more."""
    for t in tables:
        _drop(t.scratch_path)


@contextlib.contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are dropped at the end, but those given to the function that it yields. What reads
    them must be written inside too."""
    before, kept = set(_WRITTEN), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.scratch_path)
        return table

    try:
        yield keep
    finally:
        for path in [p for p in _WRITTEN if p not in before and p not in kept]:
            _drop(path)
