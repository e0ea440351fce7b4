"""Objects of a store: listings by prefix, contents, and atomic writes, through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import finished_objects


def list_objects(spark: SparkSession, root: str, prefix: str = "", pattern: str = "*") -> DataFrame:
    """(name, prefix, bytes) of the files below ``root``/``prefix``; unfinished writes are left out.

    The listing is Spark's own; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(f"{root}/{prefix}".rstrip("/"))
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    name = F.element_at(F.split("path", base + "/", 2), -1)
    listed = files.select(name.alias("name"), F.col("length").alias("bytes"))
    return finished_objects(listed).select("name", F.element_at(F.split("name", "/"), 1).alias("prefix"), "bytes")


def read_objects(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of the matching files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def totals_by_prefix(objects: DataFrame) -> DataFrame:
    return objects.groupBy("prefix").agg(F.count(F.lit(1)).alias("objects"), F.sum("bytes").cast("long").alias("bytes"))


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _place(spark, path)
    return store.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small object: a temporary first, then a rename."""
    where, store = _place(spark, path + ".part")
    out = store.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()
    final, _ = _place(spark, path)
    store.delete(final, False)
    if not store.rename(where, final):
        raise OSError(f"{path} could not be put in place")


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names right below a folder (none if it is not there)."""
    where, store = _place(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []
