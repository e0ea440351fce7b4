"""A store of objects in the driver's memory, for tests and small sets: the same columns as a listing with contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import finished_objects


class MemoryStore:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: dict[str, bytes] = {}

    def write(self, name: str, content: bytes) -> None:
        self.held[name] = bytes(content)

    def read(self, name: str) -> bytes:
        """The content of an object; KeyError if it is not there."""
        return self.held[name]

    def remove(self, name: str) -> None:
        del self.held[name]

    def objects(self, prefix: str = "") -> DataFrame:
        """(name, length, content) of the finished objects whose names start with ``prefix``."""
        rows = [(n, bytearray(c)) for n, c in sorted(self.held.items()) if n.startswith(prefix)]
        listed = self.spark.createDataFrame(rows, "name string, content binary")
        return finished_objects(listed).select("name", F.octet_length("content").cast("long").alias("length"), "content")
