"""Streams of blobs into a deduplicated table.

Two ways: ``distinct_stream`` keeps seen ids in operator state, dropped behind a watermark; ``ingest``
anti-joins each micro-batch with the table, so state is the table itself and nothing is forgotten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import new_blobs
from ..sources import objects


def distinct_stream(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "1 day") -> DataFrame:
    """First row of each key. With ``time``, keys are forgotten once ``late`` behind the newest."""
    if time:
        return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def table_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if objects.child_names(spark, path) else spark.createDataFrame([], schema)


def ingest(stream: DataFrame, table: str, checkpoint: str, blob: str = "blob_id") -> StreamingQuery:
    """Append the stream's new blobs to a Parquet table, each once; start again from ``checkpoint`` at will.

    A batch that is repeated after a failure finds what it wrote before, so it adds nothing twice."""
    schema = stream.schema

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new_blobs(rows, table_or_empty(spark, table, schema), blob).write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows by window of ``every``, closed ``late`` behind the newest."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every).alias("w")).count().select(F.col("w.start").alias("start"), "count")
