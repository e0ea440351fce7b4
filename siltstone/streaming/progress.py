"""What runs have done: counters of batch jobs by observation, and of streams by their progress reports.

Observed metrics are computed in the job's own tasks as rows pass, so counting costs no second pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


class Counters:
    """Named counters: each watches a table as a job reads or writes it."""

    def __init__(self) -> None:
        self.watched: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str, **measures: Column) -> DataFrame:
        """The same rows, whose number (``rows``) and further measures are counted when they are computed."""
        self.watched[name] = Observation(name)
        return df.observe(self.watched[name], F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in measures.items()])

    def values(self) -> dict[str, dict]:
        """All counters; waits until the jobs have run that compute the tables."""
        return {name: seen.get for name, seen in self.watched.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, measure, value) of all counters."""
        rows = [(name, k, int(v or 0)) for name, own in self.values().items() for k, v in own.items()]
        return spark.createDataFrame(rows, "name string, measure string, value long")


class Ticker(StreamingQueryListener):
    """Tells a function about each batch of every stream: (name, batch, rows, rows a second). Add it to ``spark.streams``."""

    def __init__(self, tell: Callable[[str, int, int, float], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell(p.name or str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def rows_read(run: StreamingQuery) -> int:
    """Rows that the last batches of a stream took in (as many batches as Spark keeps reports of)."""
    return sum(p["numInputRows"] for p in run.recentProgress)
