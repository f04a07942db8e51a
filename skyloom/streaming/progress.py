"""Counts of a running stream as rows of a table."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

_ROW = "query_id STRING, batch_id BIGINT, input_rows BIGINT, accepted BIGINT, rejected BIGINT"


class ProgressTable(StreamingQueryListener):
    """Appends a row per micro-batch with the counts that ``ingest.observed_progress`` attaches to a stream.

    A batch that is repeated after a failure is told again; :meth:`table` has each batch once. Progress is told
    after a batch has been committed, so a driver that dies in between leaves that batch out.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str = "ingest"):
        self.spark, self.folder, self.name, self.ended = spark, folder, name, {}

    def onQueryStarted(self, event) -> None:
        self._end_of(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        counts = p.observedMetrics.get(self.name)
        if counts is not None and p.numInputRows:
            row = (str(p.id), p.batchId, p.numInputRows, counts["accepted"], counts["rejected"])
            self.spark.createDataFrame([row], _ROW).coalesce(1).write.mode("append").parquet(self.folder)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()

    def _end_of(self, run: str) -> threading.Event:
        return self.ended.setdefault(run, threading.Event())

    def wait_for(self, query, seconds: float = 60) -> bool:
        """Has all been told that a terminated query had to tell? Events come in order, its end last."""
        return self._end_of(str(query.runId)).wait(seconds)

    def table(self) -> DataFrame:
        told = self.spark.read.schema(_ROW).parquet(self.folder)
        return told.groupBy("query_id", "batch_id").agg(*[F.max(c).alias(c) for c in ("input_rows", "accepted", "rejected")])
