"""Accounting of rows that a watermark drops, as a table beside the stream's output."""

from __future__ import annotations

import queue
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, run string, batch long, operator int, name string, rows_in long, rows_dropped long, state_rows long, watermark string, ts string"


class DroppedRows(StreamingQueryListener):
    """Writes a row per stateful operator and micro-batch to ``path``: rows read, rows dropped by the watermark, rows of state.

    A micro-batch has a folder of its own, so that one reported again overwrites
    itself. Rows are written by a thread of the driver, not in Spark's listener
    thread, which must not wait for jobs. Register with ``watch``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.waiting: queue.Queue = queue.Queue()
        self.running: set[str] = set()
        self.ended = threading.Condition()
        threading.Thread(target=self._write, daemon=True).start()

    def onQueryStarted(self, event) -> None:
        with self.ended:
            self.running.add(str(event.runId))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.ended:
            self.running.discard(str(event.runId))
            self.ended.notify_all()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [
            (str(p.id), str(p.runId), p.batchId, k, s.operatorName, p.numInputRows, s.numRowsDroppedByWatermark, s.numRowsTotal,
             p.eventTime.get("watermark"), p.timestamp)
            for k, s in enumerate(p.stateOperators)
        ]
        if rows:
            self.waiting.put((f"{self.path}/query_id={p.id}/batch_id={p.batchId}", rows))

    def _write(self) -> None:
        while True:
            path, rows = self.waiting.get()
            try:
                self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
            finally:
                self.waiting.task_done()

    def drain(self, seconds: float = 60) -> None:
        """Wait until the end of all queries is reported and their progress written."""
        with self.ended:
            self.ended.wait_for(lambda: not self.running, seconds)
        self.waiting.join()


def watch(spark: SparkSession, path: str) -> DroppedRows:
    """Account for all streams of the session from now on."""
    listener = DroppedRows(spark, path)
    spark.streams.addListener(listener)
    return listener


def dropped_rows(spark: SparkSession, path: str) -> DataFrame:
    """(query, rows_in, rows_dropped, state_rows): over all micro-batches of each query; state_rows is the last one's."""
    table = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(path)
    by_batch = table.groupBy("query", "batch").agg(
        F.max("rows_in").alias("rows_in"), F.sum("rows_dropped").alias("rows_dropped"), F.sum("state_rows").alias("state_rows")
    )
    return by_batch.groupBy("query").agg(
        F.sum("rows_in").alias("rows_in"), F.sum("rows_dropped").alias("rows_dropped"), F.max_by("state_rows", "batch").alias("state_rows")
    )
