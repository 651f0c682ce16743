"""Running streams to their end, one message at a time, and their progress."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from millrace.hooks import BatchHandler


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is available now to parquet files, each row exactly once."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_handler(stream: DataFrame, handler: BatchHandler, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hand each micro-batch to ``handler``; its offsets are committed after it returns.

    With a source limited to one file (or offset) per trigger this takes one
    unit, does its task, and only then commits.
    """
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(handler)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


class ProgressLog(StreamingQueryListener):
    """Keeps the progress reports of the queries it sees, one per micro-batch, until they are forgotten."""

    def __init__(self):
        self._reports: dict[str, list[dict]] = {}
        self._ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        report = json.loads(event.progress.json)
        self._reports.setdefault(report["runId"], []).append(report)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.setdefault(str(event.runId), threading.Event()).set()

    def wait_for(self, query: StreamingQuery, seconds: float = 600.0) -> None:
        """Block until the end of a query, and so all its reports, has arrived; an error if it does not arrive in time."""
        if not self._ended.setdefault(str(query.runId), threading.Event()).wait(seconds):
            raise TimeoutError(f"the end of query {query.runId} has not been reported within {seconds} s: its reports may be incomplete")

    def forget(self, query: StreamingQuery) -> None:
        """Drop the reports of a query, so that a listener that lives long stays small."""
        self._reports.pop(str(query.runId), None)
        self._ended.pop(str(query.runId), None)

    def rows(self, query: StreamingQuery) -> list[tuple]:
        return [
            (r["batchId"], r["timestamp"], r["numInputRows"], float(r.get("processedRowsPerSecond") or 0.0))
            for r in self._reports.get(str(query.runId), [])
        ]

    def to_frame(self, spark: SparkSession, query: StreamingQuery) -> DataFrame:
        """batch_id, timestamp, num_input_rows, rows_per_second of one query."""
        return spark.createDataFrame(
            self.rows(query), "batch_id long, timestamp string, num_input_rows long, rows_per_second double"
        )
