"""What running streams report about themselves, as rows."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from salesflow.operators.control import FAILURE_CHARS
from salesflow.sources.commits import fs_of

PROGRESS = "query string, query_id string, run_id string, batch_id long, updated_at timestamp, input_rows long, duration_ms long, state_rows long, watermark string, status string, failure string"


class ProgressLog(StreamingQueryListener):
    """Writes a small JSON file for each batch of each query, and one for its end with the beginning of a failure's text; a
    batch that reports again replaces its file. Events come some time after their batch: wait with `settled`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.names, self.ended = spark, path, {}, set()

    def _write(self, name: str, row: dict) -> None:
        fs, at = fs_of(self.spark, f"{self.path}/{name}.json")
        out = fs.create(at, True)
        try:
            out.write(bytearray(json.dumps(row).encode("utf-8")))
        finally:
            out.close()

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"query": p.name, "query_id": str(p.id), "run_id": str(p.runId), "batch_id": p.batchId, "updated_at": p.timestamp, "input_rows": p.numInputRows, "duration_ms": p.durationMs.get("triggerExecution"), "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "watermark": (p.eventTime or {}).get("watermark"), "status": "success"}
        self._write(f"{p.runId}-{p.batchId:020d}", row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        failure = event.exception
        row = {"query": self.names.get(str(event.id)), "query_id": str(event.id), "run_id": str(event.runId), "status": "failed" if failure else "ended", "failure": failure and failure[:FAILURE_CHARS]}
        self._write(f"{event.runId}-end", row)
        self.ended.add(str(event.runId))

    def settled(self, queries: list[StreamingQuery], seconds: float = 30) -> None:
        """Wait until the end of these queries has been reported."""
        until = time.monotonic() + seconds
        while not {str(q.runId) for q in queries} <= self.ended:
            if time.monotonic() > until:
                raise TimeoutError("the end of a query was not reported")
            time.sleep(0.05)

    def rows(self) -> DataFrame:
        """All reports."""
        return self.spark.read.schema(PROGRESS).json(self.path)
