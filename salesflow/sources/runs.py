"""The log of pipeline runs: events that are only ever added, so that it survives retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.operators.control import FAILURE_CHARS, next_attempt, run_states
from salesflow.sources.commits import Conflict
from salesflow.sources.sinks import Published

EVENTS = "pipeline string, run_id string, seq long, status string, attempt int, rows long, failure string, at timestamp"


class RunLog:
    """Run events under a path. An event is one commit; of a failure's text the first 4,000 characters are kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        rows = Published(self.spark, self.path).read()
        return self.spark.createDataFrame([], EVENTS) if rows is None else rows

    def add(self, events: DataFrame) -> None:
        """Append events; again on top of what another writer was faster to add."""
        names = [c.split()[0] for c in EVENTS.split(", ")]
        cut = events.withColumn("failure", F.substring("failure", 1, FAILURE_CHARS)).select(*names)
        for _ in range(20):
            log = Published(self.spark, self.path)
            log.append(cut)
            try:
                return log.commit()
            except Conflict:
                continue
        raise Conflict(self.path)

    def _one(self, pipeline: str, run_id: str, status: str, attempt: int, rows: int | None, failure: str | None) -> None:
        # the sequence of a run's events is the time they are written at
        row = self.spark.createDataFrame([(pipeline, run_id, status, attempt, rows, failure)], "pipeline string, run_id string, status string, attempt int, rows long, failure string")
        self.add(row.withColumns({"seq": F.unix_micros(F.current_timestamp()), "at": F.current_timestamp()}).coalesce(1))

    def start(self, pipeline: str, run_id: str) -> int:
        """A new attempt of a run; its number."""
        attempt = next_attempt(self.events(), run_id)
        self._one(pipeline, run_id, "running", attempt, None, None)
        return attempt

    def end(self, pipeline: str, run_id: str, attempt: int, rows: int | None = None, failure: BaseException | str | None = None) -> None:
        self._one(pipeline, run_id, "failed" if failure is not None else "success", attempt, rows, None if failure is None else str(failure))

    def states(self) -> DataFrame:
        """The state of each run; a failure never overrides a success."""
        return run_states(self.events())
