"""Streaming jobs over service logs: three queries on one source, and idempotent epochs.

The first contract drops events later than the watermark in its windowed report; the second keeps them in raw, marked
invalid, as it has no stateful operator. A window is emitted once, after the watermark passes its end.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from salesflow.operators import logs
from salesflow.operators.control import check_generation, epoch_action, lineage_of
from salesflow.sources.commits import Commits
from salesflow.sources.sinks import drop_partitions, overwrite_partitions


def windowed(classified: DataFrame, delay: str = "1 minute", duration: str = "1 minute") -> DataFrame:
    """The windowed report of valid events, under a watermark."""
    valid = classified.filter("is_valid").drop("is_valid", "rejection_reason")
    report = logs.window_report(valid.withWatermark("event_time", delay), duration)
    return report.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "service", "status_code", "requests", "avg_latency_ms", "max_latency_ms", "is_error")


def deduplicated(events: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """Each event_id once, across batches: the ids are state until the watermark, `delay` behind the latest event, has passed
    them, and a repeat that comes later than that is a late event. Rows without an id are kept out."""
    return events.filter("event_id IS NOT NULL").withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def trigger(every: str | None) -> dict:
    """Options of a trigger: processing time, or all that is available once."""
    return {"processingTime": every} if every else {"availableNow": True}


def start_three(source: DataFrame, base: str, *, delay: str = "1 minute", duration: str = "1 minute", every: str | None = None) -> list[StreamingQuery]:
    """Windowed report, quarantine and per-epoch metrics, each with its own checkpoint."""
    classified = logs.classify_v1(source)

    def metrics(batch: DataFrame, epoch: int) -> None:
        # one file for each epoch: a replay writes the same file again
        logs.acceptance(batch).withColumn("batch_id", F.lit(epoch)).coalesce(1).write.mode("overwrite").parquet(f"{base}/metrics/batch_{epoch:020d}")

    writers = {
        "report": windowed(classified, delay, duration).writeStream.format("parquet").outputMode("append").option("path", f"{base}/report"),
        "quarantine": logs.quarantine(classified).writeStream.format("parquet").outputMode("append").option("path", f"{base}/quarantine"),
        "metrics": classified.writeStream.foreachBatch(metrics),
    }
    return [w.queryName(f"logs_{name}_{zlib.crc32(base.encode())}").option("checkpointLocation", f"{base}/checkpoints/{name}").trigger(**trigger(every)).start() for name, w in writers.items()]


def run_until_done(queries: list[StreamingQuery], seconds: float | None = None) -> None:
    """Wait for the queries; stop all of them on the way out."""
    try:
        for q in queries:
            q.awaitTermination(seconds) if seconds else q.awaitTermination()
    finally:
        for q in queries:
            if q.isActive:
                q.stop()


EPOCHS = "generation string, epoch long, status string, landed_at timestamp, raw_count long, valid_count long, max_event_time timestamp, lag_seconds long"
CONTRIBUTIONS = "minute_start timestamp, service string, request_count long, latency_sum long, max_latency_ms int, generation string, epoch long"
RAW_LEAF = ["ingest_date", "ingest_hour", "rotation_5m", "generation", "epoch"]
#: Records of ended epochs that the state of the control holds before they are written as one file of the record.
RECENT = 64


class Control:
    """The control of epochs and generations under one folder: a small state, replaced by one commit for each step.

    The state holds each generation (query, checkpoint, lineage, status, is_active, first and last successful epoch), the epoch
    that each has open, and the records of the last ended epochs. An epoch's success, its generation's activation, the end of
    the old one and the lineage are one commit, so a crash is before or after all of them. As successful epochs have no
    gaps, first and last say which they are; older records are rows of Parquet files that no step reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.commits = spark, path, Commits(spark, path)

    def state(self) -> dict:
        return self.commits.last()[1] or {"generations": {}, "open": {}, "recent": [], "files": []}

    def update(self, change: Callable[[dict], None]) -> None:
        """Commit the state as changed; on a race with another query the change is made again to the newer state."""

        def changed(state: dict | None) -> dict:
            state = state or {"generations": {}, "open": {}, "recent": [], "files": []}
            change(state)
            return state

        self.commits.update(changed)

    def last_success(self, generation: str) -> int:
        return self.state()["generations"].get(generation, {}).get("last", -1)

    def record(self, generation: str, epoch: int) -> dict | None:
        """An epoch's record; of ended ones the last RECENT and more."""
        state = self.state()
        now = state["open"].get(generation)
        if now and now["epoch"] == epoch:
            return now
        return next((r for r in reversed(state["recent"]) if (r["generation"], r["epoch"]) == (generation, epoch)), None)

    def check(self, generation: str, query: str, checkpoint: str) -> None:
        """Raise if the generation belongs to another query or checkpoint, or was superseded."""
        check_generation(self.state()["generations"], generation, query, checkpoint)

    def reserve(self, generation: str, epoch: int) -> tuple[datetime, bool]:
        """When the epoch landed, and whether it was tried before: a retry keeps the first attempt's time, so that the same
        events are judged late."""
        known, now = self.record(generation, epoch), datetime.now(timezone.utc)
        landed = known["landed_at"] if known else now.timestamp()
        self.update(lambda s: s["open"].update({generation: {"generation": generation, "epoch": epoch, "status": "running", "landed_at": landed}}))
        return datetime.fromtimestamp(landed, timezone.utc), known is not None

    def failed(self, generation: str, epoch: int) -> None:
        def change(state: dict) -> None:
            if (now := state["open"].get(generation)) and now["epoch"] == epoch:
                now["status"] = "failed"

        self.update(change)

    def succeed(self, generation: str, query: str, checkpoint: str, epoch: int, stats: dict) -> None:
        """One commit: the epoch's success, and from a generation's first one its activation; the old one of the query is
        superseded, and its lineage goes on if the new one starts where it stopped."""

        def change(state: dict) -> None:
            known = state["generations"]
            own = known.get(generation)
            if not (own and own["is_active"]):
                old = next((g for g in known.values() if g["query"] == query and g["is_active"]), None)
                lineage = lineage_of(generation, epoch, old["last"] if old else None, old["lineage"] if old else None)
                if old:
                    old |= {"status": "superseded", "is_active": False}
                known[generation] = own = {"query": query, "checkpoint": checkpoint, "lineage": lineage, "status": "active", "is_active": True, "first": epoch, "last": epoch}
            own["last"] = epoch
            opened = state["open"].pop(generation, {})
            state["recent"].append(opened | stats | {"generation": generation, "epoch": epoch, "status": "success"})

        self.update(change)
        self._compact()

    def _compact(self) -> None:
        """Move the records of a full state into one file; a crash between leaves a file that no state names."""
        done = self.state()["recent"]
        if len(done) < 2 * RECENT:
            return
        place = f"records/{uuid.uuid4().hex}"
        old = done[:-RECENT]
        self._frame(old).coalesce(1).write.parquet(f"{self.path}/{place}")

        def change(state: dict) -> None:
            if state["recent"][: len(old)] == old:
                state["recent"] = state["recent"][len(old) :]
                state["files"].append(place)

        self.update(change)

    def _frame(self, records: list[dict]) -> DataFrame:
        names = [c.split()[0] for c in EPOCHS.split(", ")]
        at = lambda r, n: datetime.fromtimestamp(r[n], timezone.utc) if n in ("landed_at", "max_event_time") and r.get(n) is not None else r.get(n)
        return self.spark.createDataFrame([tuple(at(r, n) for n in names) for r in records], EPOCHS)

    def records(self) -> DataFrame:
        """All records of epochs."""
        state = self.state()
        rows = self._frame(state["recent"] + list(state["open"].values()))
        files = [f"{self.path}/{f}" for f in state["files"]]
        return rows.unionByName(self.spark.read.schema(EPOCHS).parquet(*files)) if files else rows

    def active_lineage(self, query: str) -> list[str]:
        """Every generation in the lineage of the query's active one."""
        known = {n: g for n, g in self.state()["generations"].items() if g["query"] == query}
        alive = {g["lineage"] for g in known.values() if g["is_active"]}
        return sorted(n for n, g in known.items() if g["lineage"] in alive)

    def done(self, generations: list[str]) -> Column:
        """Whether a row's (generation, epoch) is a successful one of the given generations: ranges, which prune folders."""
        known = self.state()["generations"]
        ranges = [(F.col("generation") == n) & F.col("epoch").between(known[n]["first"], known[n]["last"]) for n in generations if n in known]
        return reduce(lambda a, b: a | b, ranges, F.lit(False))


def epoch_writer(
    spark: SparkSession, base: str, generation: str, *, query: str = "service_logs", checkpoint: str | None = None, max_delay_seconds: int = 120, fail: Callable[[str, int], None] | None = None
) -> Callable[[DataFrame, int], None]:
    """foreachBatch of the second contract: reserve, raw rows, contribution, and one commit of success and activation. A retry
    judges events by the time of the first attempt and replaces all that its epoch wrote before, so a crash between steps
    and a replay end in the same tables; a finished epoch is skipped. fail(step, epoch) lets tests break a step."""
    control = Control(spark, f"{base}/control")
    checkpoint = checkpoint or f"{base}/checkpoints/{generation}"
    own = {"generation": generation}
    fail = fail or (lambda step, epoch: None)

    def process(batch: DataFrame, epoch: int) -> None:
        control.check(generation, query, checkpoint)
        known = control.record(generation, epoch)
        if epoch_action(epoch, control.last_success(generation), known["status"] if known else None) == "replay":
            return
        fail("start", epoch)
        landed, again = control.reserve(generation, epoch)
        fail("reserved", epoch)
        numbers = {"generation": F.lit(generation), "epoch": F.lit(epoch).cast("long")}
        classified = logs.classify_v2(batch, max_delay_seconds, F.lit(landed)).withColumns(numbers).persist()
        try:
            if again:
                for table, by in (("raw", RAW_LEAF), ("contributions", ["generation", "epoch"])):
                    drop_partitions(spark, f"{base}/{table}", by, own | {"epoch": epoch})
            overwrite_partitions(classified, f"{base}/raw", RAW_LEAF)
            fail("raw", epoch)
            part = logs.partials(classified.filter("is_valid")).withColumns(numbers)
            overwrite_partitions(part, f"{base}/contributions", ["generation", "epoch"])
            fail("contributions", epoch)
            stats = logs.ingestion_lag(logs.batch_stats(classified), F.current_timestamp()).withColumn("max_event_time", F.unix_micros("max_event_time") / 1e6)
            stats = stats.select("raw_count", "valid_count", "max_event_time", "lag_seconds").first().asDict()
            control.succeed(generation, query, checkpoint, epoch, stats)
            fail("succeeded", epoch)
        except Exception:
            control.failed(generation, epoch)
            raise
        finally:
            classified.unpersist()

    return process


def start_epochs(source: DataFrame, base: str, generation: str, *, every: str | None = None, **options) -> StreamingQuery:
    """The second contract's query."""
    spark = source.sparkSession
    writer = source.writeStream.foreachBatch(epoch_writer(spark, base, generation, **options))
    return writer.option("checkpointLocation", f"{base}/checkpoints/{generation}").trigger(**trigger(every)).start()


def live_report(spark: SparkSession, base: str, generations: list[str] | None = None, query: str = "service_logs") -> DataFrame:
    """The live report over the contributions of successful epochs of the given generations, or of the query's active lineage."""
    control = Control(spark, f"{base}/control")
    generations = control.active_lineage(query) if generations is None else generations
    return logs.live_view(spark.read.schema(CONTRIBUTIONS).parquet(f"{base}/contributions").filter(control.done(generations)))
