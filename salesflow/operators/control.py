"""Run control over small tables: windows, watermarks, runs, epochs, generations, health, alerts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of the stream's contract.
LATENESS, SETTLEMENT, HEARTBEAT, STUCK, LAG = 120, 180, 90, 120, 60
#: Fixed value: how much of a failure's text is kept.
FAILURE_CHARS = 4000
#: The longest gaps that one scheduled run may fill.
LONGEST_GAP = {"promotions": timedelta(days=31), "logs": timedelta(days=7)}


class ContractError(Exception):
    """A run's window, epoch or lineage breaks its contract."""


def next_window(start: datetime, end: datetime, watermark: datetime | None, scheduled: bool, longest: timedelta) -> tuple[datetime, datetime]:
    """The half-open window of a run: a scheduled run starts at the last successful watermark, so gaps are
    filled; a backfill keeps its window."""
    if not scheduled or watermark is None:
        return start, end
    if watermark >= end:
        raise ContractError("no new window: the watermark has reached its end")
    if end - watermark > longest:
        raise ContractError(f"the gap since the watermark is longer than {longest}")
    return watermark, end


def planned_windows(requests: DataFrame, marks: DataFrame, longest: timedelta) -> DataFrame:
    """The rule of `next_window` for many runs at once: requests (pipeline, window_start, window_end, scheduled), one a pipeline, against
    marks (pipeline, watermark). pipeline, window_start, window_end and error, of which either the window or the error is NULL."""
    start, end, mark = F.col("window_start"), F.col("window_end"), F.col("watermark")
    follows = F.col("scheduled") & mark.isNotNull()
    gap = F.lit(longest.total_seconds()).cast("long")
    error = F.when(follows & (mark >= end), "no new window").when(follows & (F.unix_micros(end) - F.unix_micros(mark) > gap * 1_000_000), "gap too long")
    rows = requests.join(marks, "pipeline", "left").select("pipeline", F.when(follows, mark).otherwise(start).alias("a"), end.alias("b"), error.alias("error"))
    return rows.select("pipeline", *(F.when(F.col("error").isNull(), F.col(c)).alias(name) for c, name in (("a", "window_start"), ("b", "window_end"))), "error")


def rows_due(source: DataFrame, planned: DataFrame, at: str) -> DataFrame:
    """The source's rows of each pipeline's planned half-open window; an erroneous run reads none."""
    windows = planned.filter("error IS NULL").select("pipeline", F.col("window_start").alias("_from"), F.col("window_end").alias("_until"))
    return source.join(windows, "pipeline").filter((F.col(at) >= F.col("_from")) & (F.col(at) < F.col("_until"))).drop("_from", "_until")


def settled_until(as_of: datetime, settlement: int = SETTLEMENT, lateness: int = LATENESS, interval: int = 30) -> datetime:
    """The end of what is settled: the 5-minute slot of as_of less the settlement."""
    if settlement < lateness + interval:
        raise ContractError("settlement must cover lateness and one batch interval")
    seconds = int(as_of.timestamp()) - settlement
    return datetime.fromtimestamp(seconds - seconds % 300, as_of.tzinfo)


def advance_watermarks(marks: DataFrame, windows: DataFrame) -> DataFrame:
    """marks (pipeline, watermark) after windows (pipeline, window_start, window_end, run_id): a window moves the
    mark forward only if it starts at or before it, so no gap is jumped; a late backfill never moves it back."""
    due = windows.alias("w").join(marks.alias("m"), "pipeline", "left").filter(F.col("m.watermark").isNull() | (F.col("w.window_start") <= F.col("m.watermark")))
    best = due.groupBy("pipeline").agg(F.max("w.window_end").alias("reached"))
    return marks.join(best, "pipeline", "full").select("pipeline", F.greatest("watermark", "reached").alias("watermark"))


def epoch_action(epoch: int, last_success: int, status: str | None = None) -> str:
    """'process' or 'replay' (skip); an epoch that goes back, jumps, or contradicts its record is an error."""
    if epoch < last_success:
        raise ContractError(f"epoch {epoch} is before {last_success}")
    if epoch == last_success:
        if status == "success":
            return "replay"
        raise ContractError("the last successful epoch has no successful record")
    if last_success >= 0 and epoch > last_success + 1:
        raise ContractError(f"epoch {epoch} jumps over {last_success + 1}")
    return "process"


def lineage_of(generation: str, epoch: int, active_last: int | None, active_lineage: str | None) -> str:
    """A generation that goes on where the active one stopped keeps its lineage; any other starts its own."""
    return active_lineage if active_last is not None and active_lineage and epoch == active_last + 1 else generation


def check_generation(registry: dict[str, dict], generation: str, query: str, checkpoint: str) -> None:
    """A generation belongs to one query and checkpoint, and cannot resume once superseded."""
    known = registry.get(generation)
    if known and (known["query"], known["checkpoint"]) != (query, checkpoint):
        raise ContractError(f"generation {generation} belongs to another query or checkpoint")
    if known and known.get("status") == "superseded":
        raise ContractError(f"generation {generation} is superseded")


def repair_generations(generations: DataFrame) -> DataFrame:
    """One active generation for each query: of several the newest stays; with none, the one of most successful epochs starts."""
    per = Window.partitionBy("query")
    newest = F.row_number().over(per.orderBy(F.col("is_active").desc(), F.col("updated_at").desc_nulls_last(), F.desc("generation")))
    furthest = F.row_number().over(per.orderBy(F.desc("last_success"), F.col("updated_at").desc_nulls_last(), F.desc("generation")))
    any_active = F.max(F.col("is_active").cast("int")).over(per) == 1
    marked = generations.withColumns({"_a": any_active, "_n": newest, "_f": furthest})
    active = F.when(F.col("_a"), F.col("_n") == 1).otherwise((F.col("_f") == 1) & (F.col("last_success") >= 0))
    return marked.withColumn("is_active", active).drop("_a", "_n", "_f")


def active_contributions(contributions: DataFrame, generations: DataFrame) -> DataFrame:
    """Contributions of every generation in the lineage of the active one."""
    lineage = generations.filter("is_active").select(F.col("lineage").alias("_lineage"))
    alive = generations.join(lineage, F.col("lineage") == F.col("_lineage"), "left_semi").select("generation")
    return contributions.join(alive.distinct(), "generation", "left_semi")


def run_states(events: DataFrame) -> DataFrame:
    """The state of each run from append-only events (run_id, seq, attempt, status, rows): the last event, but a
    failure never overrides a success."""
    rank = F.when(F.col("status") == "success", 1).otherwise(0)
    return events.groupBy("pipeline", "run_id").agg(F.max_by("status", F.struct(rank, F.col("seq"))).alias("status"), F.max("attempt").alias("attempt"), F.max_by("rows", F.struct(rank, F.col("seq"))).alias("rows"))


def next_attempt(events: DataFrame, run_id: str) -> int:
    """1 for a new run, one more than before for a retry."""
    return (events.filter(F.col("run_id") == run_id).agg(F.max("attempt")).first()[0] or 0) + 1


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each pipeline."""
    last = F.row_number().over(Window.partitionBy("pipeline").orderBy(F.desc("started_at"), F.desc("run_id")))
    return runs.withColumn("_r", last).filter("_r = 1").drop("_r")


def pipeline_metrics(runs: DataFrame) -> DataFrame:
    """Runs by pipeline and status, with rows."""
    return runs.groupBy("pipeline", "status").agg(F.count(F.lit(1)).alias("runs"), F.sum("rows").alias("rows"))


#: States of a run that has not ended.
OPEN_STATES = ("running", "ingesting", "transforming", "publishing")


def run_metrics(runs: DataFrame, checks: DataFrame, now: Column) -> DataFrame:
    """One row for each pipeline: running, last_success_at (seconds), and of its last ended run last_run_success,
    duration_seconds, rows and failed_checks. runs: pipeline, run_id, status, started_at, finished_at, rows; checks: run_id,
    passed. Missing figures are 0."""
    open_ = F.col("status").isin(*OPEN_STATES)
    ended = F.when(~open_, F.struct("started_at", "run_id", "status", "finished_at", "rows"))
    seconds = F.unix_seconds
    totals = runs.groupBy("pipeline").agg(F.count_if(open_).alias("running"), F.max(F.when(F.col("status") == "success", seconds("finished_at"))).alias("last_success_at"), F.max(ended).alias("last"))
    failed = checks.groupBy("run_id").agg(F.count_if(~F.col("passed")).alias("failed_checks")).withColumnRenamed("run_id", "_run")
    met = totals.join(failed, F.col("last.run_id") == F.col("_run"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    duration = F.greatest(F.lit(0), seconds(F.coalesce("last.finished_at", now)) - seconds("last.started_at"))
    return met.select("pipeline", "running", zero(F.col("last_success_at")).alias("last_success_at"), zero((F.col("last.status") == "success").cast("int")).alias("last_run_success"), zero(duration).alias("duration_seconds"), zero(F.col("last.rows")).alias("rows"), zero(F.col("failed_checks")).alias("failed_checks"))


def quality_failed(runs: DataFrame, checks: DataFrame) -> DataFrame:
    """Runs with the state quality_failed where one of their checks failed, unless they have succeeded."""
    bad = checks.filter(~F.col("passed")).select(F.col("run_id").alias("_run")).distinct()
    met = runs.join(bad, F.col("run_id") == F.col("_run"), "left")
    return met.withColumn("status", F.when(F.col("_run").isNotNull() & (F.col("status") != "success"), "quality_failed").otherwise(F.col("status"))).drop("_run")


def stream_health(batches: DataFrame, now: str | Column) -> DataFrame:
    """query, verdict of the last batch: stuck, failed, stopped, lagging or healthy."""
    last = latest_of(batches, "query")
    at = now if isinstance(now, Column) else F.lit(now)
    age = F.unix_seconds(at.cast("timestamp")) - F.unix_seconds("updated_at")
    verdict = (
        F.when((F.col("status") == "running") & (age > STUCK), "stuck").when(~F.col("status").isin("success", "running"), "failed").when(age > HEARTBEAT, "stopped").when(F.col("lag_seconds") > LAG, "lagging").otherwise("healthy")
    )
    return last.select("query", verdict.alias("verdict"))


def latest_of(rows: DataFrame, key: str) -> DataFrame:
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("updated_at"), F.desc("batch_id")))
    return rows.withColumn("_r", last).filter("_r = 1").drop("_r")


#: Alert names and their conditions over one row of metrics; `now` is a column of seconds.
ALERTS = {
    "PipelineLastRunFailed": "last_run_success = 0",
    "PipelineDataQualityFailed": "failed_checks > 0",
    "PipelineStale": "now - last_success_at > 93600",
    "LogIngestionDelayExceeded": "lag_seconds > 60",
    "LogStreamStopped": "coalesce(last_batch_at, 0) = 0 OR now - last_batch_at > 75",
    "LogInvalidRecordsDetected": "invalid_records > 0",
    "LogReportStale": "coalesce(last_report_at, 0) = 0 OR now - last_report_at > 420",
}


def alerts(metrics: DataFrame) -> DataFrame:
    """pipeline, alert for each condition that holds."""
    fired = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in ALERTS.items())))
    return metrics.select("pipeline", F.explode(fired).alias("alert"))


def stream_metrics(batches: DataFrame, queries: DataFrame) -> DataFrame:
    """Figures of each known query's last batch, 0 on a cold start."""
    last = latest_of(batches, "query").select(
        "query", F.col("lag_seconds").cast("long").alias("lag_seconds"), F.unix_seconds("updated_at").alias("last_batch_at"), (F.col("status") == "success").cast("long").alias("last_batch_success"), F.col("invalid").cast("long").alias("invalid_records")
    )
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("lag_seconds", "last_batch_at", "last_batch_success", "invalid_records")}
    return queries.join(last, "query", "left").withColumns(zero)


def settled(events: DataFrame, column: str, as_of: str, settlement: int = SETTLEMENT) -> DataFrame:
    """Rows before the 5-minute slot of as_of less the settlement, so that late but valid events are already there."""
    end = F.timestamp_seconds(F.floor((F.unix_seconds(F.lit(as_of).cast("timestamp")) - settlement) / 300) * 300)
    return events.filter(F.col(column) < end)
