"""Quality gates: each check is a row (check_name, actual, passed); a gate is one aggregate, turned to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.operators.merge import upsert


class QualityError(Exception):
    """A gate has failed checks."""


def as_checks(figures: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """A row for each check of a one-row frame."""
    rows = F.array(*(F.struct(F.lit(n).alias("check_name"), a.cast("double").alias("actual"), p.alias("passed")) for n, a, p in checks))
    return figures.select(F.inline(rows))


def zero(name: str, actual: Column) -> tuple[str, Column, Column]:
    """A check that a number is 0."""
    return name, actual, actual == 0


# The names of the checks in the gates below.


def raw_gate(raw: DataFrame, audit: DataFrame, start: str, end: str, threshold: float) -> DataFrame:
    """DQ01-DQ06 over raw promotions (is_valid, status, updated_at) and one audit row (raw_count, accepted_count, rejected_count)."""
    at = F.col("updated_at")
    outside = at.isNull() | (at < F.lit(start).cast("timestamp")) | (at >= F.lit(end).cast("timestamp"))
    lacking = F.col("is_valid") & (~F.coalesce(F.col("status").isin("active", "inactive"), F.lit(False)) | at.isNull())
    stored = raw.agg(F.count(F.lit(1)).alias("stored"), F.count_if(F.col("is_valid")).alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"), F.count_if(outside).alias("outside"), F.count_if(lacking).alias("lacking"))
    c = F.col
    rate = F.coalesce(F.try_divide(c("rejected_count"), c("raw_count")), F.lit(0.0))
    return as_checks(audit.crossJoin(stored), [
        zero("DQ01_audit_reconciliation", c("accepted_count") + c("rejected_count") - c("raw_count")),
        zero("DQ02_raw_storage_reconciliation", c("stored") - c("raw_count")),
        zero("DQ03_validity_reconciliation", F.abs(c("valid") - c("accepted_count")) + F.abs(c("invalid") - c("rejected_count"))),
        ("DQ04_invalid_rate", rate, rate <= threshold),
        zero("DQ05_incremental_window", c("outside")),
        zero("DQ06_operational_fields", c("lacking")),
    ])


def curated_gate(curated: DataFrame, audited: int | Column, source_rows: int | Column) -> DataFrame:
    """DQ07-DQ11 over curated sales: audit, unique grain, discount, net floor, completeness (if the source has rows)."""
    grain = F.struct("order_id", "item_number", "promotion_id", "promotion_version")
    figures = curated.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct(grain)).alias("repeated"), F.count_if(F.col("discount_amount") < 0).alias("negative"), F.count_if(F.col("net_amount") < F.col("freight_value")).alias("below"))
    c = F.col
    wanted = audited if isinstance(audited, Column) else F.lit(audited)
    source = source_rows if isinstance(source_rows, Column) else F.lit(source_rows)
    return as_checks(figures, [
        zero("DQ07_curated_audit_reconciliation", c("n") - wanted),
        zero("DQ08_unique_curated_grain", c("repeated")),
        zero("DQ09_nonnegative_discount", c("negative")),
        zero("DQ10_net_amount_floor", c("below")),
        zero("DQ11_snapshot_completeness", F.when(source > 0, c("n") - source).otherwise(F.lit(0))),
    ])


def log_gate(minutes: DataFrame, statuses: DataFrame, audit: DataFrame, start: str, end: str) -> DataFrame:
    """LOG_DQ01-LOG_DQ07 over two reports and one audit row (source_count, minute_count, status_count)."""
    c = F.col
    outside = (c("minute_start") < F.lit(start).cast("timestamp")) | (c("minute_start") >= F.lit(end).cast("timestamp"))
    m = minutes.agg(F.count(F.lit(1)).alias("m_rows"), F.coalesce(F.sum("request_count"), F.lit(0)).alias("m_requests"), (F.count(F.lit(1)) - F.countDistinct(F.struct("minute_start", "service"))).alias("m_repeated"), F.count_if(outside).alias("m_outside"))
    s = statuses.agg(F.count(F.lit(1)).alias("s_rows"), F.coalesce(F.sum("request_count"), F.lit(0)).alias("s_requests"), (F.count(F.lit(1)) - F.countDistinct(F.struct("minute_start", "service", "status_code"))).alias("s_repeated"), F.count_if((c("status_code") < 100) | (c("status_code") > 599)).alias("s_bad"))
    off = statuses.groupBy("minute_start", "service").agg(F.sum("percentage").alias("p")).agg(F.count_if(F.abs(c("p") - 100) > 0.01).alias("off"))
    return as_checks(audit.crossJoin(m).crossJoin(s).crossJoin(off), [
        zero("LOG_DQ01_minute_audit", c("m_rows") - c("minute_count")),
        zero("LOG_DQ02_status_audit", c("s_rows") - c("status_count")),
        zero("LOG_DQ03_request_reconciliation", c("m_requests") - c("source_count")),
        zero("LOG_DQ04_status_reconciliation", c("s_requests") - c("source_count")),
        zero("LOG_DQ05_unique_grain", c("m_repeated") + c("s_repeated")),
        zero("LOG_DQ06_valid_domain", c("s_bad") + c("m_outside")),
        zero("LOG_DQ07_status_percentage", c("off")),
    ])


#: Checks that a log report passes before it is published.
LOG_CHECKS = 8


def artifact_gate(spark: SparkSession, markers: int, wanted: int = 2) -> DataFrame:
    """LOG_DQ08: every staged part of a report has its completion marker."""
    return spark.range(1).select(F.lit("LOG_DQ08_staged_markers").alias("check_name"), F.lit(float(markers - wanted)).alias("actual"), F.lit(markers == wanted).alias("passed"))


def v1_gate(curated: DataFrame, raw: DataFrame, accepted: int) -> DataFrame:
    """The five checks of the first promotion pipeline."""
    grain = F.struct("order_id", "item_number", "promotion_id", "promotion_version")
    c = F.col
    figures = curated.agg((F.count(F.lit(1)) - F.countDistinct(grain)).alias("repeated"), F.count_if(c("discount_amount") < 0).alias("negative"), F.count_if(c("discount_amount") > c("item_price")).alias("above"), F.count_if(c("net_amount") < 0).alias("below")).crossJoin(raw.agg(F.count_if(c("is_valid")).alias("valid")))
    return as_checks(figures, [zero("unique_grain", c("repeated")), zero("nonnegative_discount", c("negative")), zero("discount_within_price", c("above")), zero("nonnegative_net", c("below")), zero("accepted_rows", c("valid") - accepted)])


def record(store: DataFrame, run_id: str, checks: DataFrame) -> DataFrame:
    """The check store after a run: results replace earlier ones of the same run and check."""
    return upsert(store, checks.withColumn("run_id", F.lit(run_id)), ["run_id", "check_name"])


def require(checks: DataFrame, expected: int) -> None:
    """Raise unless exactly `expected` checks are there and all passed."""
    rows = checks.select("check_name", "passed").collect()  # a few rows
    failed = sorted(r["check_name"] for r in rows if not r["passed"])
    if failed:
        raise QualityError(f"failed checks: {', '.join(failed)}")
    if len(rows) != expected:
        raise QualityError(f"{len(rows)} checks instead of {expected}")


def check_constraints(table: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """check_name, violations of column constraints, in one pass; NULL does not violate, as in SQL."""
    figures = table.agg(*(F.count_if(~broken).alias(n) for n, broken in constraints.items()))
    return figures.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in constraints))))
