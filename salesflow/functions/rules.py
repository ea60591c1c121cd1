"""Row rules: a rule names a reason and says when a row breaks it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`broken` is true for rows that break the rule; NULL counts as not broken."""

    reason: str
    broken: Column


def blank(column: str) -> Column:
    """NULL or empty."""
    return F.col(column).isNull() | (F.length(F.col(column)) == 0)


def all_reasons(rules: list[Rule], separator: str = "; ") -> Column:
    """Every broken rule's reason in order, '' if none."""
    return F.concat_ws(separator, *(F.when(r.broken, F.lit(r.reason)) for r in rules))


def first_reason(rules: list[Rule]) -> Column:
    """The first broken rule's reason, NULL if none."""
    return F.coalesce(*(F.when(r.broken, F.lit(r.reason)) for r in rules))


def split(checked: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows of a frame whose column `reason` is NULL or '' when a row is valid."""
    ok = F.coalesce(F.col(reason), F.lit("")) == ""
    return checked.filter(ok).drop(reason), checked.filter(~ok)


def sales_rules(corrupt: str | None = "_corrupt_record") -> list[Rule]:
    """The nine rules of a raw sale, over typed columns."""
    rules = [Rule("malformed row", F.col(corrupt).isNotNull())] if corrupt else []
    return rules + [
        Rule("order_id is empty", blank("order_id")),
        Rule("order_date is not yyyy-MM-dd", F.col("order_date").isNull()),
        Rule("customer_id is empty", blank("customer_id")),
        Rule("product_id is empty", blank("product_id")),
        Rule("category is empty", blank("category")),
        Rule("quantity must be > 0", F.col("quantity").isNull() | (F.col("quantity") <= 0)),
        Rule("unit_price must be >= 0", F.col("unit_price").isNull() | (F.col("unit_price") < 0)),
        Rule("region is empty", blank("region")),
    ]


def promotion_rules(version: int = 2) -> list[Rule]:
    """The promotion contract over string columns; version 2 adds status and updated_at."""
    value, number = F.expr("try_cast(discount_value AS DOUBLE)"), F.expr("try_cast(version AS INT)")
    start, end = F.try_to_timestamp("starts_at"), F.try_to_timestamp("ends_at")
    required = ["promotion_id", "product_id", "discount_type", "discount_value", "starts_at", "ends_at", "version"]
    rules = [Rule(f"{c} is required", blank(c)) for c in required] + [
        Rule("discount_type is unknown", ~blank("discount_type") & ~F.col("discount_type").isin("percentage", "fixed")),
        Rule("discount_value is negative", value < 0),
        Rule("percentage is over 100", (F.col("discount_type") == "percentage") & (value > 100)),
        Rule("discount_value is not a number", ~blank("discount_value") & value.isNull()),
        Rule("starts_at is after ends_at", start > end),
        Rule("time is not ISO-8601", (~blank("starts_at") & start.isNull()) | (~blank("ends_at") & end.isNull())),
        Rule("version must be >= 1", number < 1),
        Rule("version is not an integer", ~blank("version") & number.isNull()),
    ]
    if version >= 2:
        rules += [
            Rule("status is required", blank("status")),
            Rule("status must be active or inactive", ~blank("status") & ~F.col("status").isin("active", "inactive")),
            Rule("updated_at is required", blank("updated_at")),
            Rule("updated_at is not ISO-8601", ~blank("updated_at") & F.try_to_timestamp("updated_at").isNull()),
        ]
    return rules


#: Methods of the two log contracts, and the bounds of a status code.
METHODS_V1 = ("GET", "POST", "PUT", "PATCH", "DELETE")
METHODS_V2 = (*METHODS_V1, "HEAD", "OPTIONS")
STATUS_LOW, STATUS_HIGH = 100, 599


def bad_status() -> Column:
    return F.col("status_code").isNull() | ~F.col("status_code").between(STATUS_LOW, STATUS_HIGH)


def log_rules_v1() -> list[Rule]:
    """First contract: one prioritised reason; raw_json holds the event as it came."""
    # fixed values: the reasons and their order
    return [
        Rule("malformed_json", F.col("raw_json").isNull() | F.get_json_object("raw_json", "$").isNull()),
        Rule("invalid_or_missing_ts", F.col("event_time").isNull()),
        Rule("missing_service", blank("service")),
        Rule("invalid_method", F.col("method").isNull() | ~F.col("method").isin(*METHODS_V1)),
        Rule("missing_path", blank("path")),
        Rule("invalid_status_code", bad_status()),
        Rule("invalid_latency_ms", F.col("latency_ms").isNull() | (F.col("latency_ms") < 0)),
    ]


def log_rules_v2(max_delay_seconds: int) -> list[Rule]:
    """Second contract: every reason, and events landing too late are invalid (but kept)."""
    late = F.col("event_time") < F.col("landed_at") - F.make_interval(secs=F.lit(max_delay_seconds))
    return [
        Rule("event_id is required", blank("event_id")),
        Rule("event_time is invalid", F.col("event_time").isNull()),
        Rule("service is required", blank("service")),
        Rule("method is invalid", blank("method") | ~F.col("method").isin(*METHODS_V2)),
        Rule("path is required", blank("path")),
        Rule("status_code is invalid", bad_status()),
        Rule("latency_ms is required", F.col("latency_ms").isNull()),
        Rule("latency_ms is negative", F.col("latency_ms") < 0),
        Rule("event is later than allowed", late),
    ]
