"""Shared column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that stands for a missing cell, and the ends of an open history.
MISSING_TEXT = ("", "nan", "None", "null")
BEGINNING, FOREVER = "1900-01-01 00:00:00", "9999-12-31 00:00:00"


def clean_text(column: str) -> Column:
    """Trimmed text; stand-ins for a missing cell become NULL."""
    text = F.trim(F.col(column))
    return F.when(~text.isin(*MISSING_TEXT), text)


def hours_between(start: Column, end: Column) -> Column:
    """Signed hours from start to end, 2 decimals, NULL if either is."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)).cast("decimal(28,0)") / F.lit(3_600_000_000).cast("decimal(12,0)"), 2).cast("decimal(18,2)")


def days_between(start: Column, end: Column) -> Column:
    """Signed days from start to end, 2 decimals, NULL if either is."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)).cast("decimal(28,0)") / F.lit(86_400_000_000).cast("decimal(13,0)"), 2).cast("decimal(18,2)")


def date_key(day: Column) -> Column:
    """yyyymmdd as an integer."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def floor_minutes(instant: Column, minutes: int) -> Column:
    """The start of the instant's slot of so many minutes."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(instant) / (60 * minutes)) * (60 * minutes))


def discount(price: Column, kind: Column, value: Column) -> Column:
    """A promotion's discount, capped at the price: percentage, fixed, else nothing."""
    percentage = F.least(price, price * value / F.lit(100))
    amount = F.when(kind == "percentage", percentage).when(kind == "fixed", F.least(price, value)).otherwise(F.lit(0))
    return amount.cast("decimal(12,2)")


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted names; a NULL field is kept, so it differs from a missing one."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def status_group(status: Column) -> Column:
    """Order status in three groups."""
    return F.when(status == "delivered", "completed").when(status.isin("canceled", "unavailable"), "failed").otherwise("in progress")


def payment_group(kind: Column) -> Column:
    """Payment types in four groups."""
    return F.when(kind.isin("credit_card", "debit_card"), "card").when(kind == "boleto", "payment slip").when(kind == "voucher", "voucher").otherwise("unknown")
