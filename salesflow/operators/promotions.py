"""Promotions: contract, raw ingest, version choice, validity join, curated sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesflow.functions.rules import all_reasons, promotion_rules
from salesflow.functions.scalar import canonical_hash, discount
from salesflow.operators.merge import latest

FIELDS = ["promotion_id", "product_id", "promotion_name", "discount_type", "discount_value", "starts_at", "ends_at", "status", "version", "updated_at"]


def classify_batch(records: DataFrame, version: int = 2) -> DataFrame:
    """Records (record_index and the fields as strings) with payload_hash, is_valid and validation_error.
    A payload repeated in the batch is valid once, at its first index."""
    fields = [c for c in FIELDS if c in records.columns]
    hashed = records.withColumn("payload_hash", canonical_hash(*fields))
    nth = F.row_number().over(Window.partitionBy("promotion_id", "payload_hash").orderBy("record_index"))
    rules = all_reasons(promotion_rules(version))
    repeated = F.when(F.col("_nth") > 1, F.lit("duplicate payload in the batch"))
    error = F.concat_ws("; ", F.when(rules != "", rules), repeated)
    return hashed.withColumn("_nth", nth).withColumn("validation_error", F.when(error != "", error)).withColumn("is_valid", F.col("validation_error").isNull()).drop("_nth")


def typed(records: DataFrame) -> DataFrame:
    """Valid records with their types."""
    kinds = {"discount_value": "decimal(12,2)", "starts_at": "timestamp", "ends_at": "timestamp", "version": "int", "updated_at": "timestamp"}
    return records.select(*(F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in FIELDS if c in records.columns))


def latest_version(promotions: DataFrame) -> DataFrame:
    """The highest version of each promotion; ties by updated_at, then by all else."""
    rest = [F.col(c).desc_nulls_last() for c in promotions.columns if c not in ("promotion_id", "version", "updated_at")]
    return latest(promotions, ["promotion_id"], [F.desc("version"), F.col("updated_at").desc_nulls_last(), *rest])


def latest_active(promotions: DataFrame) -> DataFrame:
    """The newest record of each promotion if it is active: an inactive newest one removes the promotion."""
    rest = [F.col(c).desc_nulls_last() for c in promotions.columns if c not in ("promotion_id", "updated_at")]
    newest = latest(promotions, ["promotion_id"], [F.col("updated_at").desc_nulls_last(), *rest])
    return newest.filter("status = 'active'")


def apply_promotions(sales: DataFrame, promotions: DataFrame) -> DataFrame:
    """Sales with each promotion valid on their day (both ends count), discount and net amount. Two
    overlapping promotions give two rows, which the completeness check then reports."""
    p = promotions.select(F.col("product_id").alias("_product"), "promotion_id", F.col("version").alias("promotion_version"), "discount_type", "discount_value", F.to_date("starts_at").alias("_from"), F.to_date("ends_at").alias("_to"))
    valid = (F.col("product_id") == F.col("_product")) & F.col("purchase_date").between(F.col("_from"), F.col("_to"))
    met = sales.join(p, valid, "left")
    amount = discount(F.col("item_price"), F.col("discount_type"), F.col("discount_value"))
    gross = (F.col("item_price") + F.col("freight_value")).cast("decimal(12,2)")
    return met.select(
        *sales.columns,
        F.coalesce("promotion_id", F.lit("NO_PROMOTION")).alias("promotion_id"), F.coalesce("promotion_version", F.lit(0)).alias("promotion_version"), F.coalesce("discount_type", F.lit("none")).alias("discount_type"),
        amount.alias("discount_amount"), gross.alias("gross_amount"), (gross - amount).cast("decimal(12,2)").alias("net_amount"),
    )


def curated_extract(fact: DataFrame, products: DataFrame, dates: DataFrame) -> DataFrame:
    """The sales that promotions apply to: items of known products (the UNKNOWN member has key 0, so its items are
    dropped at the scan of the fact) with their product_id and purchase date, NULL if that day is not in the calendar."""
    known = fact.filter("product_key <> 0").join(products.filter("product_key <> 0").select("product_key", "product_id"), "product_key")
    days = dates.select(F.col("date_key").alias("purchase_date_key"), F.col("full_date").alias("purchase_date"))
    return known.join(days, "purchase_date_key", "left").select("order_id", "item_number", "product_id", "purchase_date", F.col("price").alias("item_price"), "freight_value")


def product_report(products: DataFrame, promotions: DataFrame) -> DataFrame:
    """Products with the latest version of their promotions, no date rule."""
    return products.join(latest_version(promotions).select("product_id", "promotion_id", "discount_type", "discount_value"), "product_id", "left").withColumn("promotion_id", F.coalesce("promotion_id", F.lit("NO_PROMOTION")))


def window_of(promotions: DataFrame, start: str, end: str) -> DataFrame:
    """Records updated in [start, end)."""
    at = F.col("updated_at")
    return promotions.filter((at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp")))
