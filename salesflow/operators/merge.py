"""Keyed merges of DataFrames: upsert, insert-if-absent, slowly changing dimensions, surrogate keys.

All take the old table and new rows and return the new table (or its parts); publishing is the
caller's (see salesflow.sources.sinks). NULL keys are equal to each other where said.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesflow.functions.scalar import BEGINNING, FOREVER
from salesflow.session import shared_place


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of the keys of two aliased frames."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order (make it unique: ties flicker otherwise)."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old rows of the same key; NULL key parts never match, as in SQL."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows to add: one of each new key that the old table lacks; NULL keys are equal."""
    fresh = latest(new, keys, order)
    return fresh.alias("n").join(old.select(*keys).alias("o"), same_keys("n", "o", keys), "left_anti")


def numbered(rows: DataFrame, order: list[str], key: str, start: int | Column) -> DataFrame:
    """Dense numbers from start + 1 along an order, without gathering rows in one task: ranges are numbered
    each and shifted by the rows before them. The ranges are written once, as bounds drawn twice need not agree."""
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    spark, path = rows.sparkSession, shared_place(rows.sparkSession, "numbered")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    local = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    # one row for each partition
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    first = start if isinstance(start, Column) else F.lit(start)
    return local.join(F.broadcast(before), "_part").withColumn(key, (first + F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")


def add_keys(old: DataFrame, new: DataFrame, natural: list[str], key: str) -> DataFrame:
    """Rows of `new` with their surrogate key: an old one stays, a new natural key gets the next numbers."""
    top = old.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    known = old.filter(F.col(key) > 0).select(*natural, key)
    kept = new.join(known, natural)
    fresh = numbered(new.join(known, natural, "left_anti"), natural, key, top)
    return kept.unionByName(fresh.select(kept.columns))


def with_unknown(dimension: DataFrame, key: str, **values) -> DataFrame:
    """The dimension with its UNKNOWN member of key 0; unnamed columns are NULL."""
    row = dimension.sparkSession.range(1).select(*((F.lit(0) if f.name == key else F.lit(values.get(f.name))).cast(f.dataType).alias(f.name) for f in dimension.schema))
    return dimension.filter(F.col(key) != 0).unionByName(row)


def scd1(old: DataFrame, new: DataFrame, natural: list[str], key: str) -> DataFrame:
    """Overwrite attributes, keep keys; natural keys missing from `new` stay."""
    keyed = add_keys(old, new, natural, key)
    return old.join(new.select(*natural), natural, "left_anti").unionByName(keyed, allowMissingColumns=True)


def scd2(history: DataFrame, source: DataFrame, natural: list[str], attributes: list[str], load_time: str, key: str) -> DataFrame:
    """History after a load: current rows whose attributes changed are closed at load_time; changed and new
    natural keys get a current row (from 1900 if they have no history). Half-open [from, to). Natural keys
    missing from the source stay current. A repeated load of the same source changes nothing."""
    now, forever = F.lit(load_time).cast("timestamp"), F.lit(FOREVER).cast("timestamp")
    current = history.filter("is_current")
    seen = current.select(*natural, *(F.col(a).alias(f"_old_{a}") for a in attributes))
    versions = history.groupBy(*natural).agg(F.max("version_number").alias("_version"))
    met = source.select(*natural, *attributes).join(seen.withColumn("_seen", F.lit(True)), natural, "left").join(versions, natural, "left")
    differs = reduce(lambda a, b: a | b, (~F.col(a).eqNullSafe(F.col(f"_old_{a}")) for a in attributes))
    due = met.filter(F.col("_seen").isNull() | differs)
    gone = due.filter("_seen").select(*natural).withColumn("_gone", F.lit(True))
    closing = F.col("is_current") & F.coalesce("_gone", F.lit(False))
    closed = history.join(gone, natural, "left").withColumn("effective_to", F.when(closing, now).otherwise(F.col("effective_to"))).withColumn("is_current", F.col("is_current") & ~closing).drop("_gone")
    fresh = due.select(
        *natural,
        *attributes,
        F.when(F.col("_version").isNull(), F.lit(BEGINNING).cast("timestamp")).otherwise(now).alias("effective_from"),
        forever.alias("effective_to"),
        F.lit(True).alias("is_current"),
        (F.coalesce("_version", F.lit(0)) + 1).cast("int").alias("version_number"),
    )
    top = history.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    return closed.unionByName(numbered(fresh, natural, key, top).select(closed.columns))


def empty_history(source: DataFrame, natural: list[str], attributes: list[str], key: str) -> DataFrame:
    """A history without rows."""
    return source.limit(0).select(
        F.lit(0).cast("long").alias(key), *natural, *attributes,
        F.lit(None).cast("timestamp").alias("effective_from"), F.lit(None).cast("timestamp").alias("effective_to"),
        F.lit(True).alias("is_current"), F.lit(1).alias("version_number"),
    )


def point_in_time(facts: DataFrame, history: DataFrame, natural: str, at: str, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Facts with the key of the version valid at their time, 0 on a miss, and the version's columns to carry."""
    spans = history.select(F.col(natural).alias("_natural"), F.col(key).alias("_key"), "effective_from", "effective_to", *carry)
    valid = (F.col(natural) == F.col("_natural")) & (F.col(at) >= F.col("effective_from")) & (F.col(at) < F.col("effective_to"))
    return facts.join(spans, valid, "left").withColumn(key, F.coalesce("_key", F.lit(0).cast("long"))).drop("_natural", "_key", "effective_from", "effective_to")


def change_audit(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """key, old_value, new_value of every row whose column really changed."""
    met = before.select(key, F.col(column).alias("old_value")).join(after.select(key, F.col(column).alias("new_value")), key)
    return met.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
