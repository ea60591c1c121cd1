"""File scans: header checks, permissive and typed CSV, table specs, layouts, file metrics."""

from __future__ import annotations

import csv
import io
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from salesflow.functions.scalar import clean_text


def validate_header(spark: SparkSession, path: str, required: list[str]) -> list[str]:
    """The header's names; an error lists missing columns and duplicate names. Reads the raw first line, as
    Spark renames duplicates."""
    first = spark.read.text(path).limit(1).collect()
    names = next(csv.reader(io.StringIO(first[0]["value"].lstrip("﻿"))), []) if first else []
    missing = [c for c in required if c not in names]
    twice = sorted(n for n, k in Counter(names).items() if k > 1)
    if missing or twice:
        raise ValueError(f"{path}: missing columns {missing}, duplicate columns {twice}")
    return names


def read_permissive_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-string rows; a malformed line is kept in _corrupt_record; _source_file names its file."""
    validate_header(spark, path, columns)
    schema = ", ".join(f"{c} string" for c in [*columns, "_corrupt_record"])
    # with columns pruned, a reader that leaves some out would not see that a line has too many or too few cells
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnPruning", False)
    rows = reader.option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)
    return rows.select("*", F.col("_metadata.file_path").alias("_source_file"))


def read_typed_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Typed rows after a header check."""
    validate_header(spark, path, schema.fieldNames())
    return spark.read.schema(schema).option("header", True).csv(path)


@dataclass(frozen=True)
class TableSpec:
    """The roles of a raw table's columns; anything else is text."""

    key: tuple[str, ...]
    integers: tuple[str, ...] = ()
    doubles: tuple[str, ...] = ()
    decimals: tuple[str, ...] = ()
    timestamps: tuple[str, ...] = ()
    renames: dict[str, str] = field(default_factory=dict)


#: The raw tables of the retail source, their columns' names (two misspelt there) and roles.
TABLES = {
    "customers": TableSpec(("customer_id",)),
    "geolocation": TableSpec(("geolocation_zip_code_prefix",), doubles=("geolocation_lat", "geolocation_lng")),
    "order_items": TableSpec(("order_id", "order_item_id"), integers=("order_item_id",), decimals=("price", "freight_value"), timestamps=("shipping_limit_date",)),
    "order_payments": TableSpec(("order_id", "payment_sequential"), integers=("payment_sequential", "payment_installments"), decimals=("payment_value",)),
    "order_reviews": TableSpec(("review_id", "order_id"), integers=("review_score",), timestamps=("review_creation_date", "review_answer_timestamp")),
    "orders": TableSpec(("order_id",), timestamps=("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date")),
    "products": TableSpec(
        ("product_id",),
        integers=("product_name_length", "product_description_length", "product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"),
        renames={"product_name_lenght": "product_name_length", "product_description_lenght": "product_description_length"},
    ),
    "sellers": TableSpec(("seller_id",)),
    "category_translation": TableSpec(("product_category_name",)),
}


def clean_table(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """Typed, cleaned columns of a raw all-text table; a cell that cannot be read becomes NULL."""
    renamed = raw.withColumnsRenamed(spec.renames)
    kinds = {c: "int" for c in spec.integers} | {c: "double" for c in spec.doubles} | {c: "decimal(20,6)" for c in spec.decimals}
    out = []
    for c in renamed.columns:
        text = clean_text(c)
        if c in spec.timestamps:
            out.append(F.try_to_timestamp(text).alias(c))
        elif c in spec.decimals:
            out.append(F.round(text.try_cast("decimal(20,6)"), 2).cast("decimal(12,2)").alias(c))
        elif c in spec.integers:  # "3.0" counts as 3
            out.append(text.try_cast("double").try_cast("int").alias(c))
        else:
            out.append((text.try_cast(kinds[c]) if c in kinds else text).alias(c))
    return renamed.select(*out)


def sample_head(rows: DataFrame, n: int | None) -> DataFrame:
    """The first n rows, all if n is None."""
    return rows if n is None else rows.limit(n)


def read_format(spark: SparkSession, fmt: str, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet, ORC or CSV with header."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("header", True).format(fmt).load(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; the schema is inferred if none is given."""
    return (spark.read if schema is None else spark.read.schema(schema)).json(path)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in any store that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [] if found is None else sorted(s.getPath().toString() for s in found)


def read_layouts(spark: SparkSession, base: str, patterns: list[str]) -> DataFrame:
    """Every directory layout that exists under `base`, united by name with missing columns NULL; error if none."""
    parts = [spark.read.option("basePath", base).parquet(*found) for p in patterns if (found := glob(spark, f"{base.rstrip('/')}/{p}"))]
    if not parts:
        raise FileNotFoundError(f"no layout of {patterns} under {base}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def file_metrics(spark: SparkSession, path: str) -> DataFrame:
    """bytes, files, smallest, largest of a dataset's files; names that start with _ or . do not count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    shown = files.filter(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]"))
    return shown.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files"), F.min("length").alias("smallest"), F.max("length").alias("largest"))


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with inferred types: for small report inputs only, as it reads the file twice."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def missing_tables(spark: SparkSession, base: str, required: list[str]) -> list[str]:
    """The required tables that have no folder under `base` and no entry in the catalog."""
    return [t for t in required if not glob(spark, f"{base.rstrip('/')}/{t}") and not spark.catalog.tableExists(t)]
