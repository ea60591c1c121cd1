"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that lines and words are cut at and stripped of.
WHITE = " \t\n\x0b\x0c\r"

#: Characters of text that a Python task handles at once.
SLICE_CHARS = 4_000_000

#: Rows that a Python task sends at once.
SENT_ROWS = 1 << 16

_SHIPPED: dict[str, str] = {}
_SCRATCH: set[str] = set()
_MADE: list[list[str]] = []


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application (they may not share the driver's path)."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp(prefix="salesflow-")  # read by the driver's file server only
        atexit.register(shutil.rmtree, folder, True)
        with zipfile.ZipFile(archive := os.path.join(folder, "salesflow_llm.zip"), "w") as out:
            for path in sorted((root / "salesflow" / "llm").glob("*.py")) + [root / "salesflow" / "__init__.py"]:
                out.write(path, path.relative_to(root))
        context.addPyFile(archive)
        _SHIPPED[context.applicationId] = archive


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder that the cluster names in spark.checkpoint.dir; the application's
    folder is deleted when its driver ends."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="salesflow-scratch-")  # one machine: tests
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, True)
    own = f"{base.rstrip('/')}/salesflow/{spark.sparkContext.applicationId}"
    if own not in _SCRATCH:
        _SCRATCH.add(own)
        atexit.register(_remove, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have ended before
        context = spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def saved(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table that several later steps read, cutting its lineage; survives lost executors."""
    path = scratch(df.sparkSession)
    for names in _MADE:
        names.append(path)
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def made() -> Iterator[list[str]]:
    """Paths of the tables that are saved meanwhile."""
    names: list[str] = []
    _MADE.append(names)
    try:
        yield names
    finally:
        _MADE[:] = [m for m in _MADE if m is not names]


def drop(spark: SparkSession, paths: list[str], unless: DataFrame | None = None) -> list[str]:
    """Delete saved tables, but for those whose files a frame still reads; these are returned."""
    read = unless.inputFiles() if unless is not None and paths else []
    kept = [p for p in paths if any(p.rsplit("/", 1)[1] in f for f in read)]
    for path in paths:
        if path not in kept:
            _remove(spark, path)
    return kept


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The made frame as a saved table, without the tables that were saved on the way to it."""
    with made() as tables:
        out = saved(make())
    drop(out.sparkSession, tables, out)
    return out


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def as_row(docs: DataFrame) -> Column:
    """All columns of a frame as one struct `row`, so that added columns cannot clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def slices(batch, column: str = "text"):
    """(first, last) row bounds of an Arrow batch with about SLICE_CHARS of text each."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(ends):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE_CHARS, "right")))
        yield first, last
        first = last


def in_parts(batch):
    """An Arrow batch as batches of SENT_ROWS at most: the executor holds the one it is sent whole, outside its heap."""
    for first in range(0, batch.num_rows, SENT_ROWS):
        yield batch.slice(first, SENT_ROWS)
