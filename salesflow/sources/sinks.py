"""Writers: partitioned files, load modes, idempotent partitions, gated and atomic publishing.

A published table is Parquet folders, one for each write and partition, and numbered commits that name the folders of a
version: what a write does not touch is named again, not copied. A commit is one step and fails if another writer was
faster, so a crash or a lost race leaves the old table. Parquet cannot overwrite what it reads from.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from salesflow.operators.gates import LOG_CHECKS, QualityError, require
from salesflow.sources.commits import Commits
from salesflow.sources.commits import fs_of as _fs


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def write_partitioned(rows: DataFrame, path: str, by: list[str], formats: tuple[str, ...] = ("parquet", "orc"), mode: str = "errorifexists") -> None:
    """Snappy Parquet and ORC under path/<format>, clustered by their partition columns; a large partition is several files."""
    for fmt in formats:
        rows.hint("rebalance", *by).write.mode(mode).partitionBy(*by).option("compression", "snappy").format(fmt).save(f"{path}/{fmt}")


def write_formats(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """The same rows as CSV, Parquet and ORC."""
    for fmt in ("csv", "parquet", "orc"):
        writer = rows.write.mode("overwrite").option("header", True).option("emptyValue", "").format(fmt)
        (writer.partitionBy(*by) if by else writer).save(f"{path}/{fmt}")


def read_back(spark: SparkSession, path: str, wanted: int, formats: tuple[str, ...] = ("parquet", "orc")) -> None:
    """Raise unless each format holds the wanted number of rows."""
    for fmt in formats:
        if (n := spark.read.format(fmt).load(f"{path}/{fmt}").count()) != wanted:
            raise QualityError(f"{fmt} holds {n} rows, not {wanted}")


def write_report(rows: DataFrame, path: str) -> None:
    """A report of few rows as one JSON file; its completion marker is written last."""
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    rows.sparkSession.range(1).select(F.lit("complete").alias("run_status")).coalesce(1).write.mode("overwrite").json(f"{path}/run_status")


def clear_reports(spark: SparkSession, path: str) -> None:
    """Drop the marker, then the stale report."""
    for part in ("run_status", "report"):
        fs, target = _fs(spark, f"{path}/{part}")
        fs.delete(target, True)


#: The folder level that tells writes apart, and the folders of one partition from which an append rewrites it.
VERSION, MOST_FOLDERS = "publish_version", 32


class Published:
    """One or several tables that are published together: a state {tables: name -> {by, schema, folders, written: folders of
    each write}, facts}."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.commits = spark, path, Commits(spark, f"{path}/commits")
        self.number, state = self.commits.last()
        self.state = state or {"tables": {}, "facts": {}}
        self.had = state is not None

    def _data(self, name: str) -> str:
        return f"{self.path}/data/{name}"

    def folders(self, name: str = "rows") -> list[str]:
        """Folders of the table, `publish_version=.../partition=...`."""
        return self.state["tables"][name]["folders"] if name in self.state["tables"] else []

    def read(self, name: str = "rows", folders: list[str] | None = None, placed: bool = False) -> DataFrame | None:
        """The table, or some of its folders; None if it was never published. placed: with its folder as _folder."""
        if name not in self.state["tables"]:
            return None
        table, folders = self.state["tables"][name], self.folders(name) if folders is None else folders
        schema = StructType.fromJson(table["schema"])
        if not folders:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumn("_folder", F.lit("")) if placed else empty
        base = self._data(name)
        reader = self.spark.read.schema(StructType([*schema.fields, StructField(VERSION, StringType())])).option("basePath", base)
        rows = reader.parquet(*(f"{base}/{f}" for f in self._roots(table, folders)))
        if not placed:
            return rows.drop(VERSION)
        # the folder of a row's file, as the state names it
        depth = len(table["by"]) + 1
        folder = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), f"((?:[^/]+/){{{depth - 1}}}[^/]+)/[^/]+$", 1)
        return rows.withColumn("_folder", folder).drop(VERSION)

    @staticmethod
    def _roots(table: dict, folders: list[str]) -> list[str]:
        """The same folders, in fewer names: one for all of a write whose folders are all wanted."""
        own: dict[str, list[str]] = {}
        for f in folders:
            own.setdefault(f.partition("/")[0], []).append(f)
        return [r for version, fs in own.items() for r in ([version] if len(fs) == table["written"].get(version) else fs)]

    def write(self, rows: DataFrame, name: str = "rows", by: list[str] | None = None) -> tuple[list[str], int]:
        """Write rows into new folders, which no version names yet; the folders and the number of rows."""
        by = self._by(name, by)
        version = f"{VERSION}={uuid.uuid4().hex}"
        place = f"{self._data(name)}/{version}"
        self._written(rows, by).write.partitionBy(*by).parquet(place)
        fs, pattern = _fs(self.spark, place + "/*" * len(by))
        base = len(_fs(self.spark, place)[1].toUri().getPath()) - len(version)
        found = [s.getPath().toUri().getPath()[base:] for s in fs.globStatus(pattern) if s.isDirectory()]
        found = sorted(f for f in found if "=" in f.rsplit("/", 1)[-1])
        n = self.spark.read.schema(rows.schema).parquet(place).count() if found else 0
        return found, n

    @staticmethod
    def _written(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.hint("rebalance", *by) if by else rows

    def _by(self, name: str, by: list[str] | None) -> list[str]:
        known = self.state["tables"].get(name)
        return list(by or []) if by is not None or known is None else known["by"]

    def put(self, name: str, schema: StructType, by: list[str], folders: list[str], new: list[str]) -> None:
        """Name the folders of a table in the next state; new: those just written."""
        versions = {f.partition("/")[0] for f in folders}
        written = {v: n for v, n in self.state["tables"].get(name, {"written": {}})["written"].items() if v in versions}
        written |= {f.partition("/")[0]: len(new) for f in new[:1]}
        self.state["tables"][name] = {"by": by, "schema": schema.jsonValue(), "folders": sorted(folders), "written": written}

    def replace(self, rows: DataFrame, name: str = "rows", by: list[str] | None = None, gone: set[str] | None = None) -> int:
        """Put rows in place of some folders (all by default); the rows written."""
        by, old = self._by(name, by), self.state["tables"].get(name)
        folders, n = self.write(rows, name, by)
        stay = [f for f in self.folders(name) if gone is not None and f not in gone]
        known = StructType.fromJson(old["schema"]) if old and stay else StructType()
        schema = StructType([*known.fields, *(f for f in rows.schema.fields if f.name not in known.names)])
        self.put(name, schema, by, stay + folders, folders)
        return n

    def append(self, rows: DataFrame, name: str = "rows", by: list[str] | None = None) -> int:
        """Add rows; partitions that have become many folders are put together."""
        n = self.replace(rows, name, by, gone=set())
        leaves: dict[str, list[str]] = {}
        for f in self.folders(name):
            leaves.setdefault(f.partition("/")[2], []).append(f)
        many = {f for own in leaves.values() if len(own) > MOST_FOLDERS for f in own}
        if many:
            self.replace(self.read(name, sorted(many)), name, gone=many)
        return n

    def commit(self) -> None:
        """Publish the state, then drop what only old versions name."""
        self.commits.add(self.number + 1, self.state)
        self.number, self.had = self.number + 1, True
        self.clean()

    def clean(self) -> None:
        """Delete old commits and the folders that no kept one names. Folders of a write that is under way are named by no
        commit yet and stay."""
        named = lambda state: {f"{t}/{f}" for t, v in state["tables"].items() for f in v["folders"]}
        gone = set().union(*map(named, self.commits.drop_old()))
        if not gone:
            return
        for n in self.commits.numbers():
            gone -= named(self.commits.read(n))
        for folder in gone:
            fs, at = _fs(self.spark, f"{self.path}/data/{folder}")
            fs.delete(at, True)


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a table, None if nothing is published."""
    return Published(spark, path).read()


def publish(rows: DataFrame, path: str, by: list[str] | None = None) -> int:
    """Replace the table; returns its rows."""
    table = Published(rows.sparkSession, path)
    n = table.replace(rows, by=by or [])
    table.commit()
    return n


def _holders(old: DataFrame, keys: DataFrame, names: list[str]) -> set[str]:
    """Folders that hold a row of some keys: at most as many as the table has."""
    return {r["_folder"] for r in old.join(keys.select(*names).distinct(), names, "left_semi").select("_folder").distinct().collect()}


def load(rows: DataFrame, path: str, mode: str, keys: list[str] | None = None, by: list[str] | None = None) -> int:
    """Load modes: replace, append, fail (if published), merge (by keys: new rows replace old ones; NULL keys never match). Append
    writes the new rows alone; merge also the folders that hold their keys. Returns the table's rows."""
    if mode not in ("replace", "append", "fail", "merge"):
        raise ValueError(f"unknown mode {mode}")
    table = Published(rows.sparkSession, path)
    if mode == "fail" and table.had:
        raise FileExistsError(path)
    if mode == "append" and table.had:
        table.append(rows)
    elif mode == "merge" and table.had:
        names, gone = keys or [], set()
        if names:
            gone = _holders(table.read(placed=True), rows, names)
        kept = table.read(folders=sorted(gone)).join(rows.select(*names).distinct(), names, "left_anti") if gone else None
        table.replace(rows if kept is None else kept.unionByName(rows, allowMissingColumns=True), gone=gone)
    else:
        table.replace(rows, by=by or [])
    table.commit()
    return table.read().count()


def publish_snapshot(staged: DataFrame, path: str, checks: DataFrame, audited: int, accepted: int, expected_checks: int) -> int:
    """Replace a table from staging: no failed check, staged = audited, written = staged; accepted 0 changes nothing."""
    if accepted == 0:
        return 0
    require(checks, expected_checks)
    if (n := staged.count()) != audited:
        raise QualityError(f"{n} staged rows, {audited} audited")
    if (written := publish(staged, path)) != n:
        raise QualityError(f"{written} rows written, {n} staged")
    return written


def replace_window(table: DataFrame, staged: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """The table with [start, end) replaced by the staged rows, which must lie inside."""
    at = F.col(column)
    inside = (at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp"))
    return table.filter(~F.coalesce(inside, F.lit(False))).unionByName(staged.filter(inside))


def markers(spark: SparkSession, staging: str, parts: tuple[str, ...] = ("minutes", "statuses")) -> int:
    """How many staged parts have their completion marker."""
    return sum(exists(spark, f"{staging}/{p}/_SUCCESS") for p in parts)


class WindowReport:
    """A report of several tables whose closed windows are replaced together: one commit publishes the tables, the runs and the
    watermark. Tables are partitioned by `slot`, a text of the window column that sorts as it does; a window rewrites the
    partitions that it meets and no others."""

    SLOT = "_slot"

    def __init__(self, spark: SparkSession, path: str, column: str, pattern: str = "yyyyMMddHH"):
        self.spark, self.path, self.column, self.pattern = spark, path, column, pattern

    def _slot(self, at: Column) -> Column:
        return F.date_format(at, self.pattern)

    def read(self, part: str) -> DataFrame | None:
        """A published table, `runs`, or None if nothing is published."""
        rows = Published(self.spark, self.path).read(part)
        return None if rows is None else rows.drop(self.SLOT)

    def watermark(self) -> datetime | None:
        """The end of the windows published without a gap, None at first."""
        mark = Published(self.spark, self.path).state["facts"].get("watermark")
        return None if mark is None else datetime.fromtimestamp(mark / 1e6)

    def publish(self, run_id: str, start: str, end: str, staged: dict[str, DataFrame], audited: dict[str, int], checks: DataFrame) -> str:
        """Replace [start, end) of every table by its staged rows; 'already' if the run was published before. All checks must
        have passed, and the rows written in the window must be as many as audited. A window that starts at or before the
        watermark moves it forward; an old or distant one leaves it."""
        report = Published(self.spark, self.path)
        runs = report.read("runs")
        if runs is not None and not runs.filter(F.col("run_id") == run_id).isEmpty():
            return "already"
        require(checks, LOG_CHECKS)
        a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
        # one row: the slots that the window meets, and its bounds
        last = b - F.expr("INTERVAL 1 MICROSECOND")
        bounds = self.spark.range(1).select(self._slot(a).alias("first"), self._slot(last).alias("last"), F.unix_micros(a).alias("start"), F.unix_micros(b).alias("end")).first()
        inside = (F.col(self.column) >= a) & (F.col(self.column) < b)
        for part, rows in staged.items():
            met = {f for f in report.folders(part) if bounds["first"] <= f.rsplit("=", 1)[1] <= bounds["last"]}
            new = rows.filter(inside).withColumn(self.SLOT, self._slot(F.col(self.column)))
            if met:
                new = report.read(part, sorted(met)).filter(~F.coalesce(inside, F.lit(False))).unionByName(new)
            report.replace(new, part, [self.SLOT], gone=met)
            if (n := report.read(part).filter(F.col(self.SLOT).between(bounds["first"], bounds["last"]) & inside).count()) != audited[part]:
                raise QualityError(f"{n} rows of {part} written, {audited[part]} audited")
        now = self.spark.range(1).select(F.lit(run_id).alias("run_id"), a.alias("window_start"), b.alias("window_end"), F.lit(sum(audited.values())).cast("long").alias("rows"))
        report.append(now.coalesce(1), "runs", [])
        mark = report.state["facts"].get("watermark")
        if mark is None or bounds["start"] <= mark:
            report.state["facts"]["watermark"] = max(bounds["end"], mark or bounds["end"])
        report.commit()
        return "published"


@contextmanager
def _many_leaves(spark: SparkSession):
    """Small rows of many leaves are still dealt to all tasks: opening files is the work."""
    key = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    old = spark.conf.get(key)
    spark.conf.set(key, "16k")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def overwrite_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that `rows` has: a retried batch rewrites its own leaf. Rows are dealt by leaf first, so that
    a leaf is one file or few; a large leaf is split between tasks."""
    with _many_leaves(rows.sparkSession):
        rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def drop_partitions(spark: SparkSession, path: str, by: list[str], values: dict) -> None:
    """Delete the leaves of some partition columns' values, whatever the other columns of `by` are."""
    fs, pattern = _fs(spark, "/".join([path, *(f"{c}={values[c]}" if c in values else f"{c}=*" for c in by)]))
    for leaf in fs.globStatus(pattern) or []:
        fs.delete(leaf.getPath(), True)


def replace_batch(rows: DataFrame, path: str, by: list[str], own: dict) -> None:
    """Write a batch in place of all that it wrote before: leaves that a shrunk or emptied batch no longer has go too."""
    drop_partitions(rows.sparkSession, path, by, own)
    overwrite_partitions(rows, path, by)


def publish_artifact(spark: SparkSession, staging: str, target: str, parts: tuple[str, ...] = ("minutes", "statuses")) -> str:
    """Move a staged report to its place by one rename. Every part needs its _SUCCESS. Already published and complete:
    'already'. Both there, or staging missing, is an error."""
    complete = lambda base: all(exists(spark, f"{base}/{p}/_SUCCESS") for p in parts)
    staged, done = exists(spark, staging), exists(spark, target)
    if staged and done:
        raise FileExistsError(f"both {staging} and {target} are there")
    if done:
        if not complete(target):
            raise QualityError(f"{target} is not complete")
        return "already"
    if not staged:
        raise FileNotFoundError(staging)
    if not complete(staging):
        raise QualityError(f"{staging} is not complete")
    fs, source = _fs(spark, staging)
    place = _fs(spark, target)[1]
    fs.mkdirs(place.getParent())
    if not fs.rename(source, place):
        raise OSError(f"could not move {staging}")
    return "published"


class Transaction:
    """Insert, update and delete on a published table, published together on commit. Folders without a changed row are kept
    as they are."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = Published(spark, path)
        old = self.table.read(placed=True)
        self.old = None if old is None else old.withColumn("_touched", F.lit(False))
        self.fresh: DataFrame | None = None

    @property
    def rows(self) -> DataFrame | None:
        """The table as the transaction sees it."""
        old = None if self.old is None else self.old.filter("_touched IS NOT NULL").drop("_folder", "_touched")
        return self.fresh if old is None else old if self.fresh is None else old.unionByName(self.fresh)

    def insert(self, rows: DataFrame) -> None:
        self.fresh = rows if self.fresh is None else self.fresh.unionByName(rows)

    def update(self, condition: str, **values: str) -> None:
        hit = F.coalesce(F.expr(condition), F.lit(False))
        new = {c: F.when(hit, F.expr(v)).otherwise(F.col(c)) for c, v in values.items()}
        if self.old is not None:
            # _touched: false, true when changed, NULL when deleted
            self.old = self.old.withColumns(new | {"_touched": F.when(F.col("_touched").isNull(), None).otherwise(F.col("_touched") | hit)})
        if self.fresh is not None:
            self.fresh = self.fresh.withColumns(new)

    def delete(self, condition: str) -> None:
        hit = F.coalesce(F.expr(condition), F.lit(False))
        if self.old is not None:
            self.old = self.old.withColumn("_touched", F.when(~hit, F.col("_touched")))
        if self.fresh is not None:
            self.fresh = self.fresh.filter(~hit)

    def commit(self) -> int:
        """The table's rows after it; Conflict if another writer has published since the transaction began."""
        gone, kept = set(), None
        if self.old is not None:
            touched = F.coalesce("_touched", F.lit(True))
            gone = {r["_folder"] for r in self.old.filter(touched).select("_folder").distinct().collect()}  # at most the table's folders
            kept = self.old.filter(F.col("_touched").isNotNull() & F.col("_folder").isin(*gone)).drop("_folder", "_touched") if gone else None
        new = kept if self.fresh is None else self.fresh if kept is None else kept.unionByName(self.fresh)
        if new is not None:
            self.table.replace(new, gone=gone)
        if new is not None or gone:
            self.table.commit()
        return self.table.read().count()


def write_rejected(rows: DataFrame, path: str) -> DataFrame:
    """Rejected rows with their reasons as a dataset of its own; what was written."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def plan_text(frame: DataFrame) -> str:
    """The physical plan, as text for a report."""
    return frame._jdf.queryExecution().executedPlan().toString()


def save_table(rows: DataFrame, table: str, by: list[str] | None = None) -> None:
    """A managed catalog table, partitioned if wanted, in place of an older one."""
    writer = rows.write.mode("overwrite").format("parquet")
    (writer.partitionBy(*by) if by else writer).saveAsTable(table)


def analyze(spark: SparkSession, table: str, histograms: bool = False) -> None:
    """Collect a catalog table's statistics for the optimizer; with histograms of its columns too, for filters on
    skewed columns. The optimizer uses them where spark.sql.cbo.enabled is on (join order: spark.sql.cbo.joinReorder.enabled)."""
    key = "spark.sql.statistics.histogram.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, str(histograms).lower())
    try:
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
    finally:
        spark.conf.set(key, old)


def column_statistics(spark: SparkSession, table: str) -> DataFrame:
    """column_name, rows, nulls, least, greatest (texts; NULL where none is kept) of an analyzed table, from the catalog."""
    whole = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Statistics'")
    rows = whole.select(F.regexp_extract("data_type", r"(\d+) rows", 1).cast("long").alias("rows"))
    figure = lambda name, out: F.max(F.when(F.col("info_name") == name, F.nullif(F.col("info_value"), F.lit("NULL")))).alias(out)
    columns = [spark.sql(f"DESCRIBE EXTENDED {table} `{c}`").agg(F.lit(c).alias("column_name"), figure("num_nulls", "nulls"), figure("min", "least"), figure("max", "greatest")) for c in spark.table(table).columns]
    return reduce(DataFrame.unionByName, columns).withColumn("nulls", F.col("nulls").cast("long")).crossJoin(rows)
