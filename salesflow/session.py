"""Spark session defaults: UTC, adaptive execution, ANSI left on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "salesflow", **conf: str) -> SparkSession:
    """A session with the library's settings; extra settings may be given by name (dots as __)."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_place(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder that the cluster names in spark.checkpoint.dir. Only a local master, where
    all tasks share one disk, may do without that setting."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", base := tempfile.mkdtemp(prefix="salesflow-"))
    return f"{base.rstrip('/')}/salesflow-{name}/{uuid.uuid4().hex}"
