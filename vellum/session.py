"""A session with the settings the operators expect."""

from __future__ import annotations

import re
import tempfile
from dataclasses import dataclass

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "vellum", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; everything else is left to the cluster."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or what the context was given.

    Where neither is set, a local session, as in tests, gets a temporary folder; on a
    cluster that is an error, since a folder of one machine isn't shared.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vellum-"))
    return folder or sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """This application's own part of the shared folder, for tables that are written and read again."""
    return f"{shared_folder(spark)}/vellum-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a folder or file of any store that Spark reaches; false if there was none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@dataclass(frozen=True)
class Listed:
    """An entry of a folder."""

    name: str
    is_folder: bool
    size: int
    modified: int


def listed(spark: SparkSession, path: str) -> list[Listed]:
    """What is in a folder of any store that Spark reaches; nothing if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return [Listed(f.getPath().getName(), f.isDirectory(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)]


def tasks_for(spark: SparkSession, path: str, each: int = 2 << 20) -> int:
    """How many tasks a table's stored bytes ask for, at ``each`` bytes a task; at least as many as run at once."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // each))


def clean(spark: SparkSession) -> bool:
    """Remove all tables this application wrote to the shared folder. Call it when every result has been stored."""
    return remove(spark, scratch(spark))
