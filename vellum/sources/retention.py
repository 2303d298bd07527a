"""Retention that deletes: whole day partitions, and loose files by age. Both can be repeated."""

from __future__ import annotations

import datetime

from pyspark.sql import SparkSession

from vellum.session import listed, remove

DAYS = 14


def prune_days(spark: SparkSession, folder: str, now: datetime.datetime, days: int = DAYS) -> list[str]:
    """Remove the partitions ``<table>/day=...`` whose day ended before now less ``days``; gives their paths.

    Only partition names are listed, no data is read. A day that reaches into the time kept stays whole. What a killed run
    left is removed by the next; a second run finds nothing.
    """
    gone = []
    for table in listed(spark, folder):
        for part in listed(spark, f"{folder}/{table.name}") if table.is_folder else []:
            name, _, day = part.name.partition("=")
            if name != "day" or not part.is_folder:
                continue
            try:
                ended = datetime.datetime.fromisoformat(day) + datetime.timedelta(days=1)
            except ValueError:  # the partition of rows without a day
                continue
            if ended <= now - datetime.timedelta(days=days):
                path = f"{folder}/{table.name}/{part.name}"
                remove(spark, path)
                gone.append(path)
    return sorted(gone)


def prune_files(spark: SparkSession, folders: list[str], now_ms: int, days: int = DAYS) -> list[str]:
    """Remove the files directly in the folders that were last changed before now less ``days``; folders in them stay. A folder that isn't there has none."""
    gone = []
    for folder in folders:
        for f in listed(spark, folder):
            if not f.is_folder and f.modified < now_ms - days * 86_400_000:
                remove(spark, f"{folder}/{f.name}")
                gone.append(f"{folder}/{f.name}")
    return sorted(gone)
