"""Reports and logs as written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def job_report(df: DataFrame, job: str, columns: list[str]) -> DataFrame:
    """One JSON document for each row, keyed by job."""
    return df.select(F.col(job), F.to_json(F.struct(*columns)).alias("report"))


def write_reports(df: DataFrame, path: str, job: str) -> None:
    """Append JSON reports, a folder for each job."""
    df.write.mode("append").partitionBy(job).json(path)


def is_alert(level: Column) -> Column:
    return level.isin("WARN", "ERROR")


def write_logs(df: DataFrame, path: str, ts: str = "ts", level: str = "level") -> None:
    """Append log rows by day; warnings and errors go to a second table as well."""
    dated = df.withColumn("day", F.to_date(ts))
    dated.write.mode("append").partitionBy("day").parquet(f"{path}/all")
    dated.where(is_alert(F.col(level))).write.mode("append").partitionBy("day").parquet(f"{path}/alerts")
