"""Micro-batches committed exactly once, with late rows in a table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import listed


class BatchSink:
    """A function for ``foreachBatch``: rows go to ``rows/batch_id=N``, late ones to ``late/batch_id=N``, and the mark ``marks/batch_id=N`` commits both.

    A stream that is started again repeats the batch that failed, with the same id and rows; as a batch's folders are
    overwritten and readers only take batches with a mark, no row is lost or doubled. A mark holds the largest event
    time up to its batch. Rows older than that of earlier batches by more than ``delay`` are late; as earlier marks don't
    change, a repeated batch divides its rows the same way. Rows without an event time are late.
    """

    def __init__(self, folder: str, ts: str = "ts", delay: str = "10 minutes"):
        self.folder, self.ts, self.delay = folder, ts, delay

    def committed(self, spark: SparkSession) -> list[int]:
        return sorted(int(f.name.partition("=")[2]) for f in listed(spark, f"{self.folder}/marks") if f.name.startswith("batch_id=") and any(x.name == "_SUCCESS" for x in listed(spark, f"{self.folder}/marks/{f.name}")))

    def mark(self, spark: SparkSession, before: int):
        """The largest event time of all batches below this one, or null."""
        ids = [i for i in self.committed(spark) if i < before]
        return spark.read.parquet(f"{self.folder}/marks/batch_id={ids[-1]}").first()["top"] if ids else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        top = self.mark(spark, batch_id)
        rows = batch.persist()
        try:
            ts = F.col(self.ts)
            late = ts.isNull() if top is None else ts.isNull() | (ts < F.lit(top) - F.expr(f"interval {self.delay}"))
            rows.where(~late).write.mode("overwrite").parquet(f"{self.folder}/rows/batch_id={batch_id}")
            rows.where(late).write.mode("overwrite").parquet(f"{self.folder}/late/batch_id={batch_id}")
            rows.agg(F.greatest(F.max(ts), F.lit(top).cast(dict(batch.dtypes)[self.ts])).alias("top")).write.mode("overwrite").parquet(f"{self.folder}/marks/batch_id={batch_id}")
        finally:
            rows.unpersist()

    def read(self, spark: SparkSession, table: str = "rows") -> DataFrame:
        """Committed rows (or ``late`` ones) with their batch_id."""
        paths = [f"{self.folder}/{table}/batch_id={i}" for i in self.committed(spark)]
        if not paths:
            raise ValueError("no batch has been committed yet")
        return spark.read.option("basePath", f"{self.folder}/{table}").parquet(*paths)
