"""Small helpers the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import scratch, shared_folder

__all__ = ["cut", "give_back", "map_rows", "row_numbers", "scratch", "shared_folder", "small_batches", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (the folder may be in a store only Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors.

    What led to the checkpoint isn't needed any more; collecting garbage lets Spark's cleaner
    delete its shuffle files now instead of at the end of the session.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, of compressed columns of which readers take what they need."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: unless the session says otherwise, a worker gets 2,000 of them at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "2000")


def give_back() -> None:
    """Return a Python worker's freed memory to the machine.

    Workers outlive their tasks; what their allocators keep would count through later stages.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def map_rows(df: DataFrame, columns: list, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str, start: Callable[[], object] | None = None) -> DataFrame:
    """Apply ``work`` to each Arrow batch of ``columns``; it yields dicts of equally long lists.

    Only the named columns travel to Python, so clashing extra columns of ``df`` don't matter.
    ``start`` runs once in each task and its result is passed as second argument.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def run(batches):
        state = (start(),) if start else ()
        for batch in batches:
            for out in work(batch, *state):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in types], schema=types)
        state = batch = out = None
        give_back()

    return df.select(*columns).mapInArrow(run, schema)


def row_numbers(df: DataFrame, keys: list[str], order: list, bucket: str, name: str) -> DataFrame:
    """Gapless numbers from 0 for the rows of each key, without all rows of a key in one task.

    Rows are numbered inside (keys, ``bucket``) and shifted by the counts of the smaller buckets.
    ``bucket`` is an integer column whose order the numbers follow.
    """
    from pyspark.sql import Window

    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    numbered = df.withColumn("_r", F.row_number().over(inside) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(bucket).eqNullSafe(F.col("_b"))]
    joined = numbered.join(shift, on)
    return joined.withColumn(name, F.col("_r") + F.col("_shift")).drop("_r", "_b", "_shift", *[f"_k{i}" for i in range(len(keys))])
