"""Interval and as-of joins as equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(keys: list[str], a: str, b: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, stop: str) -> DataFrame:
    """Each point with each interval [start, stop) of its key that holds it; the columns of both, the key once.

    Times are whole numbers. An interval lies in the at most two cells of the finest power of two that is no shorter;
    a point looks into one cell of each power in use, at most 64. So long intervals aren't copied, a pair meets
    once, and the points of one busy key are dealt over its cells. Intervals that are empty or have a null end hold nothing.
    """
    length = F.col(stop) - F.col(start)
    level = F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))
    kept = intervals.where(F.col(start).isNotNull() & (length > 0)).withColumn("_level", level.cast("int"))
    levels = sorted(r[0] for r in kept.select("_level").distinct().collect())  # at most 64 numbers
    cell = lambda c: F.call_function("shiftright", c, F.col("_level"))
    first, last = cell(F.col(start)), cell(F.col(stop) - 1)
    there = kept.withColumn("_cell", F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))))
    asked = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(i) for i in levels]).cast("array<int>"))).withColumn("_cell", cell(F.col(at).cast("long")))
    there = there.withColumn("_cell", F.col("_cell").cast("long"))
    on = _same([*keys, "_level", "_cell"], "p", "i") & (F.col(f"p.{at}") >= F.col(f"i.{start}")) & (F.col(f"p.{at}") < F.col(f"i.{stop}"))
    own = [F.col(f"i.{c}") for c in intervals.columns if c not in keys]
    return asked.alias("p").join(there.alias("i"), on).select(*[F.col(f"p.{c}") for c in points.columns], *own)


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], width: int) -> DataFrame:
    """Add to each left row the ``values`` of the last right row of its key at or before its time; null if there is none.

    Both sides become one table and the value a running last one, so nothing is multiplied. Windows are over stretches of
    ``width`` of a key's time, so a busy key isn't one task's; the last value of each stretch is carried to the
    later ones over a table with a row a stretch. Of right rows of one time the largest values count. Rows with a null time get null.
    """
    value, types = F.struct(*values), right.select(F.struct(*values)).schema[0].dataType
    bin_of = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    rows = left.select(F.struct(*left.columns).alias("_row"), *keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(types).alias("_v"))
    there = right.where(F.col(at).isNotNull()).select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), *keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), value.alias("_v"))
    both = rows.unionByName(there).withColumn("_bin", bin_of("_at"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = both.withColumn("_last", F.last("_v", True).over(inside))
    ends = both.where("_bin is not null").groupBy(*keys, "_bin").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.struct("_at", "_v"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.last("_end", True).over(before)).drop("_end")
    joined = run.where("_side = 1").alias("p").join(carried.alias("i"), _same([*keys, "_bin"], "p", "i"), "left")
    found = F.when(F.col("p._at").isNotNull(), F.coalesce("p._last", "i._carry"))
    return joined.select("p._row.*", *[found[v].alias(v) for v in values])
