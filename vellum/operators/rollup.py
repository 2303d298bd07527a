"""Partial summaries that are stored by day and merged for any period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct-count sketch as a power of two (standard error 1.04 / sqrt(2^12), 1.6 %), and size of a quantile sketch (rank error 1.7 %).
DISTINCT_BITS, QUANTILE_SIZE = 12, 200


def states(df: DataFrame, keys: list[str], value: Column, who: Column) -> DataFrame:
    """One row of mergeable states for each key: count, exact sum, least, largest, and sketches of the distinct ``who`` and of the value's distribution."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value.cast("decimal(28,6)")).alias("total"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.hll_sketch_agg(who, F.lit(DISTINCT_BITS)).alias("distinct_sketch"),
        F.kll_sketch_agg_double(value.cast("double"), F.lit(QUANTILE_SIZE)).alias("value_sketch"),
    )


def store(day_states: DataFrame, path: str, day: str = "day") -> None:
    """Write the states of the days given, in place of what those days had; other days stay. Doing it twice changes nothing."""
    day_states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def merge(states: DataFrame, keys: list[str], rollup: bool = False) -> DataFrame:
    """States of coarser keys from finer ones, of any period from its days; with ``rollup`` also all prefixes of the keys."""
    grouped = states.rollup(*keys) if rollup else states.groupBy(*keys)
    return grouped.agg(
        F.sum("n").alias("n"),
        F.sum("total").cast("decimal(28,6)").alias("total"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("value_sketch").alias("value_sketch"),
    )


def figures(states: DataFrame, ranks: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Figures of states: mean, the estimated number of distinct ones and estimated quantiles (array) in place of the sketches."""
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("value_sketch", F.lit(r)) for r in ranks])
    return states.withColumns({"mean": F.col("total").cast("double") / F.col("n"), "distinct": F.hll_sketch_estimate("distinct_sketch"), "quantiles": quantiles}).drop("distinct_sketch", "value_sketch")
