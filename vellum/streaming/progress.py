"""Progress streams: the monotone bar as a stateful operator, and windowed event counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def monotone_stream(progress: DataFrame, job: str = "job_id", order: str = "seq", fraction: str = "fraction") -> DataFrame:
    """Per job the largest fraction so far, kept as one number of state."""

    def run(key, batches, state):
        top = state.get[0] if state.exists else float("-inf")
        for pdf in batches:
            pdf = pdf.sort_values(order)
            shown = pdf[fraction].cummax().clip(lower=top)
            top = max(top, float(shown.iloc[-1])) if len(shown) else top
            yield pd.DataFrame({job: pdf[job], order: pdf[order], "shown": shown})
        state.update((top,))

    kinds = dict(progress.dtypes)
    return progress.select(job, order, fraction).groupBy(job).applyInPandasWithState(run, f"{job} {kinds[job]}, {order} {kinds[order]}, shown double", "top double", "append", GroupStateTimeout.NoTimeout)


def activity_windows(events: DataFrame, ts: str = "ts", lateness: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by tumbling window; rows later than the watermark are dropped."""
    out = events.withWatermark(ts, lateness).groupBy(F.window(ts, size).alias("win"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("win.start").alias("start"), "event_type", "n")


def activity_sessions(events: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Session windows of each user: start, end and number of events."""
    out = events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count(F.lit(1)).alias("n"))
    return out.select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
