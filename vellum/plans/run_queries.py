"""Streams in chunks, memos, retention, time joins and mergeable summaries over the shared tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.operators import rollup, temporal
from vellum.plans.fixtures import WORDS, table, words
from vellum.plans.registry import query
from vellum.plans.scalar_queries import LOGS, log_rows
from vellum.session import scratch
from vellum.sources import memo, retention, sinks
from vellum.streaming import frames


def folder(spark, name):
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """with f as (select user_id as stream, row_number() over (partition by user_id order by event_id) - 1 as i, event_id from events)
    select stream, cast(i as int) as frame_idx, case when event_id % 5 = 0 then 'done' else 'progress' end as type, event_id % 9 as done from f where event_id % 4 <> 3"""
)
def sse_chunks(spark, sf_dir):
    """A user's frames, cut somewhere inside: each chunk holds the end of one frame and the start of the next."""
    i = F.col("event_id")
    body = F.concat(F.lit('data: {"type":"'), F.when(i % 5 == 0, "done").otherwise("progress"), F.lit('","done":'), (i % 9).cast("string"), F.when(i % 4 == 3, "").otherwise("}"))
    by = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat(F.lit(": é\n"), body, F.lit("\n\n")).alias("frame")).withColumn("cut", (i % F.length("frame")).cast("int"))
    head, tail = F.substring(F.col("frame"), F.lit(1), F.col("cut")), F.substring(F.col("frame"), F.col("cut") + 1, F.length("frame"))
    parts = e.select("user_id", F.row_number().over(by).alias("seq"), F.concat(tail, F.coalesce(F.lead(head).over(by), F.lit(""))).alias("chunk"), F.when(F.row_number().over(by) == 1, head).alias("first"))
    chunks = parts.select(F.col("user_id").alias("stream"), F.col("seq"), F.concat(F.coalesce("first", F.lit("")), "chunk").alias("chunk"))
    return frames.joined_chunks(chunks, "type string, done long").select("stream", "frame_idx", "event.type", "event.done")


@query("select o_orderkey, p_path as path, case when o_orderkey % 5 = 0 then 2 else 1 end as mtime, o_orderkey % 5 = 0 or o_orderkey % 7 = 0 or o_orderkey % 11 = 0 as redone, case when o_orderkey % 5 = 0 or o_orderkey % 7 = 0 or o_orderkey % 11 = 0 then 2 else 1 end as run from (select o_orderkey, 'in/' || o_orderkey || '.pdf' as p_path from orders where o_orderkey % 11 <> 10)")
def memo_runs(spark, sf_dir):
    """The second of two runs: files that changed or lost a picture are done again, results without pictures are never kept."""
    k = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").where(k % 11 != 10).select(k, F.concat(F.lit("in/"), k.cast("string"), F.lit(".pdf")).alias("path"), k.alias("size"), F.lit("work").alias("work_dir"))
    kept = memo.Memo(spark, folder(spark, "memo"))

    def compute(run):
        def pages(asked):
            number = F.regexp_extract("path", r"(\d+)", 1).cast("long")
            pictures = F.when(number % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat("path", F.lit("-1.png")), F.concat("path", F.lit("-2.png"))))
            return asked.withColumns({"artefacts": pictures, "number": number, "run": F.lit(run)})

        return pages

    first = kept.run(files.withColumn("mtime", F.lit(1)), compute(1))
    present = first.where("number % 7 <> 0").select(F.explode("artefacts").alias("path")).unionByName(first.where("number % 7 = 0").select(F.get("artefacts", F.lit(0)).alias("path")))
    again = kept.run(files.withColumn("mtime", F.when(k % 5 == 0, 2).otherwise(1)), compute(2), present)
    return again.select(F.col("number").alias("o_orderkey"), "path", "mtime", "redone", "run")


@query(f"with {LOGS}, m as (select max(ts) as now from logs), l as (select cast(ts as date) as d, level from logs, m where cast(ts as date) + interval 1 day > now - interval 14 day) select cast(d as varchar) as day, 'all' as part, count(*) as n from l group by 1 union all select cast(d as varchar), 'alerts', count(*) from l where level in ('WARN', 'ERROR') group by 1")
def retention_days(spark, sf_dir):
    """Logs written by day; old days removed, twice; what is left, read back."""
    logs, at = log_rows(spark, sf_dir), folder(spark, "kept-logs")
    sinks.write_logs(logs, at)
    now = logs.agg(F.max("ts").cast("string")).first()[0]
    retention.prune_days(spark, at, datetime.datetime.fromisoformat(now))
    retention.prune_days(spark, at, datetime.datetime.fromisoformat(now))
    parts = [spark.read.parquet(f"{at}/{p}").groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")).select("day", F.lit(p).alias("part"), "n") for p in ("all", "alerts")]
    return parts[0].unionByName(parts[1])


@query(f"with {WORDS} select p.line_id, p.word_idx, i.word_idx as phase_idx from words p join words i on p.line_id = i.line_id and i.word_idx % 3 = 0 and p.x0 >= i.x0 and p.x0 < i.x0 + (i.x1 - i.x0) * (1 + i.word_idx % 40)")
def phase_of_line(spark, sf_dir):
    """Each log line of a user with the phases of the user's jobs, short and long, that it falls into."""
    w = words(spark, sf_dir)
    phases = w.where("word_idx % 3 = 0").select("line_id", F.col("word_idx").alias("phase_idx"), F.col("x0").alias("begin"), (F.col("x0") + (F.col("x1") - F.col("x0")) * (1 + F.col("word_idx") % 40)).alias("end"))
    return temporal.interval_join(w.select("line_id", "word_idx", "x0"), phases, ["line_id"], "x0", "begin", "end").select("line_id", "word_idx", "phase_idx")


@query(f"with {WORDS}, r as (select line_id, x0, max(conf) as conf, max(word_idx) as idx from words where word_idx % 5 = 0 group by all) select w.line_id, w.word_idx, r.x0 as seen_at, r.conf as seen from words w asof left join r on w.line_id = r.line_id and w.x0 >= r.x0 where w.word_idx % 5 <> 0")
def last_reading(spark, sf_dir):
    """For each word the last reading of its line at or before it."""
    w = words(spark, sf_dir)
    readings = w.where("word_idx % 5 = 0").groupBy("line_id", "x0").agg(F.max("conf").alias("seen")).withColumn("seen_at", F.col("x0"))
    found = temporal.as_of_join(w.where("word_idx % 5 <> 0").select("line_id", "word_idx", "x0"), readings, ["line_id"], "x0", ["seen_at", "seen"], 86_400)
    return found.select("line_id", "word_idx", "seen_at", "seen")


@query(
    """with e as (select cast(date_trunc('month', ts) as date) as month, event_type, cast(value as decimal(28,6)) as v, value, user_id from events)
    select cast(month as varchar) as month, event_type, count(*) as n, cast(round(sum(v), 2) as double) as total, min(value) as least, max(value) as most, true as distinct_close, true as median_close from e group by rollup(month, event_type)"""
)
def period_rollup(spark, sf_dir):
    """States stored by day, one day written twice, merged to months, kinds and all; sketches stay within their error."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    value, at = F.col("value"), folder(spark, "day-states")
    daily = rollup.states(e, ["day", "event_type"], value, F.col("user_id"))
    rollup.store(daily, at)
    rollup.store(daily.where(F.dayofmonth("day") == 1), at)
    stored = spark.read.parquet(at).withColumn("month", F.trunc("day", "month"))
    merged = rollup.figures(rollup.merge(stored, ["month", "event_type"], rollup=True))
    # the exact figures next to them: users, and how many values lie below the estimated median
    exact = e.withColumn("month", F.trunc("day", "month")).rollup("month", "event_type").agg(F.count_distinct("user_id").alias("users"), F.percentile("value", [0.45, 0.55]).alias("near_median"))
    same = F.col("m.month").eqNullSafe(F.col("x.month")) & F.col("m.event_type").eqNullSafe(F.col("x.event_type"))
    both = merged.alias("m").join(exact.alias("x"), same)
    close = (F.abs(F.col("distinct") - F.col("users")) <= 0.08 * F.col("users") + 1).alias("distinct_close")
    median = F.col("quantiles")[0].between(F.col("near_median")[0], F.col("near_median")[1]).alias("median_close")
    return both.select(F.col("m.month").cast("string").alias("month"), "m.event_type", "n", F.round("total", 2).cast("double").alias("total"), "least", "most", close, median)
