"""Memos, retention, progress and event frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import signature, trim


def ingest_memo(requests: DataFrame, key: list[str], order: str, missing: DataFrame, on: str) -> DataFrame:
    """The first request of each key, without those whose artefacts are missing."""
    first = requests.groupBy(*key).agg(F.min_by(F.struct(*[c for c in requests.columns if c not in key]), order).alias("f")).select(*key, "f.*")
    return first.join(missing.select(on), on, "left_anti")


def retained(df: DataFrame, ts: str, now: Column, days: int = 14) -> DataFrame:
    """Rows not older than ``days``."""
    return df.where(F.col(ts) >= now - F.make_interval(days=F.lit(days)))


def monotone(df: DataFrame, job: str, order: list[str], fraction: str) -> DataFrame:
    """shown: the largest fraction so far, so a bar never goes back."""
    w = Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("shown", F.max(fraction).over(w))


def event_frames(df: DataFrame, stream: str, schema: str) -> DataFrame:
    """Events out of text streams, with frame_idx.

    A frame ends in a blank line; what follows the last one isn't complete yet. Its first data
    line holds JSON; frames without one and malformed JSON are skipped, all other events stay,
    whatever their type and fields.
    """
    chunks = F.split(stream, "\n\n", -1)
    frames = df.select("*", F.posexplode(F.slice(chunks, F.lit(1), F.size(chunks) - 1)).alias("frame_idx", "_f"))
    return parsed_events(frames.drop(stream), schema)


def parsed_events(frames: DataFrame, schema: str) -> DataFrame:
    """The events of frames (column _f): JSON of the first data line, where there is one and it is whole."""
    line = F.get(F.filter(F.split("_f", "\n"), lambda x: x.startswith("data:")), F.lit(0))
    body = frames.withColumn("_d", trim(F.substring(line, 6, 1 << 30)))
    return body.where(F.try_parse_json("_d").isNotNull()).withColumn("event", F.from_json("_d", schema)).drop("_f", "_d")


def source_signature(df: DataFrame, keys: list[str], name: str, content: str) -> DataFrame:
    """A short hash of each group's files, independent of their order."""
    return df.groupBy(*keys).agg(signature(F.collect_list(F.concat(name, content))).alias("signature"))


# Kinds of files that are read here, by their last name; others need programs outside.
READ = ("html", "htm", "txt", "png", "jpg", "jpeg")


def capabilities(files: DataFrame, name: str) -> DataFrame:
    """Per kind of the files given: how many there are, and whether they can be read here."""
    kind = F.coalesce(F.nullif(F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)), F.lit("")), F.lit("none"))
    return files.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.any_value(kind.isin(*READ)).alias("read"))
