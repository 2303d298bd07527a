"""Recognised words to text items: gap segments, edge junk, safe replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import squeeze, trim


def flatten_words(df: DataFrame, tree: str) -> DataFrame:
    """Words out of nested blocks, paragraphs and lines (arrays of structs), with line_id and word_idx.

    A line recognised without words counts as one word: its fields of the same names as a word's.
    """
    lines = df.select("*", F.posexplode(tree).alias("_b", "_block")).select("*", F.posexplode("_block.paragraphs").alias("_p", "_para")).select("*", F.posexplode("_para.lines").alias("_l", "_line"))
    line = lines.schema["_line"].dataType
    whole = F.struct(*[(F.col(f"_line.{f.name}") if f.name in line.names else F.lit(None)).cast(f.dataType).alias(f.name) for f in line["words"].dataType.elementType])
    words = lines.select("*", F.posexplode(F.when(F.size("_line.words") > 0, F.col("_line.words")).otherwise(F.array(whole))).alias("word_idx", "word"))
    return words.withColumn("line_id", F.struct("_b", "_p", "_l")).drop(tree, "_block", "_para", "_line", "_b", "_p", "_l")


def keep_line(text: Column, conf: Column) -> Column:
    """Lines with text, without a confidence or with one of 35 or more."""
    return (squeeze(F.coalesce(text, F.lit(""))) != "") & (conf.isNull() | (conf >= 35))


def gap_segments(df: DataFrame, gap: Column, line: list[str], order: str = "word_idx") -> DataFrame:
    """seg, from 0: a new one begins where x0 is more than ``gap`` right of all words before it."""
    w = Window.partitionBy(*line).orderBy(order)
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("x0") - reach > gap, 1).otherwise(0)
    return df.withColumn("_f", fresh).withColumn("seg", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_f")


def gap_width(line_h: Column) -> Column:
    return F.greatest(line_h * 2.2, F.lit(28))


def is_junk(text: Column, conf: Column) -> Column:
    """Short unsure words, and one- or two-letter words with a sign in them."""
    t = trim(text)
    letters = F.length(F.regexp_replace(t, "[^A-Za-z0-9]", ""))
    return ((F.coalesce(conf, F.lit(100)) < 55) & (F.length(t) <= 3)) | ((F.length(t) <= 2) & (letters < F.length(t)))


def trim_junk(df: DataFrame, keys: list[str], order: str = "word_idx") -> DataFrame:
    """Drop junk words at both ends of each segment; those in between stay."""
    w = Window.partitionBy(*keys)
    good = F.when(~is_junk(F.col("text"), F.col("conf")), F.col(order))
    return df.withColumns({"_a": F.min(good).over(w), "_z": F.max(good).over(w)}).where(F.col(order).between(F.col("_a"), F.col("_z"))).drop("_a", "_z")


def segment_items(df: DataFrame, keys: list[str], order: str = "word_idx", line_conf: Column | None = None) -> DataFrame:
    """One text item for each segment: joined text, hull, size 0.78 of the height, mean confidence."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, trim(F.col("text")).alias("t")))), lambda s: s["t"]), " ")
    hull = df.groupBy(*keys).agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("conf").alias("conf"))
    conf = F.coalesce("conf", line_conf) if line_conf is not None else F.col("conf")
    return hull.select(*keys, "text", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), ((F.col("y1") - F.col("y0")) * 0.78).alias("size"), conf.alias("conf"))


def zip_samples(items: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Give items their sampled colours by index: bg (null if there is none), color (default black), and safe."""
    joined = items.join(samples.select(*keys, "bg", "fg"), keys, "left")
    return joined.select(*[items[c] if c not in keys else F.col(c) for c in items.columns], "bg", F.coalesce("fg", F.lit("000000")).alias("color"), (F.col("bg").isNotNull() & (F.col("conf").isNull() | (F.col("conf") >= 65))).alias("safe"))


def page_text(spans: DataFrame, recognised: DataFrame, page: str = "page_id") -> DataFrame:
    """Text items of pages: the spans where a page has 3 or more, else recognised text at half scale."""
    enough = spans.groupBy(page).agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select(page)
    half = recognised.join(enough, page, "left_anti").withColumns({c: F.col(c) / 2 for c in ("x", "y", "w", "h", "size")})
    return spans.join(enough, page, "left_semi").withColumn("ocr", F.lit(False)).unionByName(half.withColumn("ocr", F.lit(True)), allowMissingColumns=True)
