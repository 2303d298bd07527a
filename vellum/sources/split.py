"""Documents out of raw inputs: splitting, naming, ordered unions, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.text import page_title, pad_left, trim

# Marks that begin a document, tried in this order; how to count them and where to cut.
RULES = (
    (r"(?i)<!DOCTYPE html>", r"(?i)(?=<!DOCTYPE html>)"),
    (r"(?i)<html[\s>]", r"(?i)(?=<html[\s>])"),
    (r"(?i)class\s*=\s*[\"'][^\"']*\bslide-container\b", r"(?i)(?=<div[^>]*class\s*=\s*[\"'][^\"']*\bslide-container\b)"),
)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (path, content) of the .htm and .html files of a folder, not of its subfolders, in name order."""
    return _whole_files(spark, folder, "*.{[hH][tT][mM],[hH][tT][mM][lL]}").orderBy("path")


def _whole_files(spark: SparkSession, path: str, only: str = "*") -> DataFrame:
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", False).option("pathGlobFilter", only).text(path)
    return files.select(F.url_decode("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_inputs(spark: SparkSession, inputs: list[tuple[str, bool]]) -> DataFrame:
    """Rows (input_idx, path, content) of the given (path, is folder): folders give their pages, files of any name, .txt too, themselves."""
    return ordered_union([read_pages(spark, path) if folder else _whole_files(spark, path) for path, folder in inputs])


def pieces(content: Column) -> Column:
    """The documents of a text, in order: the first rule whose mark occurs more than once cuts it."""
    t = trim(F.coalesce(content, F.lit("")))
    parts = F.array(t)
    for mark, cut in reversed(RULES):
        parts = F.when(F.regexp_count(t, F.lit(mark)) > 1, F.split(t, cut)).otherwise(parts)
    return F.filter(F.transform(parts, trim), lambda p: p != "")


def split_documents(df: DataFrame, content: str, name: str) -> DataFrame:
    """Explode inputs into documents with slide_idx (from 0), name and title.

    The name is the file's base name without .htm, .html or .txt, with -NN if the file held
    more than one document.
    """
    base = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?i)\.(html?|txt)$", "")
    parts = df.withColumn("_p", pieces(F.col(content)))
    rows = parts.select("*", F.posexplode("_p").alias("slide_idx", "html"))
    named = F.when(F.size("_p") > 1, F.concat(base, F.lit("-"), pad_left((F.col("slide_idx") + 1).cast("string"), 2))).otherwise(base)
    return rows.withColumn("name", named).withColumn("title", page_title(F.col("html"), F.col("name"))).drop("_p")


def number_documents(df: DataFrame, order: list[str], per: list[str]) -> DataFrame:
    """Name documents slide-NN by their order over all inputs of a job, and title them anew: the fallback is that name."""
    w = Window.partitionBy(*per).orderBy(*order)
    named = df.withColumn("name", F.concat(F.lit("slide-"), pad_left(F.row_number().over(w).cast("string"), 2)))
    return named.withColumn("title", page_title(F.col("html"), F.col("name")))


def ordered_union(inputs: list[DataFrame]) -> DataFrame:
    """Inputs one after the other, with input_idx; columns an input lacks are null."""
    out = None
    for i, df in enumerate(inputs):
        part = df.withColumn("input_idx", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def numbered(df: DataFrame, per: list[str], order: list[str]) -> DataFrame:
    """slide_no, from 0: the place of a slide among all inputs of its job."""
    return df.withColumn("slide_no", (F.row_number().over(Window.partitionBy(*per).orderBy(*order)) - 1).cast("long"))


def readable(df: DataFrame, content: str) -> tuple[DataFrame, DataFrame]:
    """Inputs with content, and error rows for those without."""
    bad = F.col(content).isNull() | (trim(F.col(content)) == "")
    return df.where(~bad), df.where(bad).withColumn("error", F.lit("no content"))
