"""Inputs of the queries, derived from the shared tables by the same rule in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.session import tasks_for

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str, each: int = 2 << 20) -> DataFrame:
    """One order is a slide, its lines are elements.

    Lines are dealt by slide once, to as many tasks as the table's bytes ask for, at ``each`` a task: what follows by slide stays
    where it is, and a task's sorts don't grow with the table.
    """
    tasks = tasks_for(spark, f"{sf_dir}/lineitem.parquet", each)
    li = table(spark, sf_dir, "lineitem").repartition(tasks, "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return li.select(
        F.col("l_orderkey").alias("slide_idx"),
        (F.row_number().over(w) - 1).alias("elem_idx"),
        F.when(F.col("l_returnflag") == "A", "image").when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "native-shape").otherwise("native-text").alias("strategy"),
        (F.col("l_partkey") % 1280).cast("int").alias("x"),
        (F.col("l_suppkey") * 7 % 720).cast("int").alias("y"),
        (F.col("l_quantity").cast("int") * 20).alias("w"),
        (F.col("l_quantity").cast("int") * 12).alias("h"),
        (10 + F.col("l_partkey") % 20).cast("int").alias("size"),
        (F.col("l_tax") >= 0.08).alias("clipped"),
        (F.col("l_linenumber") % 3).cast("int").alias("z"),
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
    )


BOXES = """boxes as (select l_orderkey as slide_idx,
  row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate) - 1 as elem_idx,
  case when l_returnflag = 'A' then 'image' when l_returnflag = 'N' and l_linestatus = 'O' then 'native-shape' else 'native-text' end as strategy,
  cast(l_partkey % 1280 as int) as x, cast(l_suppkey * 7 % 720 as int) as y,
  cast(l_quantity as int) * 20 as w, cast(l_quantity as int) * 12 as h,
  cast(10 + l_partkey % 20 as int) as size, l_tax >= 0.08 as clipped, cast(l_linenumber % 3 as int) as z,
  l_partkey, l_suppkey, l_linenumber from lineitem)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user is a recognised line; seconds stand for pixels."""
    ev = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sec = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1000000).cast("long")
    base = ev.select(F.col("user_id").alias("line_id"), (F.row_number().over(w) - 1).alias("word_idx"), F.col("event_type").alias("text"), F.floor("value").cast("long").alias("v"), sec.alias("x0"))
    return base.select("line_id", "word_idx", "text", (F.col("v") % 100).alias("conf"), "x0", (F.col("x0") + F.col("v")).alias("x1"), F.lit(0).alias("y0"), F.lit(1500).alias("y1"))


WORDS = """words as (select user_id as line_id, row_number() over (partition by user_id order by ts, event_id) - 1 as word_idx,
  event_type as text, cast(floor(value) as bigint) % 100 as conf,
  cast(floor((epoch_us(ts) - 1704067200000000) / 1000000) as bigint) as x0,
  cast(floor((epoch_us(ts) - 1704067200000000) / 1000000) as bigint) + cast(floor(value) as bigint) as x1, 0 as y0, 1500 as y1 from events)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector is a picture of 8 x 8 pixels; its channels are shifted copies."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slide_idx"), F.posexplode("embedding").alias("pix", "e"))
    v = F.floor((F.col("e").cast("double") + 1) * 127.5).cast("int")
    return e.select("slide_idx", "pix", (F.col("pix") % 8).alias("px"), F.floor(F.col("pix") / 8).cast("int").alias("py"), v.alias("r"), ((v + F.col("pix")) % 256).alias("g"), (255 - v).alias("b"))


PIXELS = """pixels as (select slide_idx, pix, pix % 8 as px, pix // 8 as py, v as r, (v + pix) % 256 as g, 255 - v as b from (
  select vec_id as slide_idx, cast(unnest(range(len(embedding))) as int) as pix, cast(floor((cast(unnest(embedding) as double) + 1) * 127.5) as int) as v from embeddings))"""


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pages each, one after the other, in files blob-N.html."""
    p = table(spark, sf_dir, "pages").withColumn("blob_id", F.floor(F.col("page_id") / 10))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "html"))), lambda s: s["html"])
    return p.groupBy("blob_id").agg(F.array_join(parts, "\n").alias("content")).withColumn("path", F.concat(F.lit("in/blob-"), F.col("blob_id").cast("string"), F.lit(".html")))


def title_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which some have lost their title, some their h1 too."""
    p = table(spark, sf_dir, "pages")
    no_title = F.regexp_replace("html", "(?is)<title[^>]*>.*?</title>", "")
    no_both = F.regexp_replace(no_title, "(?is)<h1[^>]*>.*?</h1>", "")
    return p.select("page_id", "url", F.when(F.col("page_id") % 7 == 0, no_both).when(F.col("page_id") % 3 == 0, no_title).otherwise(F.col("html")).alias("html"))


VARIANTS = """variants as (select page_id, url, case
  when page_id % 7 = 0 then regexp_replace(regexp_replace(html, '<title[^>]*>.*?</title>', '', 'gis'), '<h1[^>]*>.*?</h1>', '', 'gis')
  when page_id % 3 = 0 then regexp_replace(html, '<title[^>]*>.*?</title>', '', 'gis') else html end as html from pages)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree: regions, their nations, their customers; with boxes, z, visibility."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("long").alias("k"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_nationkey").cast("long").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"), F.col("c_custkey").cast("long").alias("k"))
    k = F.col("k")
    return r.unionByName(n).unionByName(c).select(
        "node_id",
        "parent_id",
        k.alias("sibling"),
        F.when(k % 4 == 1, (k % 9).cast("int")).alias("z"),
        (k % 2 == 0).alias("clips"),
        (k % 11 != 3).alias("visible"),
        (k % 17 == 5).alias("consumes"),
        (k * 13 % 400).alias("x"),
        (k * 7 % 300).alias("y"),
        (200 + k * 31 % 900).alias("w"),
        (150 + k * 17 % 500).alias("h"),
    )


NODES = """nodes as (select node_id, parent_id, k as sibling, case when k % 4 = 1 then k % 9 end as z, k % 2 = 0 as clips,
  k % 11 <> 3 as visible, k % 17 = 5 as consumes, k * 13 % 400 as x, k * 7 % 300 as y, 200 + k * 31 % 900 as w, 150 + k * 17 % 500 as h from (
  select 'r' || r_regionkey as node_id, null as parent_id, cast(r_regionkey as bigint) as k from region
  union all select 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey from nation
  union all select 'c' || c_custkey, 'n' || c_nationkey, c_custkey from customer))"""
PATHS = """anc as (select node_id as leaf, node_id, parent_id, 0 as up from nodes
  union all select a.leaf, n.node_id, n.parent_id, a.up + 1 from anc a join nodes n on a.parent_id = n.node_id)"""
