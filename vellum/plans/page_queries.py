"""Splitting, titles, names, uploads, assets: queries over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import media, text
from vellum.plans.fixtures import VARIANTS, blobs, table, title_variants
from vellum.plans.registry import query
from vellum.sources import split

TITLE = r"trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), E' \t\n\r\f\v')"
H1 = r"trim(regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 'is'), '<[^>]+>', '', 'g'), E' \t\n\r\f\v')"


@query(f"with {VARIANTS} select page_id, coalesce(nullif({TITLE}, ''), nullif(substr({H1}, 1, 60), ''), url) as title from variants")
def page_titles(spark, sf_dir):
    return title_variants(spark, sf_dir).select("page_id", text.page_title(F.col("html"), F.col("url")).alias("title"))


@query(
    f"""with {VARIANTS} select page_id,
      coalesce(nullif(substr(trim(regexp_replace({TITLE}, '<[^>]+>', '', 'g'), E' \\t\\n\\r\\f\\v'), 1, 60), ''), nullif(substr({H1}, 1, 60), ''), 'Slide ' || page_id) as title,
      regexp_matches(html, '<!DOCTYPE html>|<html[\\s>]|slide-container|<body[\\s>]|<div[\\s>]', 'i') as is_html from variants"""
)
def card_titles(spark, sf_dir):
    return title_variants(spark, sf_dir).select("page_id", text.card_title(F.col("html"), F.col("page_id")).alias("title"), text.looks_like_html(F.col("html")).alias("is_html"))


SPLIT = r"""parts as (select blob_id, unnest(p) as html, unnest(range(len(p))) as slide_idx, len(p) as n from (
  select blob_id, list_filter(list_transform(string_split(regexp_replace(content, '(<!DOCTYPE html>)', chr(1) || '\1', 'gi'), chr(1)), lambda x: trim(x, E' \t\n\r\f\v')), lambda x: x <> '') as p from (
  select page_id // 10 as blob_id, string_agg(html, E'\n' order by page_id) as content from pages group by 1)))"""


@query(
    f"""with {SPLIT}, named as (select *, 'blob-' || blob_id || case when n > 1 then '-' || lpad(cast(slide_idx + 1 as varchar), 2, '0') else '' end as name from parts)
    select blob_id, slide_idx, name, coalesce(nullif({TITLE}, ''), nullif(substr({H1}, 1, 60), ''), name) as title, length(html) as n_chars from named"""
)
def page_split(spark, sf_dir):
    out = split.split_documents(blobs(spark, sf_dir), "content", "path")
    return out.select("blob_id", F.col("slide_idx").cast("long").alias("slide_idx"), "name", "title", F.length("html").cast("long").alias("n_chars"))


@query(
    f"""with {SPLIT}, named as (select blob_id, slide_idx, case when (blob_id + slide_idx) % 4 = 0 then '<p>untitled</p>' else html end as html, 'slide-' || case when k < 10 then '0' else '' end || k as name from (select *, row_number() over (partition by blob_id // 10 order by blob_id, slide_idx) as k from parts))
    select blob_id, slide_idx, name, coalesce(nullif({TITLE}, ''), nullif(substr({H1}, 1, 60), ''), name) as title from named"""
)
def string_slides(spark, sf_dir):
    """Pasted strings: names run over all strings of a job, and a document without a title is titled by its name."""
    parts = split.split_documents(blobs(spark, sf_dir), "content", "path").withColumn("job", F.floor(F.col("blob_id") / 10))
    plain = parts.withColumn("html", F.when((F.col("blob_id") + F.col("slide_idx")) % 4 == 0, "<p>untitled</p>").otherwise(F.col("html")))
    return split.number_documents(plain, ["blob_id", "slide_idx"], ["job"]).select("blob_id", F.col("slide_idx").cast("long").alias("slide_idx"), "name", "title")


def _marked(spark, sf_dir, mark):
    """Five pages a blob, each behind the mark of a rule."""
    pages = table(spark, sf_dir, "pages").withColumn("blob_id", F.floor(F.col("page_id") / 5))
    body = F.concat(F.lit(mark), F.lit("<h1>"), F.col("url"), F.lit("</h1>"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", body.alias("t")))), lambda s: s["t"]), "\n")
    return pages.groupBy("blob_id").agg(joined.alias("content")).withColumn("path", F.concat(F.lit("/in/b"), F.col("blob_id").cast("string"), F.lit(".html")))


def _by_mark(mark):
    return f"""with numbered as (select page_id // 5 as blob_id, url, row_number() over (partition by page_id // 5 order by page_id) - 1 as slide_idx, count(*) over (partition by page_id // 5) as n from pages)
    select blob_id, slide_idx, 'b' || blob_id || case when n > 1 then '-' || lpad(cast(slide_idx + 1 as varchar), 2, '0') else '' end as name, substr(url, 1, 60) as title, length('{mark}<h1></h1>') + length(url) as n_chars from numbered"""


@query(_by_mark("<html lang=en>"))
def split_by_html(spark, sf_dir):
    """The second rule: several html elements, no doctype."""
    out = split.split_documents(_marked(spark, sf_dir, "<html lang=en>"), "content", "path")
    return out.select("blob_id", F.col("slide_idx").cast("long").alias("slide_idx"), "name", "title", F.length("html").cast("long").alias("n_chars"))


@query(_by_mark('<div class="a slide-container">'))
def split_by_container(spark, sf_dir):
    """The third rule: several slide containers, neither doctype nor html element."""
    out = split.split_documents(_marked(spark, sf_dir, '<div class="a slide-container">'), "content", "path")
    return out.select("blob_id", F.col("slide_idx").cast("long").alias("slide_idx"), "name", "title", F.length("html").cast("long").alias("n_chars"))


@query(
    f"""with {SPLIT}, u as (select 0 as input_idx, blob_id as id, slide_idx from parts union all select 1, conv_id, turn from conversations)
    select input_idx, id, slide_idx, row_number() over (partition by id order by input_idx, slide_idx) - 1 as slide_no from u"""
)
def mixed_inputs(spark, sf_dir):
    """Slides of a mixed input, one kind after the other, numbered in that order within a job (here: an id)."""
    pages = split.split_documents(blobs(spark, sf_dir), "content", "path").select(F.col("blob_id").alias("id"), F.col("slide_idx").cast("long").alias("slide_idx"))
    talks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("slide_idx"))
    return split.numbered(split.ordered_union([pages, talks]), ["id"], ["input_idx", "slide_idx"]).select("input_idx", "id", "slide_idx", "slide_no")


@query(r"select page_id, length(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', '', 'g')) as n_chars, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as plain from pages")
def text_char_count(spark, sf_dir):
    plain = F.regexp_replace("html", "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", text.bare_length(plain).cast("long").alias("n_chars"), text.squeeze(plain).alias("plain"))


NAMES = "names as (select page_id, url || (['.pdf', '.PPTX', '.png', '.JPEG', '.html', '.tiff', '.ppt', ''])[1 + page_id % 8] as name from pages)"


def _names(spark, sf_dir):
    ends = F.array(*[F.lit(e) for e in (".pdf", ".PPTX", ".png", ".JPEG", ".html", ".tiff", ".ppt", "")])
    return table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.get(ends, (F.col("page_id") % 8).cast("int"))).alias("name"))


@query(
    rf"""with {NAMES} select page_id, case when regexp_matches(name, '\.pdf$', 'i') then 'pdf' when regexp_matches(name, '\.pptx?$', 'i') then 'pptx' when regexp_matches(name, '\.(png|jpe?g|webp|bmp|tiff?)$', 'i') then 'image' else 'html' end as kind,
    regexp_matches(name, '\.(pdf|pptx?|png|jpe?g|webp|bmp|tiff?)$', 'i') as is_media,
    case when regexp_matches(name, '\.pdf$', 'i') then 'PDF' when regexp_matches(name, '\.pptx?$', 'i') then 'PPT' when regexp_matches(name, '\.(png|jpe?g|webp|bmp|tiff?)$', 'i') then 'IMG' else cast(greatest(page_id % 4, 1) as varchar) end as badge,
    case lower(regexp_extract(name, '(\.[A-Za-z0-9]+)$', 1)) when '.png' then 'image/png' when '.html' then 'text/html; charset=utf-8' else 'application/octet-stream' end as content_type from names"""
)
def media_class(spark, sf_dir):
    n = F.col("name")
    return _names(spark, sf_dir).select("page_id", media.media_class(n).alias("kind"), media.is_media(n).alias("is_media"), media.badge(n, F.col("page_id") % 4).alias("badge"), media.content_type(n).alias("content_type"))


@query(
    r"""with u as (select page_id, url, case when page_id % 2 = 0 then 'data:text/html;base64,' || to_base64(encode(html)) else html end as content, html from pages)
    select page_id, lpad(cast(page_id % 1000 as varchar), 3, '0') || '-' || regexp_replace(url, '[^A-Za-z0-9_.\- ]+', '_', 'g') as file,
    sha1(html) as sha from u"""
)
def upload_decode(spark, sf_dir):
    up = table(spark, sf_dir, "pages").withColumn("content", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("data:text/html;base64,"), F.base64(F.encode("html", "utf-8")))).otherwise(F.col("html")))
    return up.select("page_id", media.safe_name(F.col("url"), F.col("page_id") % 1000).alias("file"), F.sha1(media.upload_content(F.col("content"))).alias("sha"))


@query(
    """with u as (select 0 as input_idx, page_id as id, html as content from pages union all select 1, doc_id, case when doc_id % 10 = 0 then ' ' else text end from documents)
    select input_idx, case when trim(content) = '' then 'no content' else 'ok' end as state, count(*) as n, sum(length(content)) as chars from u group by 1, 2"""
)
def ordered_union(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("content"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("text")).alias("content"))
    good, bad = split.readable(split.ordered_union([pages, docs]), "content")
    both = good.withColumn("error", F.lit("ok")).unionByName(bad)
    return both.groupBy("input_idx", F.col("error").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


LINKED = """linked as (select page_id, (['https://cdn.tailwindcss.com/x.css', 'https://cdn.example/font-awesome/6/all.min.css', 'https://fonts.googleapis.com/css2?family=Inter', 'https://cdn.example/echarts.min.js', 'https://cdn.example/Chart.js', 'https://tracker.example/t.js'])[1 + page_id % 6] as link from pages)"""


@query(
    rf"""with {LINKED} select page_id, case when regexp_matches(link, 'tailwindcss|tailwind(\.min)?\.css', 'i') then '/assets/tailwind/tailwind.generated.css' when regexp_matches(link, 'fontawesome|font-awesome', 'i') then '/assets/fontawesome/all.min.css' when regexp_matches(link, 'fonts\.googleapis\.com', 'i') then '/assets/fonts/fonts.css'
    when regexp_matches(link, 'echarts', 'i') then '/assets/charts/echarts.min.js' when regexp_matches(link, 'chart\.?js|chart\.umd|chart\.min\.js', 'i') then '/assets/charts/chart.min.js' end as local,
    regexp_replace(regexp_replace(regexp_replace('<link href="' || link || '">', 'https?://[^"'']*tailwind[^"'']*\.css', '/assets/tailwind/tailwind.generated.css', 'gi'), 'https?://[^"'']*(?:fontawesome|font-awesome)[^"'']*\.css', '/assets/fontawesome/all.min.css', 'gi'), 'https?://fonts\.googleapis\.com/css2[^"'']*', '/assets/fonts/fonts.css', 'gi') as html from linked"""
)
def asset_links(spark, sf_dir):
    links = F.array(*[F.lit(x) for x in ("https://cdn.tailwindcss.com/x.css", "https://cdn.example/font-awesome/6/all.min.css", "https://fonts.googleapis.com/css2?family=Inter", "https://cdn.example/echarts.min.js", "https://cdn.example/Chart.js", "https://tracker.example/t.js")])
    linked = table(spark, sf_dir, "pages").select("page_id", F.get(links, (F.col("page_id") % 6).cast("int")).alias("link"))
    return linked.select("page_id", media.local_asset(F.col("link")).alias("local"), media.rewrite_links(F.concat(F.lit('<link href="'), F.col("link"), F.lit('">'))).alias("html"))


@query("select page_id // 10 as blob_id, substr(sha1(string_agg(url || html, '' order by encode(url || html))), 1, 12) as signature from pages group by 1")
def source_signature(spark, sf_dir):
    from vellum.operators.lifecycle import source_signature as sign

    return sign(table(spark, sf_dir, "pages").withColumn("blob_id", F.floor(F.col("page_id") / 10)), ["blob_id"], "url", "html")
