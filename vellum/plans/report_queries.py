"""Segments, pixels, validation, verification and summaries."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vellum.convert import Job, Options, convert_each
from vellum.functions.text import pad_left
from vellum.operators import inpaint, mapping
from vellum.operators import pixels as px
from vellum.operators import resample, segments, validation
from vellum.plans.fixtures import BOXES, PIXELS, WORDS, boxes, pixels, table, words
from vellum.plans.layout_queries import ITEMS, text_items
from vellum.plans.registry import query

SEGS = """flags as (select *, case when x0 - max(x1) over (partition by line_id order by word_idx rows between unbounded preceding and 1 preceding) > 3300 then 1 else 0 end as f from words),
segs as (select *, cast(sum(f) over (partition by line_id order by word_idx) as int) as seg from flags)"""
JUNK = "((coalesce(conf, 100) < 55 and length(text) <= 3) or (length(text) <= 2 and length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) < length(text)))"


def _segmented(spark, sf_dir):
    return segments.gap_segments(words(spark, sf_dir), segments.gap_width(F.lit(1500)), ["line_id"])


@query(f"with {WORDS}, {SEGS} select line_id, word_idx, seg from segs")
def gap_segments(spark, sf_dir):
    return _segmented(spark, sf_dir).select("line_id", "word_idx", "seg")


@query(f"with {WORDS}, {SEGS} select line_id, seg, string_agg(text, ' ' order by word_idx) as text, min(x0) as x, max(x1) - min(x0) as w, round(avg(conf), 6) as conf, 1170.0 as size from segs group by line_id, seg")
def segment_summary(spark, sf_dir):
    return segments.segment_items(_segmented(spark, sf_dir), ["line_id", "seg"]).select("line_id", "seg", "text", "x", "w", F.round("conf", 6).alias("conf"), F.round("size", 3).alias("size"))


DOCWORDS = r"""docwords as (select doc_id, unnest(w) as text, unnest(range(len(w))) as word_idx, unnest(list_transform(range(len(w)), lambda i: (doc_id * 31 + i * 17) % 100)) as conf from (
  select doc_id, string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as w from documents))"""


@query(f"with {DOCWORDS}, j as (select *, min(case when not {JUNK} then word_idx end) over w as a, max(case when not {JUNK} then word_idx end) over w as z from docwords window w as (partition by doc_id)) select doc_id, word_idx, text from j where word_idx between a and z")
def edge_junk_trim(spark, sf_dir):
    t = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t).alias("word_idx", "text")).withColumn("conf", (F.col("doc_id") * 31 + F.col("word_idx") * 17) % 100)
    return segments.trim_junk(w, ["doc_id"]).select("doc_id", F.col("word_idx").cast("long").alias("word_idx"), "text")


@query(f"with {WORDS}, l as (select line_id, case when line_id % 5 = 0 then ' ' else min(text) end as text, case when line_id % 3 = 0 then null else min(conf) * 3 end as conf from words group by 1) select line_id, text from l where trim(text) <> '' and (conf is null or conf >= 35)")
def line_filter(spark, sf_dir):
    k = F.col("line_id")
    lines = words(spark, sf_dir).groupBy("line_id").agg(F.min("text").alias("t"), F.min("conf").alias("c"))
    lines = lines.select("line_id", F.when(k % 5 == 0, " ").otherwise(F.col("t")).alias("text"), F.when(k % 3 != 0, F.col("c") * 3).alias("conf"))
    return lines.where(segments.keep_line(F.col("text"), F.col("conf"))).select("line_id", "text")


@query("select page_id, b, l, word_idx, w as text from (select page_id, b, l, unnest(ws) as w, unnest(range(len(ws))) as word_idx from (select page_id, b, l, case when (page_id + b + l) % 4 = 0 then ['whole ' || url] else [url, 'b' || b, 'l' || l] end as ws from pages, range(2) r(b), range(2) s(l)))")
def flatten_words(spark, sf_dir):
    mk = lambda b, l: F.array(*[F.struct(t.alias("text")) for t in (F.col("url"), F.lit(f"b{b}"), F.lit(f"l{l}"))])  # noqa: E731, E741
    line = lambda b, i: F.struct(F.when((F.col("page_id") + b + i) % 4 == 0, F.array().cast("array<struct<text:string>>")).otherwise(mk(b, i)).alias("words"), F.concat(F.lit("whole "), F.col("url")).alias("text"))
    block = lambda b: F.struct(F.array(F.struct(F.array(*[line(b, i) for i in range(2)]).alias("lines"))).alias("paragraphs"))
    out = segments.flatten_words(table(spark, sf_dir, "pages").select("page_id", "url", F.array(block(0), block(1)).alias("tree")), "tree")
    return out.select("page_id", F.col("line_id._b").cast("long").alias("b"), F.col("line_id._l").cast("long").alias("l"), F.col("word_idx").cast("long").alias("word_idx"), F.col("word.text").alias("text"))


@query(f"with {WORDS}, i as (select line_id, word_idx, case when word_idx % 4 <> 0 then conf end as conf from words), s as (select line_id, word_idx, case when word_idx % 3 = 0 then 'EEEEEE' end as bg, case when word_idx % 5 <> 0 then '112233' end as fg from words where conf >= 10) select line_id, word_idx, bg, coalesce(fg, '000000') as color, bg is not null and (conf is null or conf >= 65) as safe from i left join s using (line_id, word_idx)")
def zip_samples(spark, sf_dir):
    w = words(spark, sf_dir)
    i = F.col("word_idx")
    items = w.select("line_id", "word_idx", F.when(i % 4 != 0, F.col("conf")).alias("conf"))
    samples = w.where("conf >= 10").select("line_id", "word_idx", F.when(i % 3 == 0, "EEEEEE").alias("bg"), F.when(i % 5 != 0, "112233").alias("fg"))
    return segments.zip_samples(items, samples, ["line_id", "word_idx"]).select("line_id", "word_idx", "bg", "color", "safe")


@query(
    f"""with {BOXES}, spans as (select * from boxes where size % 2 = 0), enough as (select slide_idx from spans group by 1 having count(*) >= 3)
    select slide_idx as page_id, elem_idx, cast(x as double) as x, cast(h as double) as h, false as ocr from spans where slide_idx in (select slide_idx from enough) union all select slide_idx, elem_idx, x / 2.0, h / 2.0, true from boxes where size % 2 = 1 and slide_idx not in (select slide_idx from enough)"""
)
def page_text(spark, sf_dir):
    b = boxes(spark, sf_dir).select(F.col("slide_idx").alias("page_id"), "elem_idx", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h", "size")])
    return segments.page_text(b.where("size % 2 = 0"), b.where("size % 2 = 1")).select("page_id", "elem_idx", "x", "h", "ocr")


# ---- pixels ----

PROBES = "probes as (select slide_idx, slide_idx % 3 + 2 as x, slide_idx % 2 + 2 as y, 3 as w, 3 as h from (select distinct slide_idx from pixels))"
RING = f"""{PIXELS}, {PROBES}, pts as (select slide_idx, p[1] as px, p[2] as py from (select slide_idx, unnest([[x, y-1], [x, y+h+1], [(2*x+w)//2, y-1], [(2*x+w)//2, y+h+1], [x+w, y-1], [x+w, y+h+1], [x-1, (2*y+h)//2], [x+w+1, (2*y+h)//2]]) as p from probes)),
ring as (select q.slide_idx, p.r, p.g, p.b from pts q join pixels p on p.slide_idx = q.slide_idx and p.px = q.px and p.py = q.py where q.px between 0 and 7 and q.py between 0 and 7)"""
HEX = "lpad(to_hex(cast(greatest(0, least(255, floor({}))) as bigint)), 2, '0')"


def _probes(spark, sf_dir):
    k = F.col("slide_idx")
    return pixels(spark, sf_dir).select("slide_idx").distinct().select("slide_idx", (k % 3 + 2).cast("int").alias("x"), (k % 2 + 2).cast("int").alias("y"), F.lit(3).alias("w"), F.lit(3).alias("h"))


def _ring(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return px.ring_points(_probes(spark, sf_dir), F.lit(8), F.lit(8), 1).select("slide_idx", "px", "py").join(p, ["slide_idx", "px", "py"])


@query(
    f"""with {RING}, m as (select slide_idx, median(r) as mr, median(g) as mg, median(b) as mb, greatest(quantile_cont(r, 0.9) - quantile_cont(r, 0.1), quantile_cont(g, 0.9) - quantile_cont(g, 0.1), quantile_cont(b, 0.9) - quantile_cont(b, 0.1)) as spread from ring group by 1)
    select slide_idx, round(spread, 6) as spread, case when spread <= 40 then {HEX.format('mr')} || {HEX.format('mg')} || {HEX.format('mb')} end as bg from m"""
)
def ring_uniformity(spark, sf_dir):
    return px.ring_colour(_ring(spark, sf_dir), ["slide_idx"]).select("slide_idx", F.round("spread", 6).alias("spread"), "bg")


@query(f"with {RING}, n as (select *, row_number() over (partition by slide_idx order by r, g, b) - 1 as i, count(*) over (partition by slide_idx) as n from ring) select slide_idx, {HEX.format('r')} || {HEX.format('g')} || {HEX.format('b')} as bg from n where i = n // 2")
def ring_middle(spark, sf_dir):
    return px.middle_colour(_ring(spark, sf_dir), ["slide_idx"])


@query(
    f"""with {RING}, m as (select slide_idx, median(r) as mr, median(g) as mg, median(b) as mb, greatest(quantile_cont(r, 0.9) - quantile_cont(r, 0.1), quantile_cont(g, 0.9) - quantile_cont(g, 0.1), quantile_cont(b, 0.9) - quantile_cont(b, 0.1)) as spread from ring group by 1),
    ins as (select p.*, mr, mg, mb, spread, abs(r - mr) + abs(g - mg) + abs(b - mb) as d from pixels p join m using (slide_idx)), f as (select slide_idx, median(r) as fr, median(g) as fg, median(b) as fb from ins where d > 120 group by 1 having count(*) >= 4),
    j as (select i.slide_idx, any_value(mr) as mr, any_value(mg) as mg, any_value(mb) as mb, any_value(spread) as spread, any_value(fr) as fr, any_value(fg) as fg, any_value(fb) as fb, avg(case when d > 90 and abs(r - fr) + abs(g - fg) + abs(b - fb) > 90 then 1.0 else 0 end) as other from ins i left join f using (slide_idx) group by 1)
    select slide_idx, case when fr is not null then {HEX.format('fr')} || {HEX.format('fg')} || {HEX.format('fb')} when 0.299 * mr + 0.587 * mg + 0.114 * mb > 128 then '000000' else 'FFFFFF' end as fg,
    case when spread <= 40 and not (fr is not null and other > 0.15) then {HEX.format('mr')} || {HEX.format('mg')} || {HEX.format('mb')} end as bg from j"""
)
def text_colour(spark, sf_dir):
    return px.text_colour(pixels(spark, sf_dir), px.ring_colour(_ring(spark, sf_dir), ["slide_idx"]), ["slide_idx"])


BORDER = f"{PIXELS}, border as (select * from pixels where px in (0, 7) or py in (0, 7)), q as (select slide_idx, r // 32 * 32 + 16 as qr, g // 32 * 32 + 16 as qg, b // 32 * 32 + 16 as qb, r, g, b from border)"


@query(f"with {BORDER}, c as (select slide_idx, qr, qg, qb, count(*) as n from q group by all), m as (select slide_idx, arg_min((qr, qg, qb), (-n, qr, qg, qb)) as k from c group by 1), n as (select q.*, k, abs(r - k[1]) + abs(g - k[2]) + abs(b - k[3]) < 60 as near from q join m using (slide_idx)) select slide_idx, cast(floor(coalesce(avg(case when near then r end), any_value(k[1]))) as int) as r, cast(floor(coalesce(avg(case when near then g end), any_value(k[2]))) as int) as g, cast(floor(coalesce(avg(case when near then b end), any_value(k[3]))) as int) as b from n group by 1")
def bg_mode(spark, sf_dir):
    return px.background_colour(pixels(spark, sf_dir).where(F.col("px").isin(0, 7) | F.col("py").isin(0, 7)), ["slide_idx"])


@query(f"with {PIXELS}, c as (select slide_idx, r // 32 * 32 + 16 as qr, g // 32 * 32 + 16 as qg, b // 32 * 32 + 16 as qb, count(*) as n from pixels group by all), t as (select *, row_number() over (partition by slide_idx order by n desc, qr, qg, qb) as place from c) select slide_idx, qr, qg, qb, n, place from t where place <= 14")
def top_colours(spark, sf_dir):
    return px.top_colours(pixels(spark, sf_dir), ["slide_idx"])


PAIRS = f"{PIXELS}, pairs as (select a.slide_idx, a.px, a.py, (abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b)) / 3.0 > 45 as changed from pixels a join pixels b on b.slide_idx = a.slide_idx + 1 and b.pix = a.pix)"


def _changed(spark, sf_dir):
    p = pixels(spark, sf_dir)
    after = p.select((F.col("slide_idx") - 1).alias("slide_idx"), "pix", *[F.col(c).alias(f"{c}2") for c in "rgb"])
    return px.pixel_diff(p.join(after, ["slide_idx", "pix"]), ["slide_idx"], ["r", "g", "b"], ["r2", "g2", "b2"])


@query(f"with {PAIRS} select slide_idx, round_even(100 * avg(cast(changed as int)), 2) as diff_pct from pairs group by 1")
def pixel_diff(spark, sf_dir):
    return px.diff_share(_changed(spark, sf_dir), ["slide_idx"])


@query(f"with {PAIRS}, c as (select slide_idx, py // 2 as cy, px // 2 as cx, avg(cast(changed as int)) as v from pairs where px // 2 < 4 and py // 2 < 4 group by all), w as (select *, row_number() over (partition by slide_idx order by v desc, cy, cx) as k from c) select slide_idx, 'x' || cx * 320 || 'y' || cy * 180 || 'w320h180' as region, round_even(100 * v, 2) as worst_pct from w where k = 1")
def worst_cell(spark, sf_dir):
    out = px.worst_cell(_changed(spark, sf_dir), ["slide_idx"], 8, 8, 4)
    r = F.col("worst_region")
    return out.select("slide_idx", F.concat(F.lit("x"), r[0].cast("string"), F.lit("y"), r[1].cast("string"), F.lit("w"), r[2].cast("string"), F.lit("h"), r[3].cast("string")).alias("region"), "worst_pct")


DRIFT = "drift as (select o_orderkey as slide_idx, n, case when n is null then null else (o_orderkey % 1000) / 50.0 end as diff_pct, n is null as missing, (['image', 'recon', 'html', 'other'])[1 + o_orderkey % 4] as kind, case when n is not null then '[' || o_orderkey % 6 * 213 || ',' || o_orderkey % 5 * 144 || ',213,120]' end as region from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) l on l_orderkey = o_orderkey)"


def drift(spark, sf_dir):
    there = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slide_idx")).distinct().withColumn("diff_pct", F.col("slide_idx") % 1000 / 50.0)
    there = there.withColumn("worst_region", F.array(F.col("slide_idx") % 6 * 213, F.col("slide_idx") % 5 * 144, F.lit(213), F.lit(120)))
    out = px.with_missing(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slide_idx")), there, ["slide_idx"])
    kinds = F.array(*[F.lit(k) for k in ("image", "recon", "html", "other")])
    return out.withColumn("kind", F.get(kinds, (F.col("slide_idx") % 4).cast("int")))


@query(f"with {DRIFT} select slide_idx, diff_pct, missing from drift")
def diff_missing(spark, sf_dir):
    return drift(spark, sf_dir).select("slide_idx", "diff_pct", "missing")


@query(
    f"""with {BOXES}, t as (select * from boxes where strategy = 'native-text'), p as (select * from boxes where strategy = 'image' and w * h > 0.02 * 1280 * 720)
    select t.slide_idx, t.elem_idx as item_idx from t where not clipped and exists (select 1 from p where p.slide_idx = t.slide_idx and greatest(0, least(t.x + t.w, p.x + p.w + 32) - greatest(t.x, p.x - 32)) * greatest(0, least(t.y + t.h, p.y + p.h + 32) - greatest(t.y, p.y - 32)) / cast(greatest(t.w * t.h, 1) as double) >= 0.6)
    union select slide_idx, elem_idx from t where h >= 0.045 * 720"""
)
def embedded_text(spark, sf_dir):
    b = boxes(spark, sf_dir)
    texts = b.where("strategy = 'native-text'").withColumnRenamed("elem_idx", "item_idx").withColumn("safe", F.col("clipped"))
    return px.embedded_text(texts, b.where("strategy = 'image'"), "slide_idx", "item_idx", F.lit(1280), F.lit(720))


def drawn(slides, shrink: int = 1):
    """Pictures of slides (slide, boxes: x, y, w, h, size), one at a time: a row a slide, as the operators on pictures take them."""
    height, width = 720 // shrink, 1280 // shrink
    grounds = [[225, 232, 240], [240, 240, 240]]
    blank = [np.full((height, width, 3), bg, np.uint8).reshape(height, -1) for bg in grounds]
    for slide, parts in slides:
        lines = blank[slide % 2].copy()
        text = np.zeros((height, width), np.uint8)
        texts = []

        def paint(y0, y1, x0, x1, colour):
            lines[y0:y1, 3 * x0 : 3 * x1] = np.frombuffer(bytes(colour) * (min(x1, width) - x0), np.uint8)

        for x, y, w, h, size in parts:
            y0, y1, x0, x1 = y // shrink, (y + h) // shrink, x // shrink, (x + w) // shrink
            if size % 3:
                paint(y0, y1, x0, x1, (size * 7 % 200, x % 200, y % 200))
            else:  # a line of text over what is there: its upper half in dark letters
                half = (y0 + y1 + 1) // 2
                paint(y0, half, x0, x1, (20, 20, 20))
                text[y0:half, x0:x1] = 1
                role = "title" if half - y0 >= 0.045 * height else "baked" if size % 2 else "wiped"
                texts.append({"x": x0, "y": y0, "w": x1 - x0, "h": half - y0, "role": role})
        yield {"slide_idx": slide, "width": width, "height": height, "pixels": lines, "bg": grounds[slide % 2], "text": text, "texts": texts}


def boxes_of(batch):
    """Slides of an Arrow batch of ``slide_parts`` with their boxes as tuples of plain numbers."""
    parts = batch.column("parts")
    fields = parts.flatten().flatten()  # one column a field, of all slides
    names = [f.name for f in parts.type.value_type]
    rows = list(zip(*(fields[names.index(c)].to_pylist() for c in ("x", "y", "w", "h", "size"))))
    at = 0
    for slide, n in zip(batch.column("slide_idx").to_pylist(), parts.value_lengths().to_pylist()):
        yield slide, rows[at : at + n]
        at += n


def dealt(spark, df):
    """Short rows with long work on each, dealt to all tasks.

    The key is another one than a join's or a group's: by the same one the plan would leave this out, and put rows together in few tasks.
    """
    return df.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("slide_idx"))


def slide_parts(spark, sf_dir):
    """The boxes of each slide, dealt by slide to tasks of a few seconds. The boxes' own exchange does it, in a number of tasks that isn't cut down."""
    parts = boxes(spark, sf_dir, 1 << 20).groupBy("slide_idx")
    return parts.agg(F.array_sort(F.collect_list(F.struct("elem_idx", "x", "y", "w", "h", "size"))).alias("parts"))


def drawn_rows(spark, sf_dir, rows_of, schema):
    """Rows of each slide's picture of 160 x 90. Pictures are drawn and looked at in one task, some at a time: they aren't sent."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist(list(rows_of(drawn(boxes_of(batch), 8))), out)

    return slide_parts(spark, sf_dir).mapInArrow(run, schema)


@query()
def decompose_pictures(spark, sf_dir):
    """Rectangles and art regions of pictures of 160 x 90 drawn from boxes; tests hold it against a plain flood fill."""
    return drawn_rows(spark, sf_dir, lambda pictures: px.part_rows(pictures, "slide_idx"), f"slide_idx long, {px.PARTS}")


@query(
    f"""with recursive {PIXELS}, m as (select slide_idx, px, py, pix, r > 135 as inside from pixels), d as (values (-1), (0), (1)), around as (select a.col0 as dx, b.col0 as dy from d a, d b),
    grown as (select m.slide_idx, m.px, m.py, m.pix, bool_or(n.inside) as inside from m join around on true join m n on n.slide_idx = m.slide_idx and n.px = m.px + dx and n.py = m.py + dy group by all),
    closed as (select g.slide_idx, g.px, g.py, g.pix from grown g join around on true join grown n on n.slide_idx = g.slide_idx and n.px = g.px + dx and n.py = g.py + dy group by all having bool_and(n.inside)),
    reach as (select slide_idx, px, py, pix as root from closed union select c.slide_idx, c.px, c.py, r.root from reach r join closed c on c.slide_idx = r.slide_idx and abs(c.px - r.px) <= 1 and abs(c.py - r.py) <= 1),
    parts as (select slide_idx, px, py, min(root) as root from reach group by all)
    select slide_idx, cast(row_number() over (partition by slide_idx order by root) - 1 as int) as region_idx, count(*) as area, min(px) as x, min(py) as y, max(px) - min(px) + 1 as w, max(py) - min(py) + 1 as h from parts group by slide_idx, root"""
)
def picture_regions(spark, sf_dir):
    """Bright regions of each vector's picture, after closing by a square of three."""
    lit = F.when(F.col("r") > 135, "01").otherwise("00").alias("v")
    rows = pixels(spark, sf_dir).groupBy("slide_idx").agg(F.array_sort(F.collect_list(F.struct("pix", lit))).alias("p"))
    masks = rows.select("slide_idx", F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(F.array_join(F.transform("p", lambda c: c["v"]), "")).alias("mask"))
    return px.mask_regions(masks, closing=3)


@query()
def picture_crops(spark, sf_dir):
    """Crops of artwork and titles, with other text wiped out, of pictures of 160 x 90: boxes and checksums; tests fill pixel by pixel."""
    def rows(pictures):
        return (c | {"crc": zlib.crc32(c.pop("pixels"))} for c in inpaint.crop_rows(pictures, "slide_idx"))

    return drawn_rows(spark, sf_dir, rows, "slide_idx long, crop_idx int, kind string, x int, y int, w int, h int, crc long")


@query()
def picture_drift(spark, sf_dir):
    """Each vector's picture of 8 x 8 against the next one's, stretched to another shape; some have no output. Tests resample by plain loops."""
    p = pixels(spark, sf_dir).groupBy("slide_idx").agg(F.array_sort(F.collect_list(F.struct("pix", "r", "g", "b"))).alias("p"))
    hexes = F.array_join(F.transform("p", lambda c: F.concat(*[F.lpad(F.hex(F.pmod(c[k], F.lit(256))), 2, "0") for k in "rgb"])), "")
    flat = p.select("slide_idx", F.unhex(hexes).alias("src"))
    after = flat.select((F.col("slide_idx") - 1).alias("slide_idx"), F.when(F.col("slide_idx") % 10 != 0, F.concat("src", "src")).alias("out"))
    sized = flat.join(after, "slide_idx", "left").withColumns({"src_w": F.lit(8), "src_h": F.lit(8), "out_w": F.lit(8), "out_h": F.lit(16)})
    return resample.compare_pictures(dealt(spark, sized))


@query("select page_id, cast(case when page_id % 3 = 2 then 1280 else page_id % 2000 + 1 end as int) as w, cast(case when page_id % 3 = 2 then 720 else page_id % 900 + 1 end as int) as h from pages")
def image_sizes(spark, sf_dir):
    """Header sizes read back from generated PNG and JPEG heads."""
    from vellum.sources.image_header import image_size

    w, h = F.col("page_id") % 2000 + 1, F.col("page_id") % 900 + 1
    four, two = (lambda c: F.lpad(F.hex(c), 8, "0")), (lambda c: F.lpad(F.hex(c), 4, "0"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four(w), four(h), F.lit("0806000000"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), two(h), two(w), F.lit("03"))
    content = F.unhex(F.when(F.col("page_id") % 3 == 0, png).when(F.col("page_id") % 3 == 1, jpeg).otherwise("00"))
    s = image_size(content)
    return table(spark, sf_dir, "pages").select("page_id", s["w"].alias("w"), s["h"].alias("h"))


# ---- validation ----

COLLIDE = """texts as (select * from boxes where strategy = 'native-text'), hits as (select a.slide_idx, a.elem_idx as a, b.elem_idx as b,
  cast(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as bigint) as ov, least(a.w * a.h, b.w * b.h) as m
  from texts a join texts b on a.slide_idx = b.slide_idx and a.elem_idx < b.elem_idx where greatest(a.size, b.size) / cast(greatest(1, least(a.size, b.size)) as double) <= 1.8),
collisions as (select slide_idx, a, b, cast(floor(100.0 * ov / m + 0.5) as int) as pct from hits where m > 0 and ov > 400 and ov * 2 > m)"""
CHECKS = f"""{BOXES}, {COLLIDE}, counts as (select slide_idx, case when sum(case when elem_idx % 5 = 0 then size * 2 else 0 end) > 0 then least(100, cast(floor(100.0 * sum(case when strategy = 'native-text' then size else 0 end) / sum(case when elem_idx % 5 = 0 then size * 2 else 0 end) + 0.5) as int)) else 100 end as coverage_pct, count(*) as n_elements, count(*) filter (strategy = 'native-text') as n_text, count(*) filter (x < -2 or y < -2 or x + w > 1282 or y + h > 722) as n_off_canvas, count(*) filter (clipped) as n_clipped from boxes group by 1),
cc as (select slide_idx, count(*) as n_collisions, list('text collision (' || pct || '%)' order by a, b) as hits from collisions group by 1),
checks as (select c.*, coalesce(n_collisions, 0) as n_collisions, list_concat(coalesce(hits, []), list_filter([case when n_off_canvas > 0 then n_off_canvas || ' off-canvas element(s)' end, case when n_clipped > 0 then n_clipped || ' clipped/half-cut element(s)' end], lambda i: i is not null)) as issues from counts c left join cc using (slide_idx))"""


@query(f"with {BOXES} select slide_idx, strategy, count(*) as n from boxes group by all")
def strategy_tally(spark, sf_dir):
    return validation.strategy_tally(boxes(spark, sf_dir))


@query(f"with {BOXES}, c as (select slide_idx, strategy, count(*) as n from boxes group by all) select slide_idx, string_agg(strategy || '=' || n, ',' order by strategy) as tally from c group by 1")
def tally_text(spark, sf_dir):
    t = validation.tally_map(boxes(spark, sf_dir))
    pairs = F.transform(F.array_sort(F.map_entries("strategies")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return t.select("slide_idx", F.array_join(pairs, ",").alias("tally"))


@query(f"with {BOXES}, {COLLIDE} select slide_idx, a, b, pct from collisions")
def text_collision(spark, sf_dir):
    return validation.text_collisions(boxes(spark, sf_dir))


@query(f"with {BOXES} select slide_idx, elem_idx, x < -2 or y < -2 or x + w > 1282 or y + h > 722 as off from boxes")
def off_canvas(spark, sf_dir):
    return boxes(spark, sf_dir).select("slide_idx", "elem_idx", validation.off_canvas(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("off"))


@query(f"with {BOXES}, s as (select slide_idx, sum(case when strategy = 'native-text' then size else 0 end) as n, sum(case when elem_idx % 5 = 0 then size * 2 else 0 end) as m from boxes group by 1) select slide_idx, cast(case when m > 0 then least(100, floor(100.0 * n / m + 0.5)) else 100 end as int) as pct from s")
def coverage_pct(spark, sf_dir):
    s = boxes(spark, sf_dir).groupBy("slide_idx").agg(F.sum(F.when(F.col("strategy") == "native-text", F.col("size")).otherwise(0)).alias("n"), F.sum(F.when(F.col("elem_idx") % 5 == 0, F.col("size") * 2).otherwise(0)).alias("m"))
    return s.select("slide_idx", validation.coverage(F.col("n"), F.col("m")).alias("pct"))


def checked(spark, sf_dir):
    chars = {"native_chars": F.when(F.col("strategy") == "native-text", F.col("size")).otherwise(0), "source_chars": F.when(F.col("elem_idx") % 5 == 0, F.col("size") * 2).otherwise(0)}
    return validation.issue_list(validation.slide_checks(boxes(spark, sf_dir).withColumns(chars)))


@query(f"with {CHECKS}, c2 as (select slide_idx, strategy, count(*) as n from boxes group by all), tally as (select slide_idx, string_agg(strategy || '=' || n, ',' order by strategy) as strategies from c2 group by 1) select slide_idx, 'slide-' || case when slide_idx < 10 then '0' else '' end || slide_idx as name, coverage_pct, strategies, n_text, n_collisions, n_off_canvas, n_clipped, array_to_string(issues, '; ') as issues, len(issues) > 0 as needs_review from checks join tally using (slide_idx)")
def validate_report(spark, sf_dir):
    """The flagship: every slide's checks and issues."""
    strategies = F.array_join(F.transform(F.map_entries("strategies"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return checked(spark, sf_dir).select("slide_idx", F.concat(F.lit("slide-"), pad_left(F.col("slide_idx").cast("string"), 2)).alias("name"), "coverage_pct", strategies.alias("strategies"), "n_text", "n_collisions", "n_off_canvas", "n_clipped", F.array_join("issues", "; ").alias("issues"), "needs_review")


@query(f"with {BOXES}, r as (select slide_idx, case when strategy = 'native-text' then 'text-layer' when strategy = 'image' and size > 20 then 'text-replace' else strategy end as s from boxes) select slide_idx, 100 as coverage_pct, false as needs_review, count(*) filter (s in ('text-layer', 'text-replace')) as text_count, count(*) filter (s = 'text-replace') = 0 as invisible, case when count(*) filter (s = 'text-replace') = 0 then 'image' else 'recon' end as kind from r group by 1")
def image_report(spark, sf_dir):
    s = F.col("strategy")
    r = boxes(spark, sf_dir).withColumn("strategy", F.when(s == "native-text", "text-layer").when((s == "image") & (F.col("size") > 20), "text-replace").otherwise(s))
    return validation.image_report(r).withColumn("kind", validation.slide_class(F.lit(True), F.col("invisible")))


FLAGS = f"{DRIFT}, flags as (select *, case kind when 'image' then 2.0 when 'recon' then 12.0 else 8.0 end as tolerance from drift), flagged as (select *, diff_pct is null or diff_pct > tolerance as flagged from flags)"


@query(f"with {FLAGS} select slide_idx, round(tolerance, 1) as tolerance, flagged, round(least(100, 75 * diff_pct / tolerance), 4) as meter from flagged")
def verify_flag(spark, sf_dir):
    v = validation.flag_drift(drift(spark, sf_dir))
    return v.select("slide_idx", F.round("tolerance", 1).alias("tolerance"), "flagged", F.round(validation.drift_meter(F.col("diff_pct"), F.col("tolerance")), 4).alias("meter"))


def reconciled(spark, sf_dir):
    return validation.reconcile(checked(spark, sf_dir), validation.flag_drift(drift(spark, sf_dir)).where("kind <> 'other'"))


RECON = f"""{CHECKS}, {FLAGS}, recon as (select c.slide_idx, f.diff_pct, f.tolerance, f.flagged, case when f.slide_idx is null then issues when f.flagged then list_append(issues, 'visual drift ' || coalesce(regexp_replace(cast(f.diff_pct as varchar), '\\.0$', ''), 'null') || '% (>' || regexp_replace(cast(cast(f.tolerance as double) as varchar), '\\.0$', '') || '%) @' || coalesce(f.region, 'undefined'))
  else list_filter(issues, lambda i: not regexp_matches(i, 'text collision|clipped/half-cut')) end as issues from checks c left join flagged f on f.slide_idx = c.slide_idx and f.kind <> 'other')"""


@query(f"with {RECON} select slide_idx, array_to_string(issues, '; ') as issues, len(issues) > 0 as needs_review from recon")
def reconcile_issues(spark, sf_dir):
    return reconciled(spark, sf_dir).select("slide_idx", F.array_join("issues", "; ").alias("issues"), "needs_review")


FIX = f"{RECON}, fix as (select *, len(issues) > 0 as needs_review, slide_idx % 9 = 0 as image_slide, slide_idx % 13 = 0 as failed from recon), picked as (select *, (coalesce(flagged, false) or needs_review) and not image_slide and not failed as picked from fix)"


def picked(spark, sf_dir):
    r = reconciled(spark, sf_dir).withColumns({"image_slide": F.col("slide_idx") % 9 == 0, "failed": F.col("slide_idx") % 13 == 0})
    return r.withColumn("picked", validation.needs_fix(F.col("flagged"), F.col("needs_review"), F.col("image_slide"), F.col("failed")))


@query(f"with {FIX} select slide_idx from picked where picked")
def autofix_select(spark, sf_dir):
    return picked(spark, sf_dir).where("picked").select("slide_idx")


AGAIN = f"""{FIX}, again as (select *, slide_idx % 300 / 100.0 as diff2 from picked), fixed as (select slide_idx, picked as auto_fixed, failed, case when picked then diff2 > 2.0 else needs_review end as needs_review, case when picked then diff2 else diff_pct end as diff_pct,
  case when picked then case when diff2 > 2.0 then 'visual drift ' || regexp_replace(cast(cast(diff2 as double) as varchar), '\\.0$', '') || '% (>2%) @[0,0,213,120]' else '' end else array_to_string(issues, '; ') end as issues from again)"""


@query(f"with {AGAIN}, t as (select slide_idx, count(*) as n from boxes where strategy = 'native-text' group by 1) select slide_idx, auto_fixed, needs_review, diff_pct, issues, case when auto_fixed then coalesce(n, 0) end as text_count from fixed left join t using (slide_idx)")
def retry_once(spark, sf_dir):
    return _after_fix(spark, sf_dir).select("slide_idx", "auto_fixed", "needs_review", "diff_pct", F.array_join("issues", "; ").alias("issues"), "text_count")


def _after_fix(spark, sf_dir):
    """Picked slides are done again as pictures with their text elements as an unseen layer, and compared anew."""
    b = boxes(spark, sf_dir)
    texts = b.where("strategy = 'native-text'").withColumns({"run_idx": F.lit(0), "text": F.concat(F.lit("t"), F.col("l_partkey").cast("string"))})
    sized = {"conf": F.lit(None).cast("int"), "bg": F.lit(None).cast("string"), "serif": F.lit(False), "mono": F.lit(False), "width": F.lit(1280), "height": F.lit(720)}
    layer = mapping.overlay_layer(mapping.fix_items(texts, ["slide_idx", "elem_idx"]).withColumns(sized), "invisible").select("slide_idx", "strategy")
    pictures = b.select("slide_idx").distinct().withColumn("strategy", F.lit("image"))
    diffs = pictures.select("slide_idx", (F.col("slide_idx") % 300 / 100.0).alias("diff_pct"), F.array(*[F.lit(v) for v in (0, 0, 213, 120)]).alias("worst_region"))
    again = validation.second_check(pictures.unionByName(layer), diffs)
    return validation.retry_once(picked(spark, sf_dir), again, F.col("picked"))


@query(f"with {AGAIN} select count(*) as slides, count(*) filter (needs_review) as reviews, count(*) filter (not needs_review) as verified, count(*) filter (failed) as failed, count(*) filter (auto_fixed) as auto_fixed, round(avg(diff_pct), 1) as avg_diff, round(max(diff_pct), 1) as max_diff from fixed")
def report_summary(spark, sf_dir):
    return validation.summary(_after_fix(spark, sf_dir))


@query(f"with {CHECKS}, c as (select slide_idx, len(issues) > 0 as r from checks) select 'all' as mode, slide_idx from c union all select 'ok', slide_idx from c where not r union all select 'rev', slide_idx from c where r")
def review_filter(spark, sf_dir):
    """Which slides each filter of the review page leaves visible."""
    return validation.shown_cards(checked(spark, sf_dir).select("slide_idx", "needs_review")).select("mode", "slide_idx")


@query("select o_orderkey as slide_idx, 0 as coverage_pct, 'conversion failed: ' || o_orderpriority as issues, true as needs_review, true as failed from orders where o_orderpriority = '1-URGENT'")
def failure_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_orderkey", "slide_idx")
    return validation.failure_rows(o, F.col("o_orderpriority")).withColumn("issues", F.array_join("issues", "; "))


MODES = {"plain": Options(), "fast": Options(fast=True), "overlay": Options(overlay_only=True), "fix": Options(auto_fix=True), "fix_3": Options(auto_fix=True, diff_threshold=3.0)}


def job_tables(spark, sf_dir) -> Job:
    """A job: every ninth slide is a picture, every other of these decomposed; every thirteenth failed."""
    k = F.col("slide_idx")
    b = boxes(spark, sf_dir)
    chars = {"native_chars": F.when(F.col("strategy") == "native-text", F.col("size")).otherwise(0), "source_chars": F.when(F.col("elem_idx") % 5 == 0, F.col("size") * 2).otherwise(0)}
    slides = b.select("slide_idx").distinct()
    region = F.array(*[F.lit(v) for v in (0, 0, 213, 120)])
    html = b.where(k % 9 != 0)
    return Job(
        elements=html.withColumns(chars),
        texts=html.where("strategy = 'native-text'").withColumns({"run_idx": F.lit(0), "text": F.concat(F.lit("t"), F.col("l_partkey").cast("string"))}),
        pictures=slides.where(k % 9 == 0).withColumns({"width": F.lit(1600), "height": F.lit(900), "decomposed": k % 2 == 0}),
        items=text_items(spark, sf_dir).where(k % 9 == 0).drop("width", "height"),
        parts=b.where(k % 9 == 0).where("strategy <> 'native-text'").withColumns({"kind": F.when(F.col("strategy") == "image", "art").otherwise("rect"), "radius": F.lit(4.0)}),
        embedded=text_items(spark, sf_dir).where("size > 24").select("slide_idx", "item_idx"),
        failures=slides.where(k % 13 == 0).withColumn("message", F.lit("no page")),
        drift=slides.select("slide_idx", F.when(k % 17 != 0, k % 1000 / 50.0).alias("diff_pct"), F.when(k % 17 != 0, region).alias("worst_region")),
        drift_again=slides.select("slide_idx", (k % 500 / 100.0).alias("diff_pct"), region.alias("worst_region")),
    )


JOB = f"""{CHECKS}, {ITEMS[len(BOXES) + 2 :]}, modes(mode, fast, overlay, fix, diff) as (values ('plain', false, false, false, null), ('fast', true, false, false, null), ('overlay', false, true, false, null), ('fix', false, false, true, null), ('fix_3', false, false, true, 3.0)),
layer as (select slide_idx, bool_or(case when slide_idx % 2 = 0 then size <= 24 else bg is not null end and (conf is null or conf >= 65)) as seen from items where trim(text) <> '' group by 1),
first as (select mode, fast, fix, diff, s.slide_idx, s.slide_idx % 13 = 0 as failed, s.slide_idx % 9 = 0 and s.slide_idx % 13 <> 0 as image, case when s.slide_idx % 9 = 0 and s.slide_idx % 13 <> 0 then case when coalesce(l.seen, false) and not overlay then 'recon' else 'image' end else 'html' end as kind,
  case when s.slide_idx % 13 = 0 then 0 when s.slide_idx % 9 = 0 then 100 else c.coverage_pct end as coverage_pct, case when s.slide_idx % 13 = 0 then ['conversion failed: no page'] when s.slide_idx % 9 = 0 then [] else c.issues end as issues
  from (select distinct slide_idx from boxes) s join modes on true left join checks c using (slide_idx) left join layer l using (slide_idx)),
met as (select *, not fast and not failed as met, case when not fast and not failed and slide_idx % 17 <> 0 then slide_idx % 1000 / 50.0 end as diff_pct, coalesce(diff, case kind when 'image' then 2.0 when 'recon' then 12.0 else 8.0 end) as tol from first),
flagged as (select *, case when met then diff_pct is null or diff_pct > tol end as flagged from met),
said as (select *, case when not met then len(issues) when flagged then len(issues) + 1 else len(list_filter(issues, lambda i: not regexp_matches(i, 'text collision|clipped/half-cut'))) end as n from flagged),
picked as (select *, fix and (coalesce(flagged, false) or n > 0) and not image and not failed as redo, slide_idx % 500 / 100.0 as diff2 from said)"""


@query(
    f"""with {JOB} select mode, slide_idx, case when redo then 'image' else kind end as kind, cast(case when redo then 100 else coverage_pct end as int) as coverage_pct, cast(case when redo then cast(diff2 > coalesce(diff, 2.0) as int) else n end as int) as n_issues,
    case when redo then diff2 > coalesce(diff, 2.0) else n > 0 end as needs_review, failed, redo as auto_fixed, case when redo then diff2 else diff_pct end as diff_pct, case when redo then coalesce(diff, 2.0) when met then tol end as tolerance, case when redo then diff2 > coalesce(diff, 2.0) else flagged end as flagged from picked"""
)
def convert_job(spark, sf_dir):
    """A whole job with each set of options."""
    out = convert_each(job_tables(spark, sf_dir), MODES)
    return out.select("mode", "slide_idx", "kind", "coverage_pct", F.size("issues").alias("n_issues"), "needs_review", "failed", "auto_fixed", "diff_pct", "tolerance", "flagged")
