"""Boxes, trees and elements: queries over lineitem boxes and the region-nation-customer tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import geometry, mapping, tree
from vellum.plans.fixtures import BOXES, NODES, PATHS, boxes, nodes, table
from vellum.plans.registry import query

CLAMPED = """case when least(x - 40 + w, 1280) - greatest(0, x - 40) >= 0.5 and least(y - 20 + h, 720) - greatest(0, y - 20) >= 0.5 then {v} end"""


@query(
    f"""with {BOXES} select slide_idx, elem_idx, {CLAMPED.format(v='cast(greatest(0, x - 40) as bigint)')} as cx, {CLAMPED.format(v='cast(greatest(0, y - 20) as bigint)')} as cy,
    {CLAMPED.format(v='cast(least(x - 40 + w, 1280) - greatest(0, x - 40) as bigint)')} as cw, {CLAMPED.format(v='cast(least(y - 20 + h, 720) - greatest(0, y - 20) as bigint)')} as ch,
    cast(case when size % 4 = 0 then 1280 else floor(size * 40.25 + 0.5) end as bigint) as canvas_w from boxes"""
)
def clamp_rect(spark, sf_dir):
    b = boxes(spark, sf_dir)
    canvas = geometry.canvas_of(F.when(F.col("size") % 4 == 0, 0.0).otherwise(F.col("size") * 40.25), F.lit(720.0))
    bound = geometry.bound_of(F.struct(F.lit(1280).alias("w"), F.lit(720).alias("h")), F.lit(1000), F.lit(700))
    c = geometry.clamp(F.col("x") - 40, F.col("y") - 20, F.col("w"), F.col("h"), bound["w"], bound["h"])
    return b.select("slide_idx", "elem_idx", *[c[k].cast("long").alias(f"c{k}") for k in "xywh"], canvas["w"].alias("canvas_w"))


KIND = "case elem_idx % 4 when 0 then 'text' when 1 then 'shape' when 2 then 'img' else 'table' end"


def _elements(spark, sf_dir):
    kind = F.when(F.col("elem_idx") % 4 == 0, "text").when(F.col("elem_idx") % 4 == 1, "shape").when(F.col("elem_idx") % 4 == 2, "img").otherwise("table")
    return boxes(spark, sf_dir).withColumn("kind", kind)


FITS = f"""elems as (select *, {KIND} as kind from boxes), fits as (select slide_idx, least(greatest(1280, coalesce(max(case when kind <> 'shape' then x + w end), 0)), 1900) as fit_w,
  least(greatest(720, coalesce(max(case when kind <> 'shape' then y + h end), 0)), 1000) as fit_h from elems group by slide_idx)"""


@query(f"with {BOXES}, {FITS} select slide_idx, fit_w, fit_h, fit_w > 1281 or fit_h > 721 as overflow from fits")
def overflow_fit(spark, sf_dir):
    return geometry.overflow_fit(_elements(spark, sf_dir), bound=(1900, 1000))


@query(
    f"""with {BOXES}, {FITS}, c as (select e.slide_idx, elem_idx, z, x, y, least(x + w, fit_w) - x as w, least(y + h, fit_h) - y as h from elems e join fits using (slide_idx) where least(x + w, fit_w) - x >= 0.5 and least(y + h, fit_h) - y >= 0.5)
    select slide_idx, elem_idx, w, h, row_number() over (partition by slide_idx order by z, elem_idx) - 1 as op_idx from c"""
)
def z_order(spark, sf_dir):
    e = _elements(spark, sf_dir)
    return geometry.stacking_order(geometry.fitted(e, bound=(1900, 1000))).select("slide_idx", "elem_idx", "w", "h", "op_idx")


SCALE = "least(13.333 / cast(1280 + size * 8 as double), 7.5 / cast(720 + size * 3 as double))"


@query(
    f"""with {BOXES}, s as (select *, {SCALE} as s from boxes) select slide_idx, elem_idx, round((13.333 - (1280 + size * 8) * s) / 2 + x * s, 3) as ix, round((7.5 - (720 + size * 3) * s) / 2 + y * s, 3) as iy,
    greatest(round(w * s, 3), 0.05) as iw, greatest(round(h * s, 3), 0.05) as ih, greatest(round(size * s * 72, 1), 1) as pts, round(greatest(z * s * 72 * 0.85, 0.5), 3) as border from s"""
)
def letterbox_fit(spark, sf_dir):
    sw, sh = 1280 + F.col("size") * 8, 720 + F.col("size") * 3
    at, s = geometry.letterbox(F.col("x"), F.col("y"), F.col("w"), F.col("h"), sw, sh), geometry.scale(sw, sh)
    return boxes(spark, sf_dir).select("slide_idx", "elem_idx", *[at[k].alias(f"i{k}") for k in "xywh"], geometry.points(F.col("size"), s).alias("pts"), F.round(geometry.border_points(F.col("z"), s), 3).alias("border"))


@query(
    f"""with {BOXES}, a as (select *, (['left', 'center', 'right'])[1 + elem_idx % 3] as align, 13.333 / 1280 as s from boxes), b as (select *, h < greatest(size, 1) * 1.7 as one, case when h < greatest(size, 1) * 1.7 then round(greatest(size, 1) * 3 * s, 3) else round(w * s, 3) * 0.04 + round(8 * s, 3) end as more, round(x * s, 3) as px, round(w * s, 3) as pw from a),
    c as (select *, greatest(0, case align when 'center' then px - more / 2 when 'right' then px - more else px end) as tx from b) select slide_idx, elem_idx, round(tx, 4) as tx, round(least(pw + more, 13.333 - tx), 4) as tw, not one as wrap from c"""
)
def text_box_widen(spark, sf_dir):
    s = F.lit(13.333) / 1280
    place = F.struct(F.round(F.col("x") * s, 3).alias("x"), F.round(F.col("w") * s, 3).alias("w"))
    align = F.get(F.array(F.lit("left"), F.lit("center"), F.lit("right")), (F.col("elem_idx") % 3).cast("int"))
    t = geometry.widen_text(place, F.col("w"), F.col("h"), F.col("size"), align, s)
    return boxes(spark, sf_dir).select("slide_idx", "elem_idx", F.round(t["x"], 4).alias("tx"), F.round(t["w"], 4).alias("tw"), t["wrap"].alias("wrap"))


@query(
    f"""with {BOXES} select slide_idx, elem_idx, case when size % 2 = 0 then size / 50.0 * least(w, h) else cast(size as double) end as radius,
    (case when size % 2 = 0 then size / 50.0 * least(w, h) else size end) > 0 and abs((case when size % 2 = 0 then size / 50.0 * least(w, h) else size end) - least(w, h) / 2.0) < 3 as ellipse,
    cast(floor(degrees(atan2(size - 20, elem_idx + 1)) + 0.5) as bigint) as turn,
    case when size > 15 then 'root' when size > 12 then 'body' else 'rgb(255,255,255)' end as bg, w * h * 0.5 < 0.6 * w * h as cut_icon, w * h * 0.8 < 0.75 * w * h as cut_text from boxes"""
)
def shape_geometry(spark, sf_dir):
    size, w, h = F.col("size"), F.col("w"), F.col("h")
    r = geometry.radius_of(F.when(size % 2 == 0, F.concat((size * 2).cast("string"), F.lit("%"))).otherwise(F.concat(size.cast("string"), F.lit("px"))), w, h)
    matrix = F.concat(F.lit("matrix("), (F.col("elem_idx") + 1).cast("string"), F.lit(", "), (size - 20).cast("string"), F.lit(", 0, 1, 0, 0)"))
    bg = geometry.background(F.lit("root"), F.when(size > 15, 1.0).otherwise(0.0), F.lit("body"), F.when(size > 12, 1.0).otherwise(0.01))
    return boxes(spark, sf_dir).select("slide_idx", "elem_idx", r.alias("radius"), geometry.is_ellipse(r, w, h).alias("ellipse"), geometry.rotation(matrix).alias("turn"), bg.alias("bg"), geometry.clipped_share(w, h * 0.5, w, h, 0.6).alias("cut_icon"), geometry.clipped_share(w, h * 0.8, w, h, 0.75).alias("cut_text"))


@query(f"with recursive {NODES}, {PATHS} select a.leaf as node_id, coalesce(min_by(n.z, a.up) filter (where n.z is not null), 0) as z from anc a join nodes n using (node_id) group by 1")
def z_inherit(spark, sf_dir):
    return tree.with_z(nodes(spark, sf_dir).select("node_id", "parent_id", "z")).select("node_id", F.col("effective_z").alias("z"))


@query(
    f"""with recursive {NODES}, {PATHS}, e as (select a.leaf as node_id, max(n.x) as x0, max(n.y) as y0, min(n.x + n.w) as x1, min(n.y + n.h) as y1 from anc a join nodes n using (node_id) where a.up = 0 or n.clips group by 1)
    select node_id, case when x1 > x0 and y1 > y0 then x0 end as x, case when x1 > x0 and y1 > y0 then y0 end as y, case when x1 > x0 and y1 > y0 then x1 - x0 end as w, case when x1 > x0 and y1 > y0 then y1 - y0 end as h from e"""
)
def clip_inherit(spark, sf_dir):
    clipped = tree.with_clip(nodes(spark, sf_dir).select("node_id", "parent_id", "clips", "x", "y", "w", "h"))
    return clipped.select("node_id", *[F.col("clip")[k].alias(k) for k in "xywh"])


@query(
    f"""with recursive {NODES}, {PATHS}, k as (select a.leaf as node_id, bool_and(n.visible) as vis, bool_or(n.consumes and a.up > 0) as eaten from anc a join nodes n using (node_id) group by 1),
    o as (select n.node_id, row_number() over (partition by p.s[len(p.s)] order by list_reverse(p.s)) - 1 as doc_order from k join nodes n using (node_id) join (select a.leaf, list(m.sibling order by a.up) as s, max(a.up) as d from anc a join nodes m using (node_id) group by 1) p on p.leaf = n.node_id where vis and not eaten)
    select node_id, doc_order from o"""
)
def dom_order(spark, sf_dir):
    kept = tree.in_order(nodes(spark, sf_dir).select("node_id", "parent_id", "visible", "consumes", "sibling")).withColumn("slide_idx", F.get("place", F.lit(0)))
    return tree.document_order(kept, "slide_idx").select("node_id", "doc_order")


@query("select o_orderkey, o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 and o_orderkey % 4 <> 0 as visible, case when o_orderkey % 3 = 0 then 2 else 1 end as root_id from orders")
def visible_roots(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    vis = tree.is_visible(F.when(k % 5 == 0, "none").otherwise("block"), F.when(k % 7 == 0, "hidden").otherwise("visible"), F.when(k % 11 == 0, 0.0).otherwise(0.7), F.when(k % 4 == 0, 0.4).otherwise(3.0), F.lit(2.0))
    tags = o.select("o_orderkey", F.explode(F.array(F.struct(F.lit(1).alias("node_id"), F.lit("BODY").alias("tag"), F.lit("").alias("class"), F.lit(0).alias("doc_order")), F.struct(F.lit(2).alias("node_id"), F.lit("DIV").alias("tag"), F.when(k % 3 == 0, "a slide-container").otherwise("card").alias("class"), F.lit(1).alias("doc_order")))).alias("n")).select("o_orderkey", "n.*")
    # both sides have a row a slide; a key's column is so small in its file that the plan would broadcast one of them
    roots = tree.root_of(tags, "o_orderkey").hint("merge")
    return o.select("o_orderkey", vis.alias("visible")).join(roots, "o_orderkey").select("o_orderkey", "visible", "root_id")


@query(
    f"""with {BOXES}, b as (select *, l_linenumber % 2 as grp from boxes), p as (select slide_idx, elem_idx, z, grp, x + w * u.part as px, y + h / 2.0 as py from b, (values (0.25), (0.5), (0.75)) u(part)),
    i as (select * from p where px < 1280 and py < 720), c as (select i.slide_idx, i.elem_idx, px, exists (select 1 from b t where t.slide_idx = i.slide_idx and t.grp <> i.grp and (t.z > i.z or (t.z = i.z and t.elem_idx > i.elem_idx)) and px between t.x and t.x + t.w and py between t.y and t.y + t.h) as hit from i)
    select slide_idx, elem_idx, bool_and(hit) as occluded from c group by all"""
)
def occlusion(spark, sf_dir):
    return tree.occluded(boxes(spark, sf_dir).withColumn("group", F.col("l_linenumber") % 2))


RUNS = r"""runs as (select conv_id, turn, case when (conv_id + turn) % 5 = 2 then E' \n ' when (conv_id + turn) % 3 = 1 then E'\t' || replace(text, ' ', E' \n\n ') || ' ' else text end as text, case turn % 4 when 0 then 'BR' when 1 then 'SPAN' when 2 then 'SUB' else 'SUP' end as tag, case when turn % 3 = 0 then 700 else 400 end as weight from conversations)"""


def _runs(spark, sf_dir):
    t = F.col("turn")
    text = F.when((F.col("conv_id") + t) % 5 == 2, " \n ").when((F.col("conv_id") + t) % 3 == 1, F.concat(F.lit("\t"), F.replace("text", F.lit(" "), F.lit(" \n\n ")), F.lit(" "))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", t.alias("run_idx"), text.alias("text"), F.when(t % 4 == 0, "BR").when(t % 4 == 1, "SPAN").when(t % 4 == 2, "SUB").otherwise("SUP").alias("tag"), F.when(t % 3 == 0, 700).otherwise(400).alias("weight"), F.lit("italic").alias("style"))


@query(
    rf"""with {RUNS}, m as (select *, tag = 'BR' or trim(text, E' \t\n') <> '' as kept from runs), g as (select *, count(*) filter (kept) over (partition by conv_id order by turn) as run from m),
    k as (select conv_id, run, any_value(turn) filter (kept) as turn, any_value(text) filter (kept) as text, any_value(tag) filter (kept) as tag, any_value(weight) filter (kept) as weight, bool_or(tag = 'SUB') as sub, bool_or(tag = 'SUP') as sup from g where run > 0 group by all),
    f as (select *, coalesce(lead(tag = 'BR') over (partition by conv_id order by turn), false) as break_line from k)
    select conv_id, turn as run_idx, regexp_replace(text, '\s+', ' ', 'g') as text, weight >= 600 as bold, break_line, sub, sup from f where tag <> 'BR'"""
)
def fold_breaks(spark, sf_dir):
    runs = tree.text_runs(_runs(spark, sf_dir), ["conv_id"]).select("conv_id", F.explode("runs").alias("r")).select("conv_id", "r.*")
    return mapping.fold_breaks(runs, ["conv_id"]).select("conv_id", "run_idx", "text", "bold", "break_line", "sub", "sup")


@query(r"select conv_id, trim(regexp_replace(string_agg(text, '' order by turn), '\s+', ' ', 'g'), ' ') as text from conversations group by conv_id")
def direct_text(spark, sf_dir):
    return tree.direct_text(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


@query(
    f"""with {BOXES}, c as (select slide_idx, elem_idx // 3 as row_idx, elem_idx % 3 as col_idx, case when elem_idx % 7 = 6 then 0 else size end as wpx from boxes),
    r as (select slide_idx, row_idx, count(*) as n, list(wpx order by col_idx) as px, bool_and(wpx > 0) as ok, sum(wpx) as total from c group by all),
    w as (select slide_idx, arg_min(px, (-n, row_idx)) as px, arg_min(ok, (-n, row_idx)) as ok, arg_min(total, (-n, row_idx)) as total, count(*) as n_rows from r group by 1)
    select slide_idx, n_rows, case when ok then list_aggregate(list_transform(px, lambda v: cast(cast(floor(1000.0 * v / total * 10 + 0.5) as bigint) as varchar)), 'string_agg', ',') end as widths from w"""
)
def table_col_widths(spark, sf_dir):
    e = F.col("elem_idx")
    cells = boxes(spark, sf_dir).select("slide_idx", F.floor(e / 3).alias("row_idx"), (e % 3).alias("col_idx"), F.col("strategy").alias("text"), F.when(e % 5 == 0, "TH").otherwise("TD").alias("tag"), F.lit(400).alias("weight"), F.when(e % 7 == 6, 0).otherwise(F.col("size")).alias("wpx"))
    rows = tree.table_rows(cells, ["slide_idx"])
    widths = mapping.column_widths(F.col("rows"), F.lit(10000.0))
    return rows.select("slide_idx", F.size("rows").cast("long").alias("n_rows"), F.array_join(F.transform(widths, lambda v: F.floor(v + 0.5).cast("string")), ",").alias("widths"))


NODE_KINDS = ("chart", "TABLE", "TABLE", "svg", "IMG", "I", "DIV", "P", "CANVAS", "I")


@query(
    """select p_partkey, string_agg(kind, ',') as kinds from (select p_partkey, unnest(case p_partkey % 10 when 0 then ['chart'] when 1 then [case when p_size > 25 then 'table-image' else 'table' end] when 2 then [case when p_size > 25 then 'table-image' else 'table' end] when 3 then ['svg'] when 4 then ['img'] when 5 then ['icon'] when 8 then ['svg']
    else list_filter([case when p_size % 2 = 0 then 'shape' end, case when p_size % 3 = 0 and p_size % 5 <> 0 then 'text' end], lambda k: k is not null) end) as kind from part) group by 1"""
)
def classify_kind(spark, sf_dir):
    k, s = F.col("p_partkey") % 10, F.col("p_size")
    tag = F.get(F.array(*[F.lit(t) for t in NODE_KINDS]), k.cast("int"))
    rich = tree.is_rich_table(s > 40, F.when(s > 30, 0.5).otherwise(0.0), F.when(s > 25, 9).otherwise(0))
    kinds = tree.element_kinds(tag, k == 0, rich, F.when(k == 5, "fas fa-star").otherwise("x"), s % 2 == 0, s % 3 == 0, s % 5 == 0)
    out = table(spark, sf_dir, "part").select("p_partkey", kinds.alias("k")).where(F.size("k") > 0)
    return out.select("p_partkey", F.array_join("k", ",").alias("kinds"))


MAP_KINDS = ("text", "table", "shape", "chart", "icon", "svg", "img", "table-image", "video")


@query(
    "with m as (select p_partkey, p_size, ([" + ", ".join(f"'{k}'" for k in MAP_KINDS) + """])[1 + p_partkey % 9] as kind, p_size % 5 = 0 as glow from part)
    select p_partkey, case when kind in ('text', 'table') then kind when kind = 'shape' and not glow then 'shape' else 'image' end as op, case when kind in ('text', 'table') or (kind = 'shape' and not glow) then null when kind = 'table-image' then 'table' when kind = 'shape' then 'glow' else kind end as reason,
    case when p_size % 3 = 0 then '0A' || lpad(to_hex(p_size), 2, '0') || '01' when p_size % 3 = 1 then '010203' end as fill, case when p_size % 4 = 0 then 'ellipse' when p_size > 20 then 'roundRect' else 'rect' end as shape from m"""
)
def map_element(spark, sf_dir):
    s = F.col("p_size")
    o = mapping.operation(F.get(F.array(*[F.lit(k) for k in MAP_KINDS]), (F.col("p_partkey") % 9).cast("int")), s % 5 == 0)
    fill = mapping.shape_fill(F.concat(F.lit("rgba(10,"), s.cast("string"), F.lit(",1,"), F.when(s % 3 == 0, "0.9").otherwise("0.01"), F.lit(")")), F.when(s % 3 == 1, "rgb(1,2,3)"))
    return table(spark, sf_dir, "part").select("p_partkey", o["op"].alias("op"), o["reason"].alias("reason"), fill["hex"].alias("fill"), mapping.shape_type(s % 4 == 0, F.when(s > 20, 4.0).otherwise(0.2)).alias("shape"))


@query(
    """select p_partkey, case p_partkey % 4 when 0 then case when p_size > 5 then 'native-text' else 'empty' end when 1 then 'native-shape' when 2 then case when p_size > 5 then 'native-table' end else case when p_size % 7 = 0 then 'image-skipped' when p_size % 5 = 0 then 'image-failed' else 'image' end end as strategy from part"""
)
def emit_strategy(spark, sf_dir):
    k, s = F.col("p_partkey") % 4, F.col("p_size")
    op = F.get(F.array(*[F.lit(o) for o in ("text", "shape", "table", "image")]), k.cast("int"))
    n = F.when(s > 5, s).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", mapping.emit_strategy(op, n, n, s % 7 != 0, s % 5 == 0).alias("strategy"))


ITEMS = f"{BOXES}, items as (select slide_idx, elem_idx as item_idx, case when elem_idx % 6 = 5 then ' ' else 'line ' || l_partkey end as text, x, y, w, h, size, case when l_partkey % 4 <> 0 then l_partkey % 100 end as conf, case when l_partkey % 5 <> 0 then 'EEEEEE' end as bg, l_partkey % 3 = 0 as serif, l_partkey % 7 = 0 as mono, 1600 as width, 900 as height from boxes)"
PLACED = "case when serif then 'Georgia' when mono then 'Consolas' else 'Arial' end as face, greatest(round(size * (7.5 / 900) * 72, 1), 5) as points, round(greatest(round(w * (7.5 / 900), 3) * 1.15 + 0.05, 0.2), 6) as in_w"


def text_items(spark, sf_dir):
    k = F.col("l_partkey")
    return boxes(spark, sf_dir).select(
        "slide_idx", F.col("elem_idx").alias("item_idx"), F.when(F.col("elem_idx") % 6 == 5, " ").otherwise(F.concat(F.lit("line "), k.cast("string"))).alias("text"), "x", "y", "w", "h", "size", F.when(k % 4 != 0, k % 100).alias("conf"), F.when(k % 5 != 0, "EEEEEE").alias("bg"), (k % 3 == 0).alias("serif"), (k % 7 == 0).alias("mono"), F.lit(1600).alias("width"), F.lit(900).alias("height")
    )


def _shown(layer):
    return layer.select("slide_idx", "item_idx", "strategy", "face", "points", F.round("in_w", 6).alias("in_w"))


@query(f"with {ITEMS} select slide_idx, item_idx, case when size <= 24 and (conf is null or conf >= 65) then 'text-replace' else 'text-layer' end as strategy, {PLACED.replace('(7.5 / 900)', 'least(13.333 / 1600, 7.5 / 900)')} from items where trim(text) <> ''")
def decomposed_layer(spark, sf_dir):
    items = text_items(spark, sf_dir)
    return _shown(mapping.decomposed_layer(items, items.where("size > 24")))


@query(f"with {ITEMS} select slide_idx, item_idx, case when bg is not null and (conf is null or conf >= 65) then 'text-replace' else 'text-layer' end as strategy, {PLACED.replace('(7.5 / 900)', 'least(13.333 / 1600, 7.5 / 900)')} from items where trim(text) <> ''")
def overlay_layer(spark, sf_dir):
    return _shown(mapping.overlay_layer(text_items(spark, sf_dir)))


@query(f"with {ITEMS}, l as (select slide_idx, bg is not null and (conf is null or conf >= 65) as vis from items where trim(text) <> '') select slide_idx, not bool_or(vis) as invisible from l group by 1")
def invisible_slides(spark, sf_dir):
    return mapping.invisible_slides(mapping.overlay_layer(text_items(spark, sf_dir)))


BOUNDED = "case when least({x} + {w}, 1280) - greatest(0, {x}) >= 0.5 and least({y} + {h}, 720) - greatest(0, {y}) >= 0.5 then {v} end"


@query(
    f"""with {BOXES}, t as (select *, case when size % 3 = 0 then 0 else w // 2 end as tw, h // 2 as th from boxes), b as (select *, case when tw > 0.5 and th > 0.5 then x + 5 else x end as bx, case when tw > 0.5 and th > 0.5 then tw else w end as bw, case when tw > 0.5 and th > 0.5 then th else h end as bh from t)
    select slide_idx, elem_idx, {BOUNDED.format(x="x", y="y", w="w", h="h", v="cast(least(x + w, 1280) - greatest(0, x) as bigint)")} as whole_w,
    {BOUNDED.format(x="bx", y="y", w="bw", h="bh", v="cast(greatest(0, bx) as bigint)")} as text_x, {BOUNDED.format(x="bx", y="y", w="bw", h="bh", v="cast(least(bx + bw, 1280) - greatest(0, bx) as bigint)")} as text_w from b"""
)
def box_variants(spark, sf_dir):
    """Boxes bounded by the canvas only, and boxes of rendered text with the element's own as fallback."""
    own = geometry.box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    tight = geometry.box(F.col("x") + 5, F.col("y"), F.when(F.col("size") % 3 == 0, 0).otherwise(F.floor(F.col("w") / 2)), F.floor(F.col("h") / 2))
    whole = geometry.whole_box(own, F.lit(1280), F.lit(720))
    text = geometry.text_box(tight, geometry.box(*[F.col(c).cast("long") for c in "xywh"]), F.lit(1280), F.lit(720))
    return boxes(spark, sf_dir).select("slide_idx", "elem_idx", whole["w"].cast("long").alias("whole_w"), text["x"].cast("long").alias("text_x"), text["w"].cast("long").alias("text_w"))


@query("select o_custkey as parent_id, bool_or(o_orderkey % 5 >= 3) as block_child from orders group by 1")
def block_child(spark, sf_dir):
    """Whether a node has a block child: spans, icons and pictures are none, paragraphs and divisions are."""
    tags = F.array(*[F.lit(t) for t in ("SPAN", "I", "IMG", "P", "DIV")])
    return tree.block_children(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent_id"), F.get(tags, (F.col("o_orderkey") % 5).cast("int")).alias("tag")))


FIT = "least(13.333 / 1600.0, 7.5 / 900.0)"


@query(
    f"""with {BOXES}, p as (select *, case when strategy = 'native-shape' then size % 4 * 0.4 end as radius, {FIT} as s from boxes where strategy in ('native-shape', 'image'))
    select slide_idx, x, y, w, h, cast(case strategy when 'image' then 1 else 0 end as int) as layer, strategy, case strategy when 'image' then 'art' end as reason, case when strategy = 'native-shape' then case when radius > 0.5 then 'roundRect' else 'rect' end end as shape,
    round((13.333 - 1600 * s) / 2 + x * s, 3) as in_x, round((7.5 - 900 * s) / 2 + y * s, 3) as in_y, greatest(round(w * s, 3), 0.03) as in_w, greatest(round(h * s, 3), 0.03) as in_h,
    case when coalesce(radius, 0) > 0.5 then least(round(radius * s, 3), round(least(w, h) * s, 3) / 2) else 0.0 end as in_radius from p"""
)
def decomposed_shapes(spark, sf_dir):
    """Rectangles and artwork of rebuilt pictures, placed on the deck."""
    b = boxes(spark, sf_dir).withColumns({"width": F.lit(1600), "height": F.lit(900)})
    return mapping.decomposed_shapes(b.where("strategy = 'native-shape'").withColumn("radius", F.col("size") % 4 * 0.4), b.where("strategy = 'image'"))
