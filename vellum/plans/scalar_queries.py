"""Colours, fonts, styles, numbers, logs, progress: queries over derived strings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellum.functions import color, media
from vellum.operators import lifecycle
from vellum.operators.geometry import px_to_inches, px_to_points
from vellum.plans.fixtures import table
from vellum.plans.registry import query
from vellum.session import scratch
from vellum.sources import sinks

COLOURS = """colours as (select p_partkey, case p_partkey % 5
  when 0 then 'rgba(' || p_partkey % 300 || ', ' || p_size || '.5, 7, 0.' || p_partkey % 10 || ')'
  when 1 then 'rgb(' || p_partkey % 256 || ',' || p_size || ',' || p_partkey % 99 || ')'
  when 2 then '#' || lpad(lower(to_hex(p_partkey * 977 % 16777216)), 6, '0')
  when 3 then 'transparent' else 'RGBA(1,2,3)' end as c from part)"""


def _colours(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    c = F.when(k % 5 == 0, cat("rgba(", k % 300, ", ", s, ".5, 7, 0.", k % 10, ")")).when(k % 5 == 1, cat("rgb(", k % 256, ",", s, ",", k % 99, ")")).when(k % 5 == 2, cat("#", F.lpad(F.lower(F.hex(k * 977 % 16777216)), 6, "0"))).when(k % 5 == 3, "transparent").otherwise("RGBA(1,2,3)")
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("c"))


@query(
    rf"""with {COLOURS}, p as (select p_partkey, c, list_transform(string_split(nullif(regexp_extract(c, 'rgba?\(([^)]+)\)', 1, 'i'), ''), ','), lambda x: cast(trim(x) as double)) as v from colours)
    select p_partkey, case when v is not null then list_aggregate(list_transform(v[1:3], lambda x: lpad(to_hex(cast(greatest(0, least(255, floor(x + 0.5))) as bigint)), 2, '0')), 'string_agg', '')
      when regexp_matches(replace(c, '#', ''), '^[0-9a-fA-F]{{6}}$') then upper(replace(c, '#', '')) end as hex,
      cast(case when v is not null then case when len(v) = 4 then v[4] else 1 end when regexp_matches(replace(c, '#', ''), '^[0-9a-fA-F]{{6}}$') then 1 else 0 end as double) as alpha, coalesce(hex, 'FFFFFF') as shown from p"""
)
def parse_color(spark, sf_dir):
    p = color.parse_color(F.col("c"))
    return _colours(spark, sf_dir).select("p_partkey", p["hex"].alias("hex"), p["alpha"].alias("alpha"), color.hex_of(F.col("c"), "FFFFFF").alias("shown"))


STACKS = ("'Segoe UI', Tahoma, sans-serif", '"JetBrains Mono", monospace', "Oswald, sans-serif", "Playfair Display, serif", "Inter, Helvetica, sans-serif", "Noto Sans Serif Mix", "", "Georgia", "Roboto Slab, serif", "system-ui, serif")


def _stacks():
    return F.get(F.array(*[F.lit(s) for s in STACKS]), (F.col("p_partkey") % len(STACKS)).cast("int"))


SQL_STACKS = "stacks as (select p_partkey, p_size, ([" + ", ".join("'" + s.replace("'", "''") + "'" for s in STACKS) + f"])[1 + p_partkey % {len(STACKS)}] as s from part), firsts as (select *, trim(regexp_replace(string_split(s, ',')[1], '[''\"]', '', 'g')) as f from stacks)"


@query(
    rf"""with {SQL_STACKS} select p_partkey, coalesce(nullif(f, ''), 'Arial') as face, case when s = '' then 'Arial' when lower(f) in ('segoe ui', 'georgia') then f
      when regexp_matches(lower(s), '{color.MONO}') then 'Consolas' when regexp_matches(lower(s), '{color.NARROW}') then 'Arial Narrow'
      when (regexp_matches(lower(s), '\bserif\b') and not regexp_matches(lower(s), 'sans')) or regexp_matches(lower(s), '{color.SERIF}') then 'Georgia' else 'Arial' end as font,
      case when p_size & 4 <> 0 then 'Georgia' when p_size & 8 <> 0 then 'Consolas' else 'Arial' end as item_face from firsts"""
)
def system_font(spark, sf_dir):
    flags = color.font_flags(F.col("p_size"))
    return table(spark, sf_dir, "part").withColumn("s", _stacks()).select("p_partkey", color.first_face(F.col("s")).alias("face"), color.system_font(F.col("s")).alias("font"), color.class_font(flags["serif"], flags["mono"]).alias("item_face"))


@query(
    """select p_partkey, case when a in ('center', 'right') then a else 'left' end as align, case d when 'dashed' then 'dash' when 'dotted' then 'sysDot' else 'solid' end as dash, p_size / 96.0 as inches, p_size * 0.75 as pts
    from (select *, (['left', 'center', 'right', 'justify', 'start'])[1 + p_partkey % 5] as a, (['solid', 'dashed', 'dotted', 'double'])[1 + p_partkey % 4] as d from part)"""
)
def align_dash(spark, sf_dir):
    pick = lambda v: F.get(F.array(*[F.lit(x) for x in v]), (F.col("p_partkey") % len(v)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", color.align_of(pick(("left", "center", "right", "justify", "start"))).alias("align"), color.dash_of(pick(("solid", "dashed", "dotted", "double"))).alias("dash"), px_to_inches(F.col("p_size")).alias("inches"), px_to_points(F.col("p_size")).alias("pts"))


@query(
    """select p_partkey, case when 0.299 * r + 0.587 * g + 0.114 * b > 128 then '000000' else 'FFFFFF' end as contrast, r // 32 * 32 + 16 as quantised, lower(lpad(to_hex(p_partkey * 977 % 16777216), 6, '0')) as hex,
    p_size & 16 <> 0 as bold, p_size & 2 <> 0 as italic, p_size & 4 <> 0 as serif, p_size & 8 <> 0 as mono
    from (select *, p_partkey % 256 as r, p_partkey * 7 % 256 as g, p_partkey * 13 % 256 as b from part)"""
)
def pixel_scalars(spark, sf_dir):
    k = F.col("p_partkey")
    r, g, b = k % 256, k * 7 % 256, k * 13 % 256
    return table(spark, sf_dir, "part").select("p_partkey", color.contrast(r, g, b).alias("contrast"), color.quantise(r).alias("quantised"), color.int_hex(k * 977).alias("hex"), color.font_flags(F.col("p_size")).alias("f")).select("p_partkey", "contrast", "quantised", "hex", "f.*")


GRADIENTS = """gradients as (select p_partkey, 'linear-gradient(90deg, rgba(' || p_partkey % 256 || ', 10, 20, ' || case when p_partkey % 3 = 0 then '0' else '0.5' end || ') 0%, rgb(' || p_size || ', 200, 31) 100%)' as grad,
  case when p_partkey % 4 = 0 then p_size || 'px ' || p_size * 3 || 'px' else 'auto' end as bg_size from part)"""


@query(
    rf"""with {GRADIENTS} select p_partkey, 'rgb(' || cast(floor((p_partkey % 256 + cast(regexp_extract(grad, 'rgb\((\d+)', 1) as int)) / 2.0 + 0.5) as int) || ',105,26)' as mean,
    regexp_matches(grad, 'transparent|rgba\([^)]*,\s*0(\.0+)?\s*\)') as glow,
    bg_size <> 'auto' and (cast(regexp_extract(bg_size, '^(\d+)', 1) as int) between 1 and 64 or cast(regexp_extract(bg_size, ' (\d+)', 1) as int) between 1 and 64) as pattern from (select g.*, '' as q from gradients g) where bg_size <> 'auto'
    union all select p_partkey, 'rgb(' || cast(floor((p_partkey % 256 + cast(regexp_extract(grad, 'rgb\((\d+)', 1) as int)) / 2.0 + 0.5) as int) || ',105,26)', regexp_matches(grad, 'transparent|rgba\([^)]*,\s*0(\.0+)?\s*\)'), false from gradients where bg_size = 'auto'"""
)
def gradient_average(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    grad = F.concat(F.lit("linear-gradient(90deg, rgba("), (k % 256).cast("string"), F.lit(", 10, 20, "), F.when(k % 3 == 0, "0").otherwise("0.5"), F.lit(") 0%, rgb("), s, F.lit(", 200, 31) 100%)"))
    size = F.when(k % 4 == 0, F.concat(s, F.lit("px "), (F.col("p_size") * 3).cast("string"), F.lit("px"))).otherwise("auto")
    return table(spark, sf_dir, "part").select("p_partkey", color.gradient_average(grad).alias("mean"), color.is_glow(grad).alias("glow"), color.is_pattern(grad, size).alias("pattern"))


@query("select p_partkey, p_size / 10.0 > 0.4 and p_partkey % 100 > 2 as border, p_partkey % 100 > 2 as fill from part")
def fill_border(spark, sf_dir):
    a = F.col("p_partkey") % 100 / 100.0
    widths = [F.col("p_size") / 10.0 - 0.1 * i for i in range(4)]
    return table(spark, sf_dir, "part").select("p_partkey", color.has_border(widths, a).alias("border"), color.has_fill(a).alias("fill"))


LOGS = "logs as (select event_id, ts, (['INFO', 'WARN', 'ERROR', 'DEBUG'])[1 + event_id % 4] as level, event_type as scope, props as message from events)"


def log_rows(spark, sf_dir):
    levels = F.array(*[F.lit(x) for x in ("INFO", "WARN", "ERROR", "DEBUG")])
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.get(levels, (F.col("event_id") % 4).cast("int")).alias("level"), F.col("event_type").alias("scope"), F.col("props").alias("message"))


@query(f"""with {LOGS} select event_id, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z] [' || rpad(level, 5, ' ') || '] [' || scope || '] ' || message || case when event_id % 2 = 0 then ' {{"id":' || event_id || ',"kind":"' || scope || '"}}' else ' null' end as line, level in ('WARN', 'ERROR') as alert from logs""")
def log_lines(spark, sf_dir):
    return log_rows(spark, sf_dir).select("event_id", media.log_line(F.col("ts"), F.col("level"), F.col("scope"), F.col("message"), (F.when(F.col("event_id") % 2 == 0, F.struct(F.col("event_id").alias("id"), F.col("scope").alias("kind"))), True)).alias("line"), sinks.is_alert(F.col("level")).alias("alert"))


@query(f"with {LOGS} select cast(cast(ts as date) as varchar) as day, 'all' as part, count(*) as n from logs group by 1 union all select cast(cast(ts as date) as varchar), 'alerts', count(*) from logs where level in ('WARN', 'ERROR') group by 1")
def written_logs(spark, sf_dir):
    """Logs written by day, warnings and errors also on their own, and read back."""
    folder = f"{scratch(spark)}/logs-{uuid.uuid4().hex}"
    sinks.write_logs(log_rows(spark, sf_dir), folder)
    parts = [spark.read.parquet(f"{folder}/{p}").groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")).select("day", F.lit(p).alias("part"), "n") for p in ("all", "alerts")]
    return parts[0].unionByName(parts[1])


@query(f"with {LOGS}, m as (select max(ts) as now from logs) select level, count(*) as n, min(event_id) as first_id from logs, m where ts >= now - interval 14 day group by level")
def log_retention(spark, sf_dir):
    logs = log_rows(spark, sf_dir)
    now = logs.agg(F.max("ts")).scalar()
    return lifecycle.retained(logs, "ts", now).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


PHASES = ("ingest", "start", "slide", "write", "verify", "refine-load", "refine", "other")
PROGRESS = "progress as (select event_id, user_id as job_id, event_id as seq, ([" + ", ".join(f"'{p}'" for p in PHASES) + "])[1 + event_id % 8] as phase, event_id % 12 as done, 12 as total, value from events)"
FRACTION = "case phase when 'ingest' then 0.02 when 'start' then 0.05 when 'slide' then 0.05 + 0.57 * (done / total) when 'write' then 0.63 when 'verify' then 0.96 when 'refine-load' then 0.955 when 'refine' then 0.955 + 0.035 * (done / total) end"


def progress(spark, sf_dir):
    phases = F.array(*[F.lit(p) for p in PHASES])
    p = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.get(phases, (F.col("event_id") % 8).cast("int")).alias("phase"), (F.col("event_id") % 12).alias("done"), F.lit(12).alias("total"), "value")
    return p.withColumn("fraction", media.progress_fraction(F.col("phase"), F.col("done"), F.col("total")))


@query(
    f"""with {PROGRESS}, f as (select *, {FRACTION} as fraction from progress) select event_id, round(fraction, 6) as fraction, case when fraction > 0.06 and fraction < 0.999 then round(value * (1 - fraction) / fraction, 4) end as eta,
    case phase when 'slide' then 'Rendering slide ' || done || ' / ' || total when 'refine' then 'Refining slide ' || done || ' / ' || total when 'ingest' then 'Reading input…' when 'start' then 'Rendering ' || total || ' slides…' when 'write' then 'Writing deck…' when 'verify' then 'Verifying with PowerPoint…' when 'refine-load' then 'Refining drifted slides…' end as label,
    phase = 'ingest' as indet, phase in ('verify', 'refine-load', 'refine') as slow from f"""
)
def progress_fraction(spark, sf_dir):
    p = progress(spark, sf_dir)
    return p.select("event_id", F.round("fraction", 6).alias("fraction"), F.round(media.time_left(F.col("value"), F.col("fraction")), 4).alias("eta"), media.progress_label(F.col("phase"), F.col("done"), F.col("total")).alias("label"), media.progress_kind(F.col("phase")).alias("k")).select("event_id", "fraction", "eta", "label", "k.*")


@query(f"with {PROGRESS}, f as (select *, {FRACTION} as fraction from progress) select job_id, seq, round(max(fraction) over (partition by job_id order by seq rows unbounded preceding), 6) as shown from f")
def progress_monotone(spark, sf_dir):
    return lifecycle.monotone(progress(spark, sf_dir), "job_id", ["seq"], "fraction").select("job_id", "seq", F.round("shown", 6).alias("shown"))


@query(
    """with f as (select event_id, event_id % 4 as kind from events) select event_id, cast(0 as int) as frame_idx, case kind when 0 then 'progress' else 'done' end as type, case kind when 0 then 'slide' end as phase, event_id % 7 as done from f where kind <= 1
    union all select event_id, 2, 'progress', 'write', event_id % 5 from f"""
)
def sse_frames(spark, sf_dir):
    """Event streams with events of two types, broken JSON, a frame without data, and an end that isn't complete."""
    i = F.col("event_id")
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    first = F.when(i % 4 == 0, text('data: {"type":"progress","phase":"slide","done":', i % 7, "}")).when(i % 4 == 1, text('data:{"type":"done","done":', i % 7, "}")).otherwise('data: {"type":"progress","phase":')
    stream = text(first, "\n\n: nothing\n\n", 'event: x\ndata: {"type":"progress","phase":"write","done":', i % 5, "}\n\n", 'data: {"type":"progress","phase":"verify","done":1}')
    out = lifecycle.event_frames(table(spark, sf_dir, "events").select("event_id", stream.alias("stream")), "stream", "type string, phase string, done long")
    return out.select("event_id", "frame_idx", "event.type", "event.phase", "event.done")


@query("select p_brand, p_type, n, first_part from (select p_brand, p_type, count(*) as n, min(p_partkey) as first_part, arg_min(p_size, p_partkey) as s from part group by all) where s >= 10")
def ingest_memo(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    requests = part.select("p_brand", "p_type", F.col("p_partkey").alias("first_part"))
    missing = part.where("p_size < 10").select(F.col("p_partkey").alias("first_part"))
    memo = lifecycle.ingest_memo(requests, ["p_brand", "p_type"], "first_part", missing, "first_part")
    return memo.join(part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")), ["p_brand", "p_type"])


@query("""select 'job-' || o_custkey % 10 as job_id, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' as report from orders""")
def job_reports(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("job_id", F.concat(F.lit("job-"), (F.col("o_custkey") % 10).cast("string")))
    return sinks.job_report(o, "job_id", ["o_orderkey", "o_orderstatus"])


@query("select ext as kind, count(*) as files, ext in ('html', 'txt', 'png', 'jpeg') as read from (select (['html', 'TXT', 'pdf', 'png', 'pptx', 'jpeg', ''])[1 + page_id % 7] as e, case when lower(e) = '' then 'none' else lower(e) end as ext from pages) group by 1")
def capabilities(spark, sf_dir):
    """Which kinds among the files given can be read here."""
    kind = F.get(F.array(*[F.lit(k) for k in (".html", ".TXT", ".pdf", ".png", ".pptx", ".jpeg", "")]), (F.col("page_id") % 7).cast("int"))
    return lifecycle.capabilities(table(spark, sf_dir, "pages").select(F.concat(F.lit("in/f"), "page_id", kind).alias("file")), "file")
