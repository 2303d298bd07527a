"""Names, types and links of inputs and assets; log and progress formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import pad_left, pad_right

# Content types by extension.
CONTENT_TYPES = {
    ".css": "text/css",
    ".woff2": "font/woff2",
    ".woff": "font/woff",
    ".ttf": "font/ttf",
    ".html": "text/html; charset=utf-8",
    ".js": "text/javascript",
    ".png": "image/png",
    ".svg": "image/svg+xml",
}
# Patterns of network addresses that local files stand in for, first match first.
LOCAL_ASSETS = (
    (r"tailwindcss|tailwind(\.min)?\.css", "/assets/tailwind/tailwind.generated.css"),
    (r"fontawesome|font-awesome", "/assets/fontawesome/all.min.css"),
    (r"fonts\.googleapis\.com", "/assets/fonts/fonts.css"),
    (r"echarts", "/assets/charts/echarts.min.js"),
    (r"chart\.?js|chart\.umd|chart\.min\.js", "/assets/charts/chart.min.js"),
)
# Links rewritten in the text of a page.
LINKS = (
    ("https?://[^\"']*tailwind[^\"']*\\.css", "/assets/tailwind/tailwind.generated.css"),
    ("https?://[^\"']*(?:fontawesome|font-awesome)[^\"']*\\.css", "/assets/fontawesome/all.min.css"),
    ("https?://fonts\\.googleapis\\.com/css2[^\"']*", "/assets/fonts/fonts.css"),
)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))


def is_media(name: Column) -> Column:
    return F.coalesce(name.rlike(r"(?i)\.(pdf|pptx?|png|jpe?g|webp|bmp|tiff?)$"), F.lit(False))


def is_image(name: Column) -> Column:
    return F.coalesce(name.rlike(r"(?i)\.(png|jpe?g|webp|bmp|tiff?)$"), F.lit(False))


def media_class(name: Column) -> Column:
    """pdf, pptx, image or html, by extension."""
    return F.when(name.rlike(r"(?i)\.pdf$"), "pdf").when(name.rlike(r"(?i)\.pptx?$"), "pptx").when(is_image(name), "image").otherwise("html")


def safe_name(name: Column, order: Column) -> Column:
    """An upload's file name: a three-digit order and the name with odd characters replaced."""
    return F.concat(pad_left(order.cast("string"), 3), F.lit("-"), F.regexp_replace(name, r"[^A-Za-z0-9_.\- ]+", "_"))


def upload_content(c: Column) -> Column:
    """Bytes of an upload: base64 after a data URL's head, else the text itself."""
    body = F.regexp_extract(c, r"(?s)^data:[^;]*;base64,(.*)$", 1)
    return F.when(c.rlike(r"(?s)^data:[^;]*;base64,"), F.unbase64(body)).otherwise(c.cast("binary"))


def badge(name: Column, slides: Column) -> Column:
    """What a tray entry shows: PDF, PPT, IMG, or its number of slides (at least 1)."""
    return F.when(name.rlike(r"(?i)\.pdf$"), "PDF").when(name.rlike(r"(?i)\.pptx?$"), "PPT").when(is_image(name), "IMG").otherwise(F.greatest(slides, F.lit(1)).cast("string"))


def content_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(known, extension(path)), F.lit("application/octet-stream"))


def local_asset(url: Column) -> Column:
    """The local file for a network address; null means blocked."""
    return F.coalesce(*[F.when(url.rlike(f"(?i){pattern}"), path) for pattern, path in LOCAL_ASSETS])


def rewrite_links(html: Column, base: str = "") -> Column:
    """Links to known libraries point to local files."""
    for pattern, path in LINKS:
        html = F.regexp_replace(html, f"(?i){pattern}", base + path)
    return html


def log_line(ts: Column, level: Column, scope: Column, *arguments: Column | tuple[Column, bool]) -> Column:
    """A log line of any number of arguments; (column, True) marks objects (structs, maps, arrays), which are written as JSON."""
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    parts = [F.to_json(a[0]) if isinstance(a, tuple) and a[1] else (a[0] if isinstance(a, tuple) else a).cast("string") for a in arguments]
    return F.concat(F.lit("["), stamp, F.lit("] ["), pad_right(level, 5), F.lit("] ["), scope, F.lit("] "), F.concat_ws(" ", *[F.coalesce(p, F.lit("null")) for p in parts]))


# Where the phases of a job lie on its bar.
BANDS = {"ingest": 0.02, "start": 0.05, "write": 0.63, "verify": 0.96, "refine-load": 0.955}


def progress_fraction(phase: Column, done: Column, total: Column) -> Column:
    """How far a job is, from its phase and counts; null for unknown phases."""
    fixed = F.coalesce(*[F.when(phase == name, F.lit(at)) for name, at in BANDS.items()])
    rendering = 0.05 + 0.57 * (done / F.greatest(total, F.lit(1)))
    refining = F.when(F.coalesce(total, F.lit(0)) != 0, 0.955 + 0.035 * (done / total)).otherwise(0.955)
    return F.when(phase == "slide", rendering).when(phase == "refine", refining).otherwise(fixed)


# What a job's bar says in its phases; the counts follow where a phase has them.
LABELS = {"ingest": "Reading input…", "write": "Writing deck…", "verify": "Verifying with PowerPoint…", "refine-load": "Refining drifted slides…", "refine": "Refining drifted slides…"}


def progress_label(phase: Column, done: Column, total: Column) -> Column:
    """What a job is doing, from its phase and counts; null for unknown phases."""
    count = F.concat(done.cast("string"), F.lit(" / "), total.cast("string"))
    begun = F.concat(F.lit("Rendering "), total.cast("string"), F.when(total > 1, " slides…").otherwise(" slide…"))
    return (
        F.when(phase == "slide", F.concat(F.lit("Rendering slide "), count))
        .when(phase == "start", begun)
        .when((phase == "refine") & (F.coalesce(total, F.lit(0)) != 0), F.concat(F.lit("Refining slide "), count))
        .otherwise(F.coalesce(*[F.when(phase == p, F.lit(text)) for p, text in LABELS.items()]))
    )


def progress_kind(phase: Column) -> Column:
    """struct(indet, slow): bars without a known end, and phases that take long."""
    return F.struct((phase == "ingest").alias("indet"), phase.isin("verify", "refine-load", "refine").alias("slow"))


def time_left(elapsed: Column, fraction: Column) -> Column:
    """Elapsed * (1 - f) / f, where 0.06 < f < 0.999; else null."""
    return F.when((fraction > 0.06) & (fraction < 0.999), elapsed * (1 - fraction) / fraction)
