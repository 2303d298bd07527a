"""Colour, font and style functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import half_up, leading_number, trim

# Fonts taken as installed.
INSTALLED = (
    "arial", "arial narrow", "arial black", "calibri", "calibri light", "cambria", "candara",
    "consolas", "constantia", "corbel", "courier new", "georgia", "impact", "lucida console",
    "lucida sans unicode", "palatino linotype", "segoe ui", "segoe ui semibold", "segoe ui light",
    "tahoma", "times new roman", "trebuchet ms", "verdana", "bahnschrift", "comic sans ms",
    "franklin gothic medium", "gabriola", "sylfaen", "symbol", "webdings", "wingdings",
)
# Words in a font stack that tell its class.
MONO = r"\bmono|consol|courier|menlo|monaco|cascadia|source ?code|fira ?code|jetbrains|ibm plex mono|ubuntu mono"
NARROW = "condensed|narrow|oswald|bebas|anton|barlow ?condensed|archivo ?narrow|pathway"
SERIF = r"times|georgia|garamond|merriweather|playfair|\blora\b|pt ?serif|noto ?serif|source ?serif|cambria|roboto ?slab|spectral|bitter|libre ?baskerville"


def hex2(c: Column) -> Column:
    """Two upper-case hex digits of a channel, clamped to 0..255."""
    return F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("long")), 2, "0")


def parse_color(c: Column) -> Column:
    """struct(hex, alpha): rgb()/rgba() and bare six-digit colours; (null, 0) for anything else.

    Channels are rounded half up and clamped; alpha is the fourth of exactly four parts, else 1.
    A channel that isn't a number gives a null hex.
    """
    inner = F.regexp_extract(c, r"(?i)rgba?\(([^)]+)\)", 1)
    parts = F.transform(F.split(inner, ","), leading_number)
    rgb = F.concat(*[hex2(half_up(F.get(parts, F.lit(i)))) for i in range(3)])
    alpha = F.when(F.size(parts) == 4, F.get(parts, F.lit(3))).otherwise(F.lit(1.0))
    plain = F.regexp_replace(c, "^([^#]*)#", "$1")
    return F.when(F.coalesce(inner, F.lit("")) != "", F.struct(rgb.alias("hex"), alpha.alias("alpha"))).when(
        plain.rlike("^[0-9a-fA-F]{6}$"), F.struct(F.upper(plain).alias("hex"), F.lit(1.0).alias("alpha"))
    ).otherwise(F.struct(F.lit(None).cast("string").alias("hex"), F.lit(0.0).alias("alpha")))


def hex_of(c: Column, fallback: str | None = None) -> Column:
    return F.coalesce(parse_color(c)["hex"], F.lit(fallback))


def first_face(stack: Column) -> Column:
    """The first family of a font stack without quotes; Arial if there is none."""
    return F.coalesce(F.nullif(trim(F.regexp_replace(F.get(F.split(stack, ","), F.lit(0)), "['\"]", "")), F.lit("")), F.lit("Arial"))


def system_font(stack: Column) -> Column:
    """An installed font for a font stack: the first family if installed, else by the stack's class."""
    first = trim(F.regexp_replace(F.get(F.split(stack, ","), F.lit(0)), "['\"]", ""))
    low = F.lower(stack)
    serif = (low.rlike(r"\bserif\b") & ~low.rlike("sans")) | low.rlike(SERIF)
    return (
        F.when(F.coalesce(stack, F.lit("")) == "", "Arial")
        .when(F.lower(first).isin(*INSTALLED), first)
        .when(low.rlike(MONO), "Consolas")
        .when(low.rlike(NARROW), "Arial Narrow")
        .when(serif, "Georgia")
        .otherwise("Arial")
    )


def class_font(serif: Column, mono: Column) -> Column:
    """The face of a text item: Georgia, Consolas or Arial."""
    return F.when(serif, "Georgia").when(mono, "Consolas").otherwise("Arial")


def align_of(c: Column) -> Column:
    return F.when(c.isin("center", "right"), c).otherwise("left")


def dash_of(c: Column) -> Column:
    return F.when(c == "dashed", "dash").when(c == "dotted", "sysDot").otherwise("solid")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def contrast(r: Column, g: Column, b: Column) -> Column:
    """Black on light colours, white on dark ones."""
    return F.when(luminance(r, g, b) > 128, "000000").otherwise("FFFFFF")


def quantise(v: Column) -> Column:
    """The middle of a channel's cell of 32."""
    return (F.floor(v / 32) * 32 + 16).cast("int")


def int_hex(c: Column) -> Column:
    """A colour number as six hex digits, lower case."""
    return F.lower(F.lpad(F.hex(c.bitwiseAND(0xFFFFFF)), 6, "0"))


def font_flags(flags: Column) -> Column:
    """struct(bold, italic, serif, mono) of a span's flag bits 16, 2, 4 and 8."""
    return F.struct(*[(flags.bitwiseAND(bit) != 0).alias(n) for n, bit in (("bold", 16), ("italic", 2), ("serif", 4), ("mono", 8))])


def has_fill(alpha: Column) -> Column:
    return alpha > 0.02


def has_border(widths: list[Column], alpha: Column) -> Column:
    return (F.greatest(*widths) > 0.4) & (alpha > 0.02)


def is_pattern(image: Column, size: Column) -> Column:
    """A gradient tiled at 64 or less is decoration."""
    small = F.exists(F.transform(F.split(size, r"[\s,]+"), leading_number), lambda n: (n > 0) & (n <= 64))
    return F.coalesce(image.contains("gradient") & size.rlike("[0-9]") & small, F.lit(False))


def is_glow(gradient: Column) -> Column:
    return F.coalesce(gradient.rlike(r"transparent|rgba\([^)]*,\s*0(\.0+)?\s*\)"), F.lit(False))


def gradient_average(gradient: Column) -> Column:
    """rgb(r,g,b) of the mean of a gradient's stops, rounded half up; null without stops."""
    stops = F.transform(F.regexp_extract_all(gradient, F.lit(r"(rgba?\([^)]+\))"), 1), lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"([0-9.]+)"), 1), lambda p: p.cast("double")))

    def mean(i: int) -> Column:
        return half_up(F.aggregate(stops, F.lit(0.0), lambda a, s: a + F.get(s, F.lit(i))) / F.size(stops)).cast("string")

    return F.when(F.size(stops) > 0, F.concat(F.lit("rgb("), mean(0), F.lit(","), mean(1), F.lit(","), mean(2), F.lit(")")))
