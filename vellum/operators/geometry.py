"""Boxes: clipping, fitting, stacking and placing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import half_up, leading_number

CANVAS = (1280, 720)
DECK = (13.333, 7.5)
# Kinds whose extent makes a canvas grow.
CONTENT_KINDS = ("text", "table", "table-image", "icon", "img")


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def canvas_of(width: Column, height: Column) -> Column:
    """Rounded root size; 0 or null count as 1280 x 720."""
    w = F.coalesce(F.nullif(half_up(width), F.lit(0)), F.lit(CANVAS[0]))
    h = F.coalesce(F.nullif(half_up(height), F.lit(0)), F.lit(CANVAS[1]))
    return F.struct(w.alias("w"), h.alias("h"))


def bound_of(canvas: Column, scroll_w: Column, scroll_h: Column) -> Column:
    """The larger of canvas and scroll extent."""
    return F.struct(F.greatest(canvas["w"], scroll_w).alias("w"), F.greatest(canvas["h"], scroll_h).alias("h"))


def clamp(x: Column, y: Column, w: Column, h: Column, bound_w: Column, bound_h: Column) -> Column:
    """The box inside [0, bound], rounded; null if a side is under half a pixel."""
    x0, y0 = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y)
    x1, y1 = F.least(x + w, bound_w), F.least(y + h, bound_h)
    return F.when((x1 - x0 >= 0.5) & (y1 - y0 >= 0.5), box(half_up(x0), half_up(y0), half_up(x1 - x0), half_up(y1 - y0)))


def whole_box(own: Column, bound_w: Column, bound_h: Column) -> Column:
    """A box bounded by the canvas only, for small marks that are meant to be seen whole."""
    return clamp(own["x"], own["y"], own["w"], own["h"], bound_w, bound_h)


def text_box(text: Column, own: Column, bound_w: Column, bound_h: Column) -> Column:
    """The box of an element's rendered text (clipped as its own box is), where that is over half a pixel each way; else its own box."""
    tight = F.when((text["w"] > 0.5) & (text["h"] > 0.5), text).otherwise(own)
    return clamp(tight["x"], tight["y"], tight["w"], tight["h"], bound_w, bound_h)


def px_to_inches(px: Column) -> Column:
    """At 96 pixels an inch."""
    return px / 96.0


def px_to_points(px: Column) -> Column:
    return px * 0.75


def overlap_area(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    ox = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    oy = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    return ox * oy


def overflow_fit(df: DataFrame, slide: str = "slide_idx", bound: tuple[int, int] = (1 << 30, 1 << 30), canvas: tuple[int, int] = CANVAS) -> DataFrame:
    """Per slide the canvas grown to its content, within the bound: fit_w, fit_h, overflow.

    Columns read: kind, x, y, w, h. Partial maxima are taken before the shuffle.
    """
    content = F.col("kind").isin(*CONTENT_KINDS)
    grown = df.groupBy(slide).agg(F.max(F.when(content, F.col("x") + F.col("w"))).alias("mx"), F.max(F.when(content, F.col("y") + F.col("h"))).alias("my"))
    fit_w = F.least(F.greatest(F.lit(canvas[0]), F.coalesce("mx", F.lit(0))), F.lit(bound[0]))
    fit_h = F.least(F.greatest(F.lit(canvas[1]), F.coalesce("my", F.lit(0))), F.lit(bound[1]))
    return grown.select(slide, fit_w.alias("fit_w"), fit_h.alias("fit_h"), ((fit_w > canvas[0] + 1) | (fit_h > canvas[1] + 1)).alias("overflow"))


def fitted(df: DataFrame, slide: str = "slide_idx", bound: tuple[int, int] = (1 << 30, 1 << 30), canvas: tuple[int, int] = CANVAS) -> DataFrame:
    """Elements clamped to their slide's grown canvas; what lies outside is dropped.

    The canvas is a window over the slide, so it shares the shuffle of a stacking order that follows.
    """
    content, whole = F.col("kind").isin(*CONTENT_KINDS), Window.partitionBy(slide)
    grown = lambda end, least, most: F.least(F.greatest(F.lit(least), F.coalesce(F.max(F.when(content, end)).over(whole), F.lit(0))), F.lit(most))
    fits = df.withColumns({"_w": grown(F.col("x") + F.col("w"), canvas[0], bound[0]), "_h": grown(F.col("y") + F.col("h"), canvas[1], bound[1])})
    c = clamp(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("_w"), F.col("_h"))
    return fits.withColumn("_c", c).where(F.col("_c").isNotNull()).withColumns({k: F.col(f"_c.{k}") for k in ("x", "y", "w", "h")}).drop("_c", "_w", "_h")


def stacking_order(df: DataFrame, slide: str = "slide_idx", z: str = "z", index: str = "elem_idx") -> DataFrame:
    """op_idx: the place by (z, original index); a null z counts as 0."""
    w = Window.partitionBy(slide).orderBy(F.coalesce(F.col(z), F.lit(0)), F.col(index))
    return df.withColumn("op_idx", F.row_number().over(w) - 1)


def background(root: Column, root_alpha: Column, body: Column, body_alpha: Column) -> Column:
    """The root's colour if it shows, else the body's, else white."""
    return F.when(root_alpha > 0.02, root).when(body_alpha > 0.02, body).otherwise("rgb(255,255,255)")


def rotation(transform: Column) -> Column:
    """Degrees of a two-dimensional matrix(a, b, ...), rounded half up; 0 for anything else."""
    m = F.transform(F.split(F.regexp_extract(transform, r"^matrix\(([^)]+)\)", 1), ","), leading_number)
    return F.coalesce(F.when(transform.rlike(r"^matrix\("), half_up(F.degrees(F.atan2(F.get(m, F.lit(1)), F.get(m, F.lit(0)))))), F.lit(0)).cast("long")


def radius_of(value: Column, w: Column, h: Column) -> Column:
    """Pixels of a corner radius; percentages are of the smaller side."""
    n = F.coalesce(leading_number(value), F.lit(0.0))
    return F.when(value.contains("%"), n / 100 * F.least(w, h)).otherwise(n)


def is_ellipse(radius: Column, w: Column, h: Column) -> Column:
    return (radius > 0) & (F.abs(radius - F.least(w, h) / 2) < 3)


def scale(w: Column, h: Column) -> Column:
    """Inches a pixel when the slide is fitted into the deck."""
    return F.least(F.lit(DECK[0]) / w, F.lit(DECK[1]) / h)


def letterbox(x: Column, y: Column, w: Column, h: Column, slide_w: Column, slide_h: Column, floor: float = 0.05) -> Column:
    """Deck placement in inches, to 3 decimals; sides have a least size."""
    s = scale(slide_w, slide_h)
    off_x, off_y = (DECK[0] - slide_w * s) / 2, (DECK[1] - slide_h * s) / 2
    return box(F.round(off_x + x * s, 3), F.round(off_y + y * s, 3), F.greatest(F.round(w * s, 3), F.lit(floor)), F.greatest(F.round(h * s, 3), F.lit(floor)))


def points(px: Column, s: Column, least: float = 1) -> Column:
    """Font size in points, to 1 decimal, with a least size."""
    return F.greatest(F.round(px * s * 72, 1), F.lit(least))


def border_points(width: Column, s: Column) -> Column:
    return F.greatest(width * s * 72 * 0.85, F.lit(0.5))


def widen_text(place: Column, w: Column, h: Column, size: Column, align: Column, s: Column) -> Column:
    """struct(x, w, wrap): room for wider letters, added on the side the text is free to grow to."""
    most = F.greatest(size, F.lit(1))
    single = h < most * 1.7
    add = F.when(single, F.round(most * 3 * s, 3)).otherwise(F.round(w * s, 3) * 0.04 + F.round(8 * s, 3))
    x = F.greatest(F.lit(0.0), F.when(align == "center", place["x"] - add / 2).when(align == "right", place["x"] - add).otherwise(place["x"]))
    return F.struct(x.alias("x"), F.least(place["w"] + add, DECK[0] - x).alias("w"), (~single).alias("wrap"))


def clipped_share(visible_w: Column, visible_h: Column, whole_w: Column, whole_h: Column, share: float) -> Column:
    """Whether less than the share of the whole area is visible (0.6 for icons, 0.75 for text)."""
    return (whole_w * whole_h > 0) & (visible_w * visible_h < share * whole_w * whole_h)
