"""From elements to placed operations, and from operations to what is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.color import class_font, parse_color
from vellum.functions.text import trim
from vellum.operators.geometry import letterbox, points, scale


def operation(kind: Column, glow: Column) -> Column:
    """struct(op, reason): the most editable form an element can have."""
    op = F.when(kind.isin("text", "table"), kind).when((kind == "shape") & ~F.coalesce(glow, F.lit(False)), "shape").otherwise("image")
    reason = F.when(kind == "table-image", "table").when(kind == "shape", "glow").otherwise(kind)
    return F.struct(op.alias("op"), F.when(op == "image", reason).alias("reason"))


def shape_fill(fill: Column, gradient_mean: Column) -> Column:
    """struct(hex, alpha): the own fill if it shows, else the gradient's mean as solid; null for none."""
    own, mean = parse_color(fill), parse_color(gradient_mean)
    return F.when(own["hex"].isNotNull() & (own["alpha"] > 0.05), own).when(mean["hex"].isNotNull(), F.struct(mean["hex"].alias("hex"), F.lit(1.0).alias("alpha")))


def shape_type(ellipse: Column, radius: Column) -> Column:
    return F.when(ellipse, "ellipse").when(radius > 0.5, "roundRect").otherwise("rect")


def column_widths(rows: Column, table_w: Column) -> Column:
    """Widths of a table's columns: the pixel widths of its first widest row as shares of the table; null unless all are positive."""
    widest = F.aggregate(rows, F.get(rows, F.lit(0)), lambda best, r: F.when(F.size(r) > F.size(best), r).otherwise(best))
    px = F.transform(widest, lambda c: c["wpx"].cast("double"))
    total = F.aggregate(px, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return F.when((total > 0) & F.forall(px, lambda v: F.coalesce(v > 0, F.lit(False))), F.transform(px, lambda v: F.round(v / total * table_w, 3)))


def fold_breaks(df: DataFrame, keys: list[str], order: str = "run_idx") -> DataFrame:
    """Line breaks mark the run before them; leading ones vanish. Adds break_line; break rows go."""
    following = F.lead("br").over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("break_line", F.coalesce(following, F.lit(False))).where(~F.col("br"))


def emit_strategy(op: Column, n_runs: Column, n_rows: Column, rendered: Column, failed: Column) -> Column:
    """What became of an operation; null for a table without rows, which leaves no trace."""
    return (
        F.when(op == "text", F.when(n_runs > 0, "native-text").otherwise("empty"))
        .when(op == "shape", "native-shape")
        .when(op == "table", F.when(n_rows > 0, "native-table"))
        .when(~rendered, "image-skipped")
        .when(failed, "image-failed")
        .otherwise("image")
    )


def text_layer(items: DataFrame, visible: Column, width: str = "width", height: str = "height") -> DataFrame:
    """Placed text items of picture slides: strategy, face, size in points and deck box. Blank items are dropped."""
    s = scale(F.col(width), F.col(height))
    at = letterbox(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col(width), F.col(height), 0.0)
    return items.where(trim(F.coalesce("text", F.lit(""))) != "").select(
        "*",
        F.when(visible, "text-replace").otherwise("text-layer").alias("strategy"),
        class_font(F.col("serif"), F.col("mono")).alias("face"),
        points(F.col("size"), s, 5).alias("points"),
        at["x"].alias("in_x"),
        at["y"].alias("in_y"),
        F.greatest(at["w"] * 1.15 + 0.05, F.lit(0.2)).alias("in_w"),
        F.greatest(at["h"] * 1.25, F.lit(0.12)).alias("in_h"),
    )


def trusted(conf: Column) -> Column:
    """Text without a confidence, or with one of 65 or more."""
    return conf.isNull() | (conf >= 65)


def decomposed_layer(items: DataFrame, embedded: DataFrame, slide: str = "slide_idx", item: str = "item_idx") -> DataFrame:
    """Text over rebuilt pictures: visible unless embedded in a picture or not trusted."""
    inside = embedded.select(F.col(slide).alias("_s"), F.col(item).alias("_i")).distinct().withColumn("_e", F.lit(True))
    marked = items.join(inside, (F.col(slide) == F.col("_s")) & (F.col(item) == F.col("_i")), "left")
    return text_layer(marked, F.col("_e").isNull() & trusted(F.col("conf"))).drop("_s", "_i", "_e")


def decomposed_shapes(rects: DataFrame, images: DataFrame, slide: str = "slide_idx", width: str = "width", height: str = "height") -> DataFrame:
    """Placed rectangles and artwork of rebuilt pictures, rectangles first: strategy, reason, deck box, and the corner radius in inches.

    Sides are at least 0.03 inches; a radius over half a pixel makes a rounded rectangle, whose
    corners take at most half of the shorter side.
    """
    s = scale(F.col(width), F.col(height))
    at = letterbox(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col(width), F.col(height), 0.03)
    placed = [at["x"].alias("in_x"), at["y"].alias("in_y"), at["w"].alias("in_w"), at["h"].alias("in_h")]
    rounded = F.coalesce(F.col("radius"), F.lit(0.0)) > 0.5
    inches = lambda px: F.round(px * s, 3)
    radius = F.when(rounded, F.least(inches(F.col("radius")), inches(F.least("w", "h")) / 2)).otherwise(0.0)
    box_ = [slide, "x", "y", "w", "h"]
    shapes = rects.select(*box_, F.lit(0).alias("layer"), F.lit("native-shape").alias("strategy"), F.lit(None).cast("string").alias("reason"), F.when(rounded, "roundRect").otherwise("rect").alias("shape"), *placed, radius.alias("in_radius"))
    art = images.select(*box_, F.lit(1).alias("layer"), F.lit("image").alias("strategy"), F.lit("art").alias("reason"), F.lit(None).cast("string").alias("shape"), *placed, F.lit(0.0).alias("in_radius"))
    return shapes.unionByName(art)


def fix_items(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Text items of a slide that is done again as a picture: each text element's runs joined, its box, its largest size, black."""
    runs = F.array_sort(F.collect_list(F.struct("run_idx", "text", "size")))
    one = texts.groupBy(*keys, "x", "y", "w", "h").agg(runs.alias("_r"))
    size = F.greatest(F.array_max(F.transform("_r", lambda r: F.coalesce(r["size"], F.lit(0)))), F.lit(1))
    return one.select(*keys, "x", "y", "w", "h", F.array_join(F.transform("_r", lambda r: r["text"]), "").alias("text"), size.alias("size"), F.lit("000000").alias("color"))


def overlay_layer(items: DataFrame, mode: str = "visible") -> DataFrame:
    """Text over a whole picture: visible where its background is plain and it is trusted, in visible mode."""
    return text_layer(items, F.lit(mode == "visible") & F.col("bg").isNotNull() & trusted(F.col("conf")))


def invisible_slides(layer: DataFrame, slide: str = "slide_idx") -> DataFrame:
    """Per slide whether no text was visibly replaced."""
    return layer.groupBy(slide).agg((F.count_if(F.col("strategy") == "text-replace") == 0).alias("invisible"))
