"""Document trees as tables of nodes: inheritance, pruning, order, occlusion.

What a node takes from its ancestors is a fold along its path. ``along_paths`` computes folds by
doubling: a node's row holds the fold over the nearest ancestors it has reached and a link to the next one;
each round joins it with that one's row, so reach doubles and a tree of depth d takes about log2(d) joins.
Folds of bounded size (nearest z, intersection of clips, all visible) keep rows small at any depth;
``with_paths`` folds whole paths into arrays, for rules that are array functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import single_blanks, squeeze
from vellum.operators.cells import crowd, holding
from vellum.operators.geometry import box
from vellum.session import shared_folder


#: Rounds after which it is worth to count the nodes, to tell a deep tree from parent links in a circle.
ROUNDS = 12


def along_paths(nodes: DataFrame, own: dict[str, Column], combine: dict[str, Callable[[Column, Column], Column]], node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """Add for each name the fold over the path from the root to the node, and ``above_<name>``, without the node itself (null for roots).

    ``own`` is a node's contribution and ``combine(above, below)`` joins two stretches of a path; it is
    associative and takes null for a stretch without contributions. Nodes whose parent isn't there hang on
    no root and are left out. Links in a circle are an error.
    """
    shared_folder(nodes.sparkSession)
    names = {n: f"above_{n}" for n in own}
    rows = nodes.withColumns({n: c for n, c in own.items()} | {"_up": F.col(parent)})
    rows = rows.withColumns({a: F.when(F.lit(False), F.col(n)) for n, a in names.items()})
    rounds = 0
    while True:
        rows = rows.checkpoint()
        live = rows.where(F.col("_up").isNotNull())
        if live.isEmpty():
            return rows.drop("_up")
        if rounds > ROUNDS and 1 << rounds > rows.count():
            raise ValueError("parent links go in a circle")
        far = rows.select(F.col(node).alias("_n"), F.col("_up").alias("_next"), *[F.col(n).alias(f"_far_{n}") for n in own])
        joined = live.join(far, F.col("_up") == F.col("_n"))
        more = {n: combine[n](F.col(f"_far_{n}"), F.col(n)) for n in own} | {a: combine[n](F.col(f"_far_{n}"), F.col(a)) for n, a in names.items()}
        rows = rows.where(F.col("_up").isNull()).unionByName(joined.withColumns(more | {"_up": F.col("_next")}).select(*rows.columns))
        rounds += 1


def tree_depth(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id") -> int:
    """Levels of the deepest tree, at least 1."""
    add = lambda above, below: above + F.coalesce(below, F.lit(0))
    return along_paths(nodes.select(node, parent), {"depth": F.lit(1)}, {"depth": add}, node, parent).agg(F.coalesce(F.max("depth"), F.lit(1))).first()[0]


def with_paths(nodes: DataFrame, keep: list[str], node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """Add ``path``: structs (node, *keep) from the root down to the node."""
    chain = lambda above, below: F.concat(above, F.coalesce(below, F.array().cast(nodes.select(F.array(F.struct(node, *keep))).schema[0].dataType)))
    return along_paths(nodes, {"path": F.array(F.struct(F.col(node), *keep))}, {"path": chain}, node, parent).drop("above_path")


def nearest(above: Column, below: Column) -> Column:
    """The value nearest to the node."""
    return F.coalesce(below, above)


def with_z(nodes: DataFrame, z: str = "z") -> DataFrame:
    """Add effective_z: the nearest z of the node and its ancestors, else 0."""
    out = along_paths(nodes.withColumn("_z", F.col(z)), {"effective_z": F.col(z)}, {"effective_z": nearest})
    return out.withColumn("effective_z", F.coalesce("effective_z", F.lit(0))).drop("_z", "above_effective_z")


def with_clip(nodes: DataFrame) -> DataFrame:
    """Add clip: the node's box (x, y, w, h) cut by all ancestors that clip (``clips``); null if nothing is left."""
    edges = {"_x0": F.col("x"), "_y0": F.col("y"), "_x1": F.col("x") + F.col("w"), "_y1": F.col("y") + F.col("h")}
    inner = lambda pick: lambda above, below: pick(above, below)
    folds = {k: inner(F.greatest if k.endswith("0") else F.least) for k in edges}
    out = along_paths(nodes, {k: F.when(F.col("clips"), e) for k, e in edges.items()}, folds)
    x0, y0, x1, y1 = (folds[k](F.col(f"above_{k}"), e) for k, e in edges.items())
    clip = F.when((x1 > x0) & (y1 > y0), box(x0, y0, x1 - x0, y1 - y0))
    return out.withColumn("clip", clip).drop(*edges, *[f"above_{k}" for k in edges])


def in_order(nodes: DataFrame, key: str = "sibling") -> DataFrame:
    """Nodes whose whole path is visible and of which no ancestor consumes the content, with ``place``: sibling numbers from the root, in whose order the document runs."""
    every = lambda above, below: F.coalesce(above & below, above, below)
    some = lambda above, below: F.coalesce(above | below, above, below)
    none = F.array().cast(nodes.select(F.array(key)).schema[0].dataType)
    chain = lambda above, below: F.concat(above, F.coalesce(below, none))
    out = along_paths(nodes, {"_seen": F.col("visible"), "_eaten": F.col("consumes"), "place": F.array(key)}, {"_seen": every, "_eaten": some, "place": chain})
    return out.where(F.col("_seen") & ~F.coalesce("above__eaten", F.lit(False))).drop("_seen", "_eaten", "above__seen", "above__eaten", "above_place")


def is_visible(display: Column, visibility: Column, opacity: Column, w: Column, h: Column) -> Column:
    return (display != "none") & (visibility != "hidden") & (opacity != 0) & (w > 0.5) & (h > 0.5)


def document_order(df: DataFrame, slide: str, place: str = "place") -> DataFrame:
    """Pre-order numbers from 0: the order of the arrays of sibling numbers along the path."""
    w = Window.partitionBy(slide).orderBy(place)
    return df.withColumn("doc_order", F.row_number().over(w) - 1)


def root_of(df: DataFrame, slide: str) -> DataFrame:
    """Per slide the first slide-container in document order, else the body."""
    rank = F.when(F.col("class").rlike(r"\bslide-container\b"), 0).when(F.col("tag") == "BODY", 1)
    return df.where(rank.isNotNull()).groupBy(slide).agg(F.min_by("node_id", F.struct(rank, F.col("doc_order"))).alias("root_id"))


def occluded(boxes: DataFrame, slide: str = "slide_idx", elem: str = "elem_idx", view: tuple[int, int] = (1280, 720)) -> DataFrame:
    """Per element whether all its sample points inside the viewport lie under another element.

    Points are the centre and the centres of the left and right halves. An element on top is
    one of another ``group`` (unrelated in the tree) with larger (z, index) that holds the point.
    """
    at = lambda i: F.struct(F.lit(1 << i).alias("bit"), (F.col("x") + F.col("w") * (i + 1) / 4).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"))
    own = crowd(boxes.select(slide, elem, "z", "group", "x", "y", "w", "h"), slide)
    points = own.select(slide, elem, "z", "group", "_crowded", F.explode(F.array(at(0), at(1), at(2))).alias("p")).select(slide, elem, "z", "group", "_crowded", "p.*")
    inside = points.where((F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < view[0]) & (F.col("py") < view[1]))
    above = (F.col("b_z") > F.col("z")) | ((F.col("b_z") == F.col("z")) & (F.col(f"b_{elem}") > F.col(elem)))
    hit = holding(inside, own, slide, (F.col("group") != F.col("b_group")) & above)
    bits = lambda df, name: df.groupBy(slide, elem).agg(F.bit_or("bit").alias(name))
    joined = bits(inside, "points").join(bits(hit, "covered"), [slide, elem], "left")
    return joined.select(slide, elem, (F.coalesce("covered", F.lit(0)) == F.col("points")).alias("occluded"))


def direct_text(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """The texts of a node's own text children, in order, with white space squeezed."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "")
    return df.groupBy(*keys).agg(squeeze(joined).alias("text"))


# Tags that run inside a line of text.
INLINE = ("SPAN", "B", "STRONG", "EM", "I", "A", "U", "SMALL", "MARK", "SUB", "SUP", "BR", "LABEL", "CODE")
ICON = r"\bfa[srlbd]?\b|\bfa-"


def block_children(children: DataFrame, parent: str = "parent_id", tag: str = "tag") -> DataFrame:
    """Per parent whether it has a block child: one that is neither inline (icons are) nor media."""
    block = ~F.col(tag).isin(*INLINE, "svg", "IMG")
    return children.groupBy(parent).agg(F.bool_or(block).alias("block_child"))


def text_runs(df: DataFrame, keys: list[str], order: str = "run_idx") -> DataFrame:
    """Runs (array of structs) of a text node, one level deep: bold from weight 600 on, BR as line breaks, blank runs dropped.

    White space in a run becomes single blanks; those at its ends stay, as they part it from its
    neighbours. A SUB or SUP marks its own run, or, if it is blank, the run before it.
    """
    br = F.col("tag") == "BR"
    kept = br | (squeeze(F.col("text")) != "")
    inside = Window.partitionBy(*keys).orderBy(order)
    owned = df.withColumn("_kept", kept).withColumn("_run", F.count_if("_kept").over(inside)).where("_run > 0")
    mark = lambda tag: F.bool_or(F.col("tag") == tag)
    own = {c: F.any_value(F.when(F.col("_kept"), F.col(c)), True).alias(c) for c in (order, "text", "tag", "weight", "style")}
    runs = owned.groupBy(*keys, "_run").agg(*own.values(), mark("SUB").alias("_sub"), mark("SUP").alias("_sup"))
    run = F.struct(
        F.col(order),
        F.when(br, F.lit("\n")).otherwise(single_blanks(F.col("text"))).alias("text"),
        br.alias("br"),
        (F.col("weight") >= 600).alias("bold"),
        (F.col("style") == "italic").alias("italic"),
        F.col("_sub").alias("sub"),
        F.col("_sup").alias("sup"),
    )
    return runs.groupBy(*keys).agg(F.array_sort(F.collect_list(run)).alias("runs"))


def table_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Ragged rows (array of arrays) of a table; TH or weight 600 is bold; empty rows are dropped."""
    cell = F.struct("col_idx", squeeze(F.col("text")).alias("text"), ((F.col("tag") == "TH") | (F.col("weight") >= 600)).alias("bold"), "wpx")
    rows = cells.groupBy(*keys, "row_idx").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    ordered = F.array_sort(F.collect_list(F.struct("row_idx", "cells")))
    return rows.where(F.size("cells") > 0).groupBy(*keys).agg(F.transform(ordered, lambda r: r["cells"]).alias("rows"))


def element_kinds(tag: Column, is_chart: Column, rich: Column, cls: Column, shaped: Column, has_text: Column, block_child: Column) -> Column:
    """The kinds of elements a node yields, in order: media and tables one, others a shape and a text or none."""
    icon = (tag == "I") & cls.rlike(ICON)
    one = (
        F.when(is_chart, "chart")
        .when(tag == "TABLE", F.when(rich, "table-image").otherwise("table"))
        .when(tag.isin("svg", "CANVAS"), "svg")
        .when(tag == "IMG", "img")
        .when(icon, "icon")
    )
    both = F.array_compact(F.array(F.when(shaped, "shape"), F.when(has_text & ~block_child, "text")))
    return F.when(one.isNotNull(), F.array(one)).otherwise(both)


def is_rich_table(has_media: Column, cell_alpha: Column, hidden_px: Column) -> Column:
    """A table with pictures, tinted parts of cells, or more than 8 hidden pixels is kept as a picture."""
    return has_media | (cell_alpha > 0.05) | (hidden_px > 8)
