"""Joins of boxes and points of a slide by grid cells.

On a crowded slide each box lies in the at most four cells of the finest grid whose cells are no smaller than it; it is
looked for from there and from all coarser grids, so a pair meets on the grid of its larger box. Of the
cells that both touch, the one with the upper left corner of what they share owns the pair. All other slides are
one cell. So work follows the neighbours a box has, not the boxes of its slide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sides of the grids' cells; a larger box takes several cells of the last.
SIDES = (32, 256, 2048, 16_384, 1 << 20, 1 << 30)
#: Boxes of a slide up to which it is one cell.
CROWD = 128
KEYS = ("_level", "_cx", "_cy")


def crowd(boxes: DataFrame, slide: str) -> DataFrame:
    """Add _crowded: whether the row's slide has so many rows that cells pay."""
    return boxes.withColumn("_crowded", F.count(F.lit(1)).over(Window.partitionBy(slide)) > CROWD)


def grid_of(prefix: str = "") -> Column:
    """The number of the finest grid for a box; -1 on slides that aren't crowded."""
    size, own = F.greatest(f"{prefix}w", f"{prefix}h"), F.lit(len(SIDES) - 1)
    for i in range(len(SIDES) - 2, -1, -1):
        own = F.when(size <= SIDES[i], i).otherwise(own)
    return F.when(F.col(f"{prefix}_crowded"), own).otherwise(-1)


def _at(level: Column, low: Column, high: Column) -> Column:
    side = F.element_at(F.array(*[F.lit(s) for s in SIDES]), level + 1)
    return F.sequence(F.floor(low / side), F.floor(high / side))


def _cells(levels: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Cells (level, cx, cy) that a box touches on each of the grids."""
    one = lambda level: F.flatten(F.transform(_at(level, x, x + w), lambda cx: F.transform(_at(level, y, y + h), lambda cy: F.struct(level.alias("l"), cx.alias("x"), cy.alias("y")))))
    whole = F.array(F.struct(F.lit(-1).alias("l"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
    return F.when(F.col("_crowded"), F.flatten(F.transform(levels, one))).otherwise(whole)


def _dealt(rows: DataFrame, cells: Column) -> DataFrame:
    return rows.withColumn("_c", F.explode(cells)).withColumns({k: F.col(f"_c.{c}") for k, c in zip(KEYS, "lxy")}).drop("_c")


def _box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in "xywh"]


def _named(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{prefix}{c}") for c in rows.columns])


def holding(points: DataFrame, boxes: DataFrame, slide: str, condition: Column) -> DataFrame:
    """Points (px, py) held by a box of their slide, edges included, that meets the condition on the point's columns and b_<box column>.

    Both tables have the column _crowded. A point comes at most once for each grid, so count points, not rows.
    """
    asked = _dealt(points, _cells(F.sequence(F.lit(0), F.lit(len(SIDES) - 1)), F.col("px"), F.col("py"), F.lit(0), F.lit(0)))
    there = _named(_dealt(boxes, _cells(F.array(grid_of()), *_box())), "b_")
    same = (F.col(slide) == F.col(f"b_{slide}")) & (F.col(KEYS[0]) == F.col(f"b_{KEYS[0]}")) & (F.col(KEYS[1]) == F.col(f"b_{KEYS[1]}")) & (F.col(KEYS[2]) == F.col(f"b_{KEYS[2]}"))
    inside = F.col("px").between(F.col("b_x"), F.col("b_x") + F.col("b_w")) & F.col("py").between(F.col("b_y"), F.col("b_y") + F.col("b_h"))
    return asked.join(there, same & inside & condition, "left_semi").drop(*KEYS)


def _meeting(near: DataFrame, far: DataFrame, slide: str, later: bool) -> DataFrame:
    """Boxes of near (a_) on grids no coarser than those of far (b_); ``later``: on finer ones only."""
    own = grid_of()
    first = F.when(F.col("_crowded"), own + (1 if later else 0)).otherwise(0)
    levels = F.when(first < len(SIDES), F.sequence(first, F.lit(len(SIDES) - 1))).otherwise(F.array().cast("array<int>"))
    a, b = _named(_dealt(near, _cells(levels, *_box())), "a_"), _named(_dealt(far, _cells(F.array(own), *_box())), "b_")
    on = F.lit(True)
    for k in (slide, *KEYS):
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    side = F.element_at(F.array(*[F.lit(s) for s in SIDES]), F.greatest(F.col("a__level"), F.lit(0)) + 1)
    corner = lambda c: F.floor(F.greatest(f"a_{c}", f"b_{c}") / side)
    owner = (F.col("a__level") < 0) | ((corner("x") == F.col("a__cx")) & (corner("y") == F.col("a__cy")))
    return a.join(b, on).where(owner)


def touching(one: DataFrame, two: DataFrame, slide: str) -> DataFrame:
    """Pairs of a box of ``one`` (a_...) and one of ``two`` (b_...) on the same slide whose cells meet: all that touch, once, and some more."""
    extra = [f"{p}{k}" for p in ("a_", "b_") for k in KEYS]
    finer = _meeting(one, two, slide, False).drop(*extra)
    swapped = _meeting(two.where("_crowded"), one.where("_crowded"), slide, True).drop(*extra)
    names = [F.col(("b_" if c.startswith("a_") else "a_") + c[2:]).alias(c) for c in finer.columns]
    return finer.unionByName(swapped.select(*names))


def touching_pairs(boxes: DataFrame, slide: str, elem: str) -> DataFrame:
    """Pairs of boxes of one slide whose cells meet, once, that of smaller ``elem`` as a_...; all that touch, and some more.

    Slides of one cell, of at most CROWD boxes, are paired by themselves, in one pass; only crowded ones are joined.
    """
    named = lambda p: [F.col(f"_{p}.{c}").alias(f"{p}_{c}") for c in boxes.columns]
    few = boxes.groupBy(slide).agg(F.collect_list(F.when(~F.col("_crowded"), F.struct(*boxes.columns))).alias("_l"))
    one = few.where(F.size("_l") > 1).select("_l", F.explode("_l").alias("_a"))
    pairs = one.select("_a", F.explode(F.filter("_l", lambda b: b[elem] > F.col("_a")[elem])).alias("_b")).select(*named("a"), *named("b"))
    crowded = boxes.where("_crowded").repartition(slide)  # read once by both sides
    met = _meeting(crowded, crowded, slide, False)
    finer = grid_of("a_") < grid_of("b_")
    same = (grid_of("a_") == grid_of("b_")) & (F.col(f"a_{elem}") < F.col(f"b_{elem}"))
    kept = met.where(finer | same)
    turn = F.col(f"a_{elem}") > F.col(f"b_{elem}")
    first = [F.when(turn, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"a_{c}") for c in boxes.columns]
    return pairs.unionByName(kept.select(*first, *[F.when(turn, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"b_{c}") for c in boxes.columns]))
