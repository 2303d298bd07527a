"""Crowded slides by grid cells, deep trees by doubling, runs of text."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import cells, pixels, tree, validation


@pytest.fixture(scope="module")
def crowded(spark):
    """One slide of 1,500 boxes of all sizes, some beyond the canvas, one of ten boxes, one of boxes that all cover each other."""
    r = random.Random(5)
    size = lambda: r.choice([1, 5, 20, 31, 32, 33, 256, 257, 900, 40_000])
    rows = [(1, i, r.randint(-50, 1400), r.randint(-50, 800), size(), size(), 10 + i % 20, i % 4, i % 3) for i in range(1500)]
    rows += [(2, i, r.randint(0, 100), r.randint(0, 100), 60, 60, 12, 0, i % 2) for i in range(10)]
    rows += [(3, i, 10, 10, 50, 50, 12, 0, 0) for i in range(150)]
    return rows


NAMES = "slide_idx int, elem_idx int, x int, y int, w int, h int, size int, z int, `group` int"


def overlap(a, b):
    return max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])) * max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))


def test_collisions_of_a_crowd(spark, crowded):
    want = set()
    for i, a in enumerate(crowded):
        for b in crowded[i + 1 :]:
            if a[0] == b[0]:
                ov, least = overlap(a, b), min(a[4] * a[5], b[4] * b[5])
                if ov > 400 and ov * 2 > least and max(a[6], b[6]) / min(a[6], b[6]) <= 1.8:
                    want.add((a[0], a[1], b[1]))
    df = spark.createDataFrame(crowded, NAMES).withColumn("strategy", F.lit("native-text"))
    got = validation.text_collisions(df).collect()
    assert {(r.slide_idx, r.a, r.b) for r in got} == want and len(got) == len(want) > 10_000


def test_a_crowd_of_small_boxes_is_no_product(spark):
    """20,000 boxes, 200 million pairs; the cells let through few more than touch."""
    df = cells.crowd(spark.range(20_000).select(F.lit(1).alias("s"), F.col("id").alias("e"), (F.col("id") % 200 * 12).alias("x"), F.floor(F.col("id") / 200).cast("long").alias("y0")).select("s", "e", "x", (F.col("y0") * 12).alias("y"), F.lit(14).alias("w"), F.lit(14).alias("h")), "s")
    met = cells.touching_pairs(df, "s", "e")
    touch = (F.abs(F.col("a_x") - F.col("b_x")) <= 14) & (F.abs(F.col("a_y") - F.col("b_y")) <= 14)
    counts = met.agg(F.count(F.lit(1)).alias("all"), F.count_if(touch).alias("touch")).first()
    assert counts["touch"] == 199 * 100 + 200 * 99 + 2 * 199 * 99 and counts["all"] < 4 * counts["touch"]


def test_occlusion_in_a_crowd(spark, crowded):
    want = {}
    for a in crowded:
        points = [(a[2] + a[4] * part, a[3] + a[5] / 2) for part in (0.25, 0.5, 0.75)]
        seen = [p for p in points if 0 <= p[0] < 1280 and 0 <= p[1] < 720]
        if seen:
            tops = [b for b in crowded if b[0] == a[0] and b[8] != a[8] and (b[7], b[1]) > (a[7], a[1])]
            want[a[0], a[1]] = all(any(b[2] <= x <= b[2] + b[4] and b[3] <= y <= b[3] + b[5] for b in tops) for x, y in seen)
    got = tree.occluded(spark.createDataFrame(crowded, NAMES)).collect()
    assert {(r.slide_idx, r.elem_idx): r.occluded for r in got} == want and len(got) == len(want) and len(set(want.values())) == 2


def test_text_inside_parts_of_a_crowd(spark, crowded):
    texts, parts = [b for b in crowded if b[6] % 2], [b for b in crowded if b[6] % 2 == 0]
    want = {(t[0], t[1]) for t in texts if t[5] >= 0.045 * 720}
    for t in texts:
        if t[1] % 5:
            for p in parts:
                if p[0] == t[0] and p[4] * p[5] > 0.02 * 1280 * 720 and overlap(t, (0, 0, p[2] - 32, p[3] - 32, p[4] + 64, p[5] + 64)) / max(t[4] * t[5], 1) >= 0.6:
                    want.add((t[0], t[1]))
    df = spark.createDataFrame(crowded, NAMES).withColumn("safe", F.col("elem_idx") % 5 == 0)
    got = pixels.embedded_text(df.where("size % 2 = 1"), df.where("size % 2 = 0"), "slide_idx", "elem_idx", F.lit(1280), F.lit(720)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def random_tree(n, chain, seed):
    """A chain with bushes on it: (node, parent, sibling, z, clips, x, y, w, h, visible, consumes)."""
    r = random.Random(seed)
    rows = [(i, i - 1 if i else None, 0) for i in range(chain)] + [(i, r.randrange(i), i) for i in range(chain, n)]
    return [(*t, r.choice([None, None, 3, 7]), r.random() < 0.2, r.randint(0, 50), r.randint(0, 50), r.randint(400, 900), r.randint(300, 900), r.random() < 0.999, r.random() < 0.001) for t in rows]


@pytest.mark.parametrize("n, chain", [(2600, 2000), (500, 3), (1, 1)])
def test_deep_trees(spark, n, chain):
    rows = random_tree(n, chain, n)
    by = {t[0]: t for t in rows}
    z, clip, shown, place = {}, {}, {}, {}
    for t in rows:  # parents come first
        up = by.get(t[1])
        z[t[0]] = t[3] if t[3] is not None else z[up[0]] if up else 0
        above = clip[up[0]][1] if up else (0, 0, 1e9, 1e9)
        mine = (max(above[0], t[5]), max(above[1], t[6]), min(above[2], t[5] + t[7]), min(above[3], t[6] + t[8]))
        clip[t[0]] = (mine, mine if t[4] else above)
        shown[t[0]] = (t[9] and (not up or shown[up[0]][0] and True), bool(up) and (shown[up[0]][1] or up[10]))
        place[t[0]] = (place[up[0]] if up else ()) + (t[2],)
    schema = "node_id int, parent_id int, sibling int, z int, clips boolean, x int, y int, w int, h int, visible boolean, consumes boolean"
    df = spark.createDataFrame([*rows, (9999, 7777, 0, 1, True, 0, 0, 9, 9, True, False)], schema)  # one node hangs on nothing
    assert {r.node_id: r.effective_z for r in tree.with_z(df.select("node_id", "parent_id", "z")).collect()} == z
    found = {r.node_id: r.clip for r in tree.with_clip(df).collect()}
    assert set(found) == set(by)
    for i, (c, _) in clip.items():
        assert (tuple(found[i]) if found[i] else None) == ((c[0], c[1], c[2] - c[0], c[3] - c[1]) if c[2] > c[0] and c[3] > c[1] else None)
    kept = tree.document_order(tree.in_order(df).withColumn("slide", F.lit(1)), "slide").collect()
    want = sorted((i for i, (vis, eaten) in shown.items() if vis and not eaten), key=lambda i: place[i])
    assert [r.node_id for r in sorted(kept, key=lambda r: r.doc_order)] == want


def test_deep_trees_take_few_joins(spark, monkeypatch):
    """A path of 2,000 nodes: a join a round, each round cut by a checkpoint."""
    rounds = []
    real = type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda self, *a: rounds.append(1) or real(self, *a))
    df = spark.range(2000).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    assert tree.tree_depth(df) == 2000
    assert len(rounds) - 1 < 15


def test_runs_keep_single_blanks(spark):
    rows = [
        (1, 0, "a \n\n  b", "SPAN"), (1, 1, " x ", "#text"), (1, 2, " \t", "SUB"), (1, 3, "2", "SUP"), (1, 4, "", "BR"), (1, 5, " ", "SUP"), (1, 6, "tail\n", "#text"),
        (2, 0, " ", "SUB"), (2, 1, "first", "B"),
        (3, 0, " ", "#text"),
    ]
    df = spark.createDataFrame([(*r, 400, "normal") for r in rows], "k int, run_idx int, text string, tag string, weight int, style string")
    got = {r.k: [(x.text, x.br, x["sub"], x["sup"]) for x in r.runs] for r in tree.text_runs(df, ["k"]).collect()}
    assert got == {1: [("a b", False, False, False), (" x ", False, True, False), ("2", False, False, True), ("\n", True, False, True), ("tail ", False, False, False)], 2: [("first", False, False, False)]}


def test_roots_are_not_broadcast(spark, sf):
    """A row a slide on both sides: no side goes through the driver."""
    from vellum.plans.queries import QUERIES

    plan = QUERIES["visible_roots"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
