"""Properties of boxes, and plans that stay as intended."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from vellum.operators import geometry, validation
from vellum.plans.fixtures import boxes


def test_overlap_is_symmetric_and_clamping_idempotent(spark):
    df = spark.range(500).select(*[(F.pmod(F.hash("id", F.lit(c)), F.lit(300)) - (100 if c in "ab" else 0)).alias(c) for c in "abcdefgh"])
    o = geometry.overlap_area(*[F.col(c) for c in "abcdefgh"])
    p = geometry.overlap_area(*[F.col(c) for c in "efghabcd"])
    once = geometry.clamp(*[F.col(c) for c in "abcd"], F.lit(150), F.lit(120))
    rows = df.withColumn("c", once).where("c is not null").withColumn("d", geometry.clamp(*[F.col(f"c.{k}") for k in "xywh"], F.lit(150), F.lit(120)))
    assert df.where(o != p).count() == 0
    assert rows.count() > 0 and rows.where(F.col("c.x").cast("long") != F.col("d.x")).count() == 0


def test_collision_join_is_an_equi_join(spark, sf):
    out = io.StringIO()
    with redirect_stdout(out):
        validation.text_collisions(boxes(spark, sf)).explain()
    assert "CartesianProduct" not in out.getvalue() and "NestedLoop" not in out.getvalue()


def test_empty_report(spark, sf):
    empty = boxes(spark, sf).where("false")
    assert validation.issue_list(validation.slide_checks(empty)).count() == 0
    assert validation.summary(spark.createDataFrame([], "needs_review boolean, failed boolean, auto_fixed boolean, diff_pct double")).first()["slides"] == 0


def test_tree_of_any_depth(spark):
    from vellum.operators import tree

    rows = [(i, i - 1 if i % 40 else None, i % 3 if i % 4 else None) for i in range(120)] + [(500, 499, 1)]
    nodes = spark.createDataFrame(rows, "node_id int, parent_id int, z int")
    assert tree.tree_depth(nodes) == 40
    found = {r.node_id: len(r.path) for r in tree.with_paths(nodes, ["z"]).collect()}
    assert found == {i: i % 40 + 1 for i in range(120)}  # 500's parent isn't there
    assert tree.tree_depth(nodes.where("false")) == 1
    with pytest.raises(ValueError):
        tree.tree_depth(spark.createDataFrame([(1, 2), (2, 1)], "node_id int, parent_id int"))


def test_boxes_without_pixels_keep_their_background(spark):
    from vellum.operators import pixels as px

    ring = spark.createDataFrame([(1, "101010", 16.0, 16.0, 16.0), (2, None, 16.0, 16.0, 16.0)], "slide_idx int, bg string, med_r double, med_g double, med_b double")
    inside = spark.createDataFrame([(2, 16, 16, 16)], "slide_idx int, r int, g int, b int")
    got = {r.slide_idx: (r.fg, r.bg) for r in px.text_colour(inside, ring, ["slide_idx"]).collect()}
    assert got == {1: ("000000", "101010"), 2: ("FFFFFF", None)}


def test_coverage_without_text(spark, sf):
    assert {r.coverage_pct for r in validation.slide_checks(boxes(spark, sf)).select("coverage_pct").distinct().collect()} == {100}


def test_boxes_are_dealt_once_by_bytes(spark, sf):
    """Slides are dealt to tasks by the table's bytes, and page_text, whose tables all hang on slides, deals lines no second time."""
    from vellum.plans.queries import QUERIES
    from vellum.session import tasks_for

    path = f"{sf}/lineitem.parquet"
    assert tasks_for(spark, path, 1 << 10) > spark.sparkContext.defaultParallelism == tasks_for(spark, path, 1 << 40)
    plan = QUERIES["page_text"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") > 0


def test_pairs_of_small_slides_need_no_join(spark):
    """Slides of one cell are paired in one pass, crowded ones by cells: together all pairs that cover each other, once."""
    import random

    r = random.Random(5)
    sizes = {1: 128, 2: 129, 3: 1, 4: 2, 5: 40}
    rows = [(s, e, "native-text", r.randrange(400), r.randrange(300), r.randrange(10, 90), r.randrange(10, 60), 12) for s, n in sizes.items() for e in range(n)]
    df = spark.createDataFrame(rows, "slide_idx long, elem_idx int, strategy string, x int, y int, w int, h int, size int")

    def covered(a, b):
        ov = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])) * max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]))
        return ov > 400 and ov * 2 > min(a[5] * a[6], b[5] * b[6])

    got = validation.text_collisions(df)
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and covered(a, b))
    assert sorted((g.slide_idx, g.a, g.b) for g in got.collect()) == want and {w[0] for w in want} >= {1, 2, 5}
    few = validation.text_collisions(df.where("slide_idx <> 2"))
    few.collect()
    assert few._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(filter(") == 1
