"""Jobs from end to end, with options."""

from pyspark.sql import functions as F

from vellum.convert import Job, Options, convert, emitted_pictures


def test_options_of_a_command_line():
    assert Options.parse([]) == (Options(auto_fix=True), [])
    assert Options.parse(["a.html", "--out", "x.pptx", "--fast", "--diff", "2.5", "b"]) == (Options(fast=True, auto_fix=True, diff_threshold=2.5), ["a.html", "b"])
    assert Options.parse(["--overlay-only", "--no-autofix"]) == (Options(overlay_only=True), [])


def small(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    box = "x int, y int, w int, h int, size int"
    return Job(
        elements=make([(1, 0, "native-text", 0, 0, 100, 40, 20, False, 5, 5), (2, 0, "native-text", 0, 0, 100, 40, 20, True, 3, 4), (2, 1, "native-text", 5, 5, 100, 40, 20, False, 0, 0), (5, 0, "native-text", 0, 0, 2000, 40, 20, False, 1, 1)], f"slide_idx int, elem_idx int, strategy string, {box}, clipped boolean, native_chars int, source_chars int"),
        texts=make([(5, 0, 0, "long", 0, 0, 2000, 40, 20)], f"slide_idx int, elem_idx int, run_idx int, text string, {box}"),
        pictures=make([(3, 1280, 720, True), (4, 1280, 720, False), (6, 1280, 720, True)], "slide_idx int, width int, height int, decomposed boolean"),
        items=make([(3, 0, "plate", 1, 1, 90, 20, 12, 90, None, False, False), (3, 1, "baked", 1, 1, 90, 20, 12, 90, None, False, False), (4, 0, "dim", 1, 1, 90, 20, 12, 40, "FFFFFF", False, False)], f"slide_idx int, item_idx int, text string, {box}, conf int, bg string, serif boolean, mono boolean"),
        parts=make([(3, "rect", 0, 0, 50, 50, 0.0), (3, "art", 60, 60, 50, 50, 0.0)], "slide_idx int, kind string, x int, y int, w int, h int, radius double"),
        embedded=make([(3, 1)], "slide_idx int, item_idx int"),
        failures=make([(7, "no page")], "slide_idx int, message string"),
        drift=make([(1, 1.0, [0, 0, 1, 1]), (2, 3.0, [0, 0, 1, 1]), (3, 5.0, [0, 0, 1, 1]), (4, 2.5, [0, 0, 1, 1]), (5, None, None), (7, 0.0, [0, 0, 1, 1])], "slide_idx int, diff_pct double, worst_region array<int>"),
        drift_again=make([(5, 0.5, [0, 0, 1, 1])], "slide_idx int, diff_pct double, worst_region array<int>"),
    )


def test_a_job(spark):
    job = small(spark)
    emitted = sorted(map(tuple, emitted_pictures(job, Options()).collect()))
    assert emitted == [(3, "empty"), (3, "image"), (3, "native-shape"), (3, "text-layer"), (3, "text-replace"), (4, "image"), (4, "text-layer"), (6, "empty")]
    assert sorted(map(tuple, emitted_pictures(job, Options(overlay_only=True)).collect())) == [(3, "image"), (3, "text-layer"), (3, "text-layer"), (4, "image"), (4, "text-layer"), (6, "image")]
    report = lambda o: {r.slide_idx: r for r in convert(job, o).collect()}

    fast = report(Options(fast=True))
    assert {i: r.needs_review for i, r in fast.items()} == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True} and all(r.diff_pct is None for r in fast.values())
    assert fast[7].issues == ["conversion failed: no page"] and fast[2].coverage_pct == 75

    plain = report(Options())
    assert {i: r.kind for i, r in plain.items()} == {1: "html", 2: "html", 3: "recon", 4: "image", 5: "html", 6: "image", 7: "html"}
    assert {i: r.flagged for i, r in plain.items()} == {1: False, 2: False, 3: False, 4: True, 5: True, 6: None, 7: None}
    assert plain[2].issues == [] and plain[4].issues == ["visual drift 2.5% (>2%) @[0,0,1,1]"] and plain[5].issues == ["1 off-canvas element(s)", "visual drift null% (>8%) @undefined"]

    fixed = report(Options(auto_fix=True))
    assert {i for i, r in fixed.items() if r.auto_fixed} == {5} and fixed[5].issues == [] and (fixed[5].kind, fixed[5].diff_pct, fixed[5].coverage_pct) == ("image", 0.5, 100)
    assert fixed[4].issues == plain[4].issues and not fixed[7].auto_fixed
    assert report(Options(auto_fix=True, diff_threshold=0.1))[5].issues == ["visual drift 0.5% (>0.1%) @[0,0,1,1]"]
    assert convert(job, Options()).groupBy().agg(F.count("*"), F.count_distinct("slide_idx")).first() == (7, 7)


MODES = {"plain": Options(), "fast": Options(fast=True, auto_fix=True), "overlay": Options(overlay_only=True), "fix": Options(auto_fix=True), "near": Options(auto_fix=True, overlay_only=True, diff_threshold=0.1)}


def test_several_options_at_once(spark):
    """Each set of options gives the reports that it gives alone."""
    from vellum.convert import convert_each

    job = small(spark)
    each = convert_each(job, MODES)
    names = [c for c in each.columns if c != "mode"]
    got = sorted((r.mode, *(str(r[c]) for c in names)) for r in each.collect())
    assert got == sorted((m, *(str(r[c]) for c in names)) for m, o in MODES.items() for r in convert(job, o).collect()) and len(got) == 35
    assert {(r.mode, r.slide_idx, r.text_count) for r in each.where("auto_fixed").collect()} == {("fix", 5, 1), ("near", 5, 1)}
    assert {r.mode: r.kind for r in each.where("slide_idx = 3").collect()} == {"plain": "recon", "fast": "recon", "overlay": "image", "fix": "recon", "near": "image"}


def test_options_share_what_they_read(spark, sf):
    """A job's tables are read for all its options together: one more set of options reads no more."""
    from vellum.convert import convert_each
    from vellum.plans.queries import QUERIES
    from vellum.plans.report_queries import job_tables

    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    job = job_tables(spark, sf)
    assert 0 < reads(QUERIES["convert_job"](spark, sf)) < 40
    assert reads(convert_each(job, {"a": Options(auto_fix=True)})) == reads(convert_each(job, {"a": Options(auto_fix=True), "b": Options(auto_fix=True, diff_threshold=1.0), "c": Options(fast=True)}))
