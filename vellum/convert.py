"""One job from end to end: emitted slides, their checks, the comparison with their sources, and slides done again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import mapping, validation

EMPTY = "array<string>"


@dataclass(frozen=True)
class Options:
    """fast: nothing is compared. overlay_only: pictures stay whole under unseen text. auto_fix: slides still flagged after
    the comparison are done again as pictures, once. diff_threshold: one tolerance for all slides instead of their class's."""

    fast: bool = False
    overlay_only: bool = False
    auto_fix: bool = False
    diff_threshold: float | None = None

    @staticmethod
    def parse(words: list[str]) -> tuple[Options, list[str]]:
        """Options of a command line, where fixing is on unless it is switched off, and the inputs that are left."""
        at = words.index("--diff") if "--diff" in words else None
        out = words.index("--out") if "--out" in words else None
        values = {i + 1 for i in (at, out) if i is not None}
        inputs = [w for i, w in enumerate(words) if not w.startswith("--") and i not in values]
        diff = float(words[at + 1]) if at is not None else None
        return Options("--fast" in words, "--overlay-only" in words, "--no-autofix" not in words, diff), inputs


@dataclass(frozen=True)
class Job:
    """The tables of a job, keyed by slide_idx. ``drift`` and ``drift_again`` (slide_idx, diff_pct, worst_region) are what
    comparisons of the slides and of those done again give or would give; a null diff_pct is a missing output."""

    elements: DataFrame  # emitted elements of document slides: elem_idx, strategy, box, size, clipped, native_chars, source_chars
    texts: DataFrame  # their text elements' runs: elem_idx, run_idx, text, size, box
    pictures: DataFrame  # picture slides: width, height, decomposed
    items: DataFrame  # their text items: item_idx, text, box, size, conf, bg, serif, mono
    parts: DataFrame  # rectangles and artwork of decomposed ones: kind, box, radius
    embedded: DataFrame  # items that stay in their pictures: item_idx
    failures: DataFrame  # slides that failed: message
    drift: DataFrame
    drift_again: DataFrame


def emitted_pictures(job: Job, options: Options) -> DataFrame:
    """What picture slides emit (slide_idx, strategy): parts and text over them, or the whole picture and text over it."""
    sized = job.pictures.select(F.col("slide_idx").alias("_s"), "width", "height", (F.col("decomposed") & F.lit(not options.overlay_only)).alias("_parts"))
    of = lambda df, parts: df.join(sized, F.col("slide_idx") == F.col("_s")).where(F.col("_parts") == F.lit(parts)).drop("_s", "_parts")
    rows = lambda df: df.select("slide_idx", "strategy")
    whole = rows(sized.where(~F.col("_parts")).select(F.col("_s").alias("slide_idx"), F.lit("image").alias("strategy")))
    overlay = rows(mapping.overlay_layer(of(job.items, False), "invisible" if options.overlay_only else "visible"))
    parts = of(job.parts, True)
    shapes = rows(mapping.decomposed_shapes(parts.where("kind = 'rect'"), parts.where("kind = 'art'")))
    layer = rows(mapping.decomposed_layer(of(job.items, True), job.embedded))
    # a decomposed picture may have neither parts nor text; its slide has a report all the same
    blank = sized.where("_parts").select(F.col("_s").alias("slide_idx"), F.lit("empty").alias("strategy"))
    return whole.unionByName(overlay).unionByName(shapes).unionByName(layer).unionByName(blank)


def first_reports(job: Job, overlays: set[bool]) -> DataFrame:
    """A row a slide before any comparison: kind, coverage_pct, issues, needs_review, image_slide, failed.

    Picture slides have a row for each of ``overlays``, whether pictures stay whole: overlay_only, null in all other rows.
    """
    none = F.array().cast(EMPTY)
    names = ["slide_idx", "kind", "coverage_pct", "issues", "needs_review", "image_slide", "failed", "overlay_only"]
    flags = lambda image, failed, overlay: {"image_slide": F.lit(image), "failed": F.lit(failed), "overlay_only": F.lit(overlay).cast("boolean")}
    html = validation.issue_list(validation.slide_checks(job.elements)).withColumns({"kind": F.lit("html")} | flags(False, False, None))
    rest = html.select(*names)
    for overlay in sorted(overlays):
        report = validation.image_report(emitted_pictures(job, Options(overlay_only=overlay)))
        pictures = report.withColumns({"kind": validation.slide_class(F.lit(True), F.col("invisible")), "issues": none} | flags(True, False, overlay))
        rest = rest.unionByName(pictures.select(*names))
    failed = validation.failure_rows(job.failures, F.col("message")).withColumn("kind", F.lit("html")).withColumns(flags(False, True, None))
    gone = job.failures.select(F.col("slide_idx").alias("_s")).distinct()
    return rest.join(gone, F.col("slide_idx") == F.col("_s"), "left_anti").unionByName(failed.select(*names))


def again_reports(job: Job) -> DataFrame:
    """What slides done again as whole pictures with their texts unseen over them would give: text_count, and their own comparison."""
    sized = {"conf": F.lit(None).cast("int"), "bg": F.lit(None).cast("string"), "serif": F.lit(False), "mono": F.lit(False), "width": F.lit(1280), "height": F.lit(720)}
    layer = mapping.overlay_layer(mapping.fix_items(job.texts, ["slide_idx", "elem_idx"]).withColumns(sized), "invisible").select("slide_idx", "strategy")
    counts = validation.image_report(layer).select(F.col("slide_idx").alias("_s"), "text_count")
    return job.drift_again.join(counts, F.col("slide_idx") == F.col("_s"), "left").drop("_s").withColumn("text_count", F.coalesce("text_count", F.lit(0)))


def convert_each(job: Job, modes: dict[str, Options]) -> DataFrame:
    """The reports of ``convert`` for each of some sets of options, with their names as mode.

    A slide's tables are read and joined once: options only pick among its reports and comparisons, in columns.
    """
    fixing = any(o.auto_fix and not o.fast for o in modes.values())
    of = lambda df, name: df.select(F.col("slide_idx").alias(f"_{name}"), *[F.col(c).alias(f"_{name}_{c}") for c in df.columns if c != "slide_idx"])
    reports = first_reports(job, {o.overlay_only for o in modes.values()})
    reports = reports.join(of(job.drift.select("slide_idx", "diff_pct", "worst_region"), "drift"), F.col("slide_idx") == F.col("_drift"), "left")
    if fixing:
        reports = reports.join(of(again_reports(job).select("slide_idx", "diff_pct", "worst_region", "text_count"), "again"), F.col("slide_idx") == F.col("_again"), "left")
    value = lambda o: F.struct(F.lit(o.fast).alias("fast"), F.lit(o.overlay_only).alias("overlay_only"), F.lit(o.auto_fix and not o.fast).alias("auto_fix"), F.lit(o.diff_threshold).cast("double").alias("diff"))
    options = F.array(*[F.struct(F.lit(m).alias("mode"), value(o).alias("o")) for m, o in modes.items()])
    mine = F.filter(options, lambda o: F.coalesce(F.col("overlay_only") == o["o"]["overlay_only"], F.lit(True)))
    each = reports.withColumn("_m", F.explode(mine)).select("*", "_m.mode", "_m.o").drop("_m", "overlay_only")

    met = F.col("_drift").isNotNull() & ~F.col("failed") & ~F.col("o.fast")
    each = each.withColumns({"_met": met, "diff_pct": F.when(met, F.col("_drift_diff_pct")), "tolerance": F.when(met, F.coalesce("o.diff", validation.tolerance(F.col("kind"))))})
    each = each.withColumn("flagged", F.when(F.col("_met"), validation.drifted(F.col("diff_pct"), F.col("tolerance"))))
    issues = validation.reconciled(F.col("issues"), F.col("_met"), F.col("flagged"), validation.drift_issue(F.col("diff_pct"), F.col("tolerance"), F.col("_drift_worst_region")))
    each = each.withColumn("issues", issues).withColumn("needs_review", F.size("issues") > 0)
    names = ["mode", "slide_idx", "kind", "coverage_pct", "issues", "needs_review", "failed", "auto_fixed", "diff_pct", "tolerance", "flagged", "text_count"]
    if not fixing:
        return each.withColumns({"auto_fixed": F.lit(False), "text_count": F.lit(None).cast("long")}).select(*names)
    picked = F.col("o.auto_fix") & validation.needs_fix(F.col("flagged"), F.col("needs_review"), F.col("image_slide"), F.col("failed")) & F.col("_again").isNotNull()
    each = each.withColumn("auto_fixed", picked)
    tolerance = F.coalesce("o.diff", validation.tolerance(F.lit("image")))
    again = each.withColumn("_again_tolerance", tolerance).withColumn("_again_flagged", validation.drifted(F.col("_again_diff_pct"), F.col("_again_tolerance")))
    issues = F.when(F.col("_again_flagged"), F.array(validation.drift_issue(F.col("_again_diff_pct"), F.col("_again_tolerance"), F.col("_again_worst_region")))).otherwise(F.array().cast(EMPTY))
    new = {"kind": F.lit("image"), "coverage_pct": F.lit(100), "issues": issues, "needs_review": F.col("_again_flagged"), "diff_pct": F.col("_again_diff_pct"), "tolerance": F.col("_again_tolerance"), "flagged": F.col("_again_flagged")}
    fixed = {c: F.when(F.col("auto_fixed"), v).otherwise(F.col(c)) for c, v in new.items()}
    return again.withColumns(fixed | {"text_count": F.when(F.col("auto_fixed"), F.col("_again_text_count"))}).select(*names)


def convert(job: Job, options: Options = Options()) -> DataFrame:
    """The reports of a job, a row a slide: kind, coverage_pct, issues, needs_review, failed, auto_fixed, diff_pct, tolerance,
    flagged, and text_count of slides done again: how many texts lie over them.

    Slides that failed are in no comparison. Without one, figures of drift are null.
    """
    return convert_each(job, {"": options}).drop("mode")
