"""Checks of placed slides, reconciliation with what was rendered, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import half_up, number_text
from vellum.operators.cells import crowd, touching_pairs
from vellum.operators.geometry import CANVAS, overlap_area

# Tolerated share of changed pixels by class of slide.
TOLERANCE = {"image": 2.0, "recon": 12.0, "html": 8.0}
UNRENDERED = ("image-failed", "empty", "image-skipped")
#: Issues that a good picture comparison overrules.
OVERRULED = r"text collision|clipped/half-cut"


def strategy_tally(report: DataFrame, slide: str = "slide_idx") -> DataFrame:
    return report.groupBy(slide, "strategy").agg(F.count(F.lit(1)).alias("n"))


def tally_map(report: DataFrame, slide: str = "slide_idx") -> DataFrame:
    """Per slide a map of strategies to counts."""
    entries = F.array_sort(F.collect_list(F.struct("strategy", "n")))
    return strategy_tally(report, slide).groupBy(slide).agg(F.map_from_entries(entries).alias("strategies"))


def text_collisions(report: DataFrame, slide: str = "slide_idx", elem: str = "elem_idx") -> DataFrame:
    """Pairs of native texts that cover each other: over half of the smaller, over 400 px, similar sizes.

    Texts of a slide meet by grid cells; pairs come once, a before b.
    """
    sides = [F.col(c).cast("double").alias(c) for c in "xywh"]  # areas of large boxes leave 32 bits
    texts = report.where(F.col("strategy") == "native-text").select(slide, elem, *sides, "size")
    ov = overlap_area(*[F.col(f"{p}_{c}") for p in "ab" for c in "xywh"])
    least = F.least(F.col("a_w") * F.col("a_h"), F.col("b_w") * F.col("b_h"))
    ratio = F.greatest("a_size", "b_size") / F.greatest(F.lit(1), F.least("a_size", "b_size"))
    tests = (least > 0) & (ov > 400) & (ov * 2 > least) & (ratio <= 1.8)
    met = touching_pairs(crowd(texts, slide), slide, elem).where(tests)
    return met.select(F.col(f"a_{slide}").alias(slide), F.col(f"a_{elem}").alias("a"), F.col(f"b_{elem}").alias("b"), half_up(100 * ov / least).cast("int").alias("pct"))


def off_canvas(x: Column, y: Column, w: Column, h: Column, canvas: tuple[int, int] = CANVAS, slack: int = 2) -> Column:
    return (x < -slack) | (y < -slack) | (x + w > canvas[0] + slack) | (y + h > canvas[1] + slack)


def coverage(native_chars: Column, source_chars: Column) -> Column:
    """Percent of the source's characters that are native text; 100 for a source without any."""
    share = F.least(F.lit(100), half_up(100.0 * native_chars / source_chars))
    return F.when(source_chars > 0, share).otherwise(100).cast("int")


def slide_checks(report: DataFrame, slide: str = "slide_idx") -> DataFrame:
    """Counts a slide: n_elements, n_text, n_off_canvas, n_unrendered, n_clipped, n_collisions, collisions (percent,
    in pair order), strategies (a map to counts) and coverage_pct.

    Coverage needs the columns native_chars (what an element shows as native text) and source_chars (the
    element's part of the source's text); it is 100 where the report has none.
    """
    chars = [F.sum(c).alias(c) for c in ("native_chars", "source_chars") if c in report.columns]
    # counts by name first, then of each slide: a slide's map holds an entry a strategy
    by_name = report.groupBy(slide, "strategy").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(off_canvas(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).alias("_off"),
        F.count_if(F.coalesce("clipped", F.lit(False))).alias("_cut"),
        *chars,
    )
    of = lambda names: F.sum(F.when(F.col("strategy").isin(*names), F.col("_n")).otherwise(0))
    counts = by_name.groupBy(slide).agg(
        F.sum("_n").alias("n_elements"),
        of(["native-text"]).alias("n_text"),
        F.sum("_off").alias("n_off_canvas"),
        of(UNRENDERED).alias("n_unrendered"),
        F.sum("_cut").alias("n_clipped"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", F.col("_n").cast("int").alias("n"))))).alias("strategies"),
        *[F.sum(c).alias(c) for c in ("native_chars", "source_chars") if c in report.columns],
    )
    share = coverage(F.coalesce("native_chars", F.lit(0)), F.coalesce("source_chars", F.lit(0))) if len(chars) == 2 else F.lit(100)
    counts = counts.withColumn("coverage_pct", share)
    hits = text_collisions(report, slide).groupBy(slide).agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "pct"))), lambda s: s["pct"]).alias("collisions"))
    return counts.join(hits, slide, "left").withColumn("n_collisions", F.coalesce(F.size("collisions"), F.lit(0)))


def issue_list(checks: DataFrame) -> DataFrame:
    """Add issues (collisions, off-canvas, unrendered, clipped) and needs_review."""
    line = lambda n, text: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(text)))
    hits = F.transform(F.coalesce("collisions", F.array().cast("array<int>")), lambda p: F.concat(F.lit("text collision ("), p.cast("string"), F.lit("%)")))
    rest = F.array_compact(F.array(line("n_off_canvas", " off-canvas element(s)"), line("n_unrendered", " unrendered element(s)"), line("n_clipped", " clipped/half-cut element(s)")))
    return checks.withColumn("issues", F.concat(hits, rest)).withColumn("needs_review", F.size("issues") > 0)


def image_report(report: DataFrame, slide: str = "slide_idx") -> DataFrame:
    """Reports of picture slides: full coverage, no issues, text count, and whether no text is visibly replaced."""
    out = report.groupBy(slide).agg(F.count_if(F.col("strategy").isin("text-replace", "text-layer")).alias("text_count"), (F.count_if(F.col("strategy") == "text-replace") == 0).alias("invisible"))
    return out.select(slide, F.lit(100).alias("coverage_pct"), F.lit(False).alias("needs_review"), "text_count", "invisible")


def slide_class(image_slide: Column, invisible: Column) -> Column:
    return F.when(image_slide, F.when(invisible, "image").otherwise("recon")).otherwise("html")


def tolerance(kind: Column, override: float | None = None) -> Column:
    """The tolerated difference of a class of slide (html for unknown ones), unless overridden."""
    own = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in TOLERANCE.items()], F.lit(TOLERANCE["html"]))
    return F.lit(override) if override is not None else own


def flag_drift(diffs: DataFrame, kind: str = "kind", override: float | None = None) -> DataFrame:
    """Add tolerance and flagged; an unknown difference is flagged."""
    out = diffs.withColumn("tolerance", tolerance(F.col(kind), override))
    return out.withColumn("flagged", drifted(F.col("diff_pct"), F.col("tolerance")))


def drifted(diff_pct: Column, tolerance_: Column) -> Column:
    """Whether a comparison is flagged: the difference is unknown or beyond the tolerance."""
    return diff_pct.isNull() | (diff_pct > tolerance_)


def drift_issue(diff_pct: Column, tolerance_: Column, region: Column) -> Column:
    """The issue of a flagged slide: difference, tolerance and the worst region (an array of four), which a missing slide hasn't."""
    return F.concat(F.lit("visual drift "), number_text(diff_pct), F.lit("% (>"), number_text(tolerance_), F.lit("%) @"), F.coalesce(F.to_json(region), F.lit("undefined")))


def reconcile(reports: DataFrame, verified: DataFrame, slide: str = "slide_idx") -> DataFrame:
    """Join reports with verified slides by key. Drift becomes an issue; a good comparison drops
    collision and clipping issues; slides without a comparison stay as they are."""
    v = verified.select(F.col(slide).alias("_s"), "diff_pct", "tolerance", "flagged", "worst_region")
    joined = reports.join(v, F.col(slide) == F.col("_s"), "left")
    drift = drift_issue(F.col("diff_pct"), F.col("tolerance"), F.col("worst_region"))
    issues = reconciled(F.col("issues"), F.col("_s").isNotNull(), F.col("flagged"), drift)
    return joined.withColumn("issues", issues).withColumn("needs_review", F.size("issues") > 0).drop("_s", "worst_region")


def reconciled(issues: Column, met: Column, flagged: Column, drift: Column) -> Column:
    """Issues after a comparison, where there was one: the drift's issue too if it is flagged, else those that it doesn't overrule."""
    kept = F.filter(issues, lambda i: ~i.rlike(OVERRULED))
    return F.when(~met, issues).when(flagged, F.concat(issues, F.array(drift))).otherwise(kept)


def needs_fix(flagged: Column, needs_review: Column, image_slide: Column, failed: Column) -> Column:
    return (F.coalesce(flagged, F.lit(False)) | needs_review) & ~image_slide & ~failed


def second_check(layer: DataFrame, diffs: DataFrame, slide: str = "slide_idx", override: float | None = None) -> DataFrame:
    """Reports of slides done again as pictures with a text layer, after their own comparison: coverage, text_count, issues."""
    again = image_report(layer, slide).join(flag_drift(diffs.withColumn("kind", F.lit("image")), override=override), slide)
    issues = F.when(F.col("flagged"), F.array(drift_issue(F.col("diff_pct"), F.col("tolerance"), F.col("worst_region")))).otherwise(F.array().cast("array<string>"))
    return again.withColumn("issues", issues).withColumn("needs_review", F.col("flagged")).drop("kind", "worst_region", "invisible")


def retry_once(reports: DataFrame, again: DataFrame, picked: Column, slide: str = "slide_idx") -> DataFrame:
    """Picked slides take the columns that ``again``, a row a slide, has for them; the others stay. One join; slides are done again once."""
    new = {c: f"_again_{c}" for c in again.columns if c != slide}
    joined = reports.join(again.select(F.col(slide).alias("_s"), *[F.col(c).alias(n) for c, n in new.items()]), (F.col(slide) == F.col("_s")) & picked, "left")
    fixed = F.col("_s").isNotNull()
    kept = {c: F.when(fixed, F.col(n)).otherwise(F.col(c)) if c in reports.columns else F.col(n) for c, n in new.items()}
    return joined.withColumns(kept | {"auto_fixed": fixed}).drop("_s", *new.values())


def failure_rows(slides: DataFrame, message: Column, slide: str = "slide_idx") -> DataFrame:
    """Reports of slides whose conversion failed."""
    return slides.select(slide, F.lit(0).alias("coverage_pct"), F.array(F.concat(F.lit("conversion failed: "), message)).alias("issues"), F.lit(True).alias("needs_review"), F.lit(True).alias("failed"))


def summary(reports: DataFrame) -> DataFrame:
    """One row for a job: slides, reviews, verified, failed, auto-fixed, mean and largest difference to 1 decimal."""
    return reports.agg(
        F.count(F.lit(1)).alias("slides"),
        F.count_if("needs_review").alias("reviews"),
        (F.count(F.lit(1)) - F.count_if("needs_review")).alias("verified"),
        F.count_if("failed").alias("failed"),
        F.count_if("auto_fixed").alias("auto_fixed"),
        F.round(F.avg("diff_pct"), 1).alias("avg_diff"),
        F.round(F.max("diff_pct"), 1).alias("max_diff"),
    )


def shown_cards(reports: DataFrame) -> DataFrame:
    """Each slide with each mode of the filter that leaves it visible: all, ok (without review) or rev (to review). One pass."""
    return reports.withColumn("mode", F.explode(F.array(F.lit("all"), F.when(F.col("needs_review"), "rev").otherwise("ok"))))


def drift_meter(diff_pct: Column, tolerance_: Column) -> Column:
    """A bar of 0 to 100 on which the tolerance is at 75."""
    return F.least(F.lit(100.0), 75 * diff_pct / F.coalesce(tolerance_, F.lit(8.0)))
