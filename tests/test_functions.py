"""Edge cases of scalar functions."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import color, media, text
from vellum.operators import geometry, mapping, segments


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("x, want", [(2.5, 3), (-2.5, -2), (0.4, 0), (-0.5, 0)])
def test_half_up(spark, x, want):
    assert value(spark, text.half_up(F.lit(x))) == want


def test_trim_takes_script_white_space(spark):
    assert value(spark, text.trim(F.lit(" ﻿ a b　\t"))) == "a b"
    assert value(spark, text.trim(F.lit("​a\u0085"))) == "​a\u0085"
    assert value(spark, text.squeeze(F.lit(" a \n b "))) == "a b"


@pytest.mark.parametrize("s, want", [("12px", 12.0), ("-.5em", -0.5), ("1e2x", 100.0), ("px", None), ("", None)])
def test_leading_number(spark, s, want):
    assert value(spark, text.leading_number(F.lit(s))) == want


def test_padding_never_cuts(spark):
    assert value(spark, text.pad_left(F.lit("123"), 2)) == "123"
    assert value(spark, text.pad_right(F.lit("WARN"), 5)) == "WARN "


@pytest.mark.parametrize(
    "c, want",
    [
        ("rgb(255, 0, 16)", ("FF0010", 1.0)),
        ("rgba(300,-4,1.5,0.25)", ("FF0002", 0.25)),
        ("rgba(1,2,3)", ("010203", 1.0)),
        ("#a1b2c3", ("A1B2C3", 1.0)),
        ("a1b2c", (None, 0.0)),
        ("transparent", (None, 0.0)),
        (None, (None, 0.0)),
    ],
)
def test_parse_color(spark, c, want):
    assert tuple(value(spark, color.parse_color(F.lit(c).cast("string")))) == want


@pytest.mark.parametrize("s, want", [("'Segoe UI', x", "Segoe UI"), ("Fira Code", "Consolas"), ("Barlow Condensed", "Arial Narrow"), ("Lora, serif", "Georgia"), ("Inter, sans-serif", "Arial"), ("", "Arial"), (None, "Arial")])
def test_system_font(spark, s, want):
    assert value(spark, color.system_font(F.lit(s).cast("string"))) == want


def test_titles(spark):
    def title(html):
        return value(spark, text.page_title(F.lit(html), F.lit("fallback")))

    assert title("<title> <b>x</b> </title>") == "<b>x</b>"
    assert title("<TITLE></TITLE><h1 id=1><i>" + "y" * 70 + "</i></h1>") == "y" * 60
    assert title("<h1> </h1>") == "fallback"


def test_upload_content(spark):
    assert bytes(value(spark, media.upload_content(F.lit("data:text/html;base64,SGk=")))) == b"Hi"
    assert bytes(value(spark, media.upload_content(F.lit("plain")))) == b"plain"


def test_local_assets(spark):
    assert value(spark, media.local_asset(F.lit("https://x/Chart.js"))) == "/assets/charts/chart.min.js"
    assert value(spark, media.local_asset(F.lit("https://x/other.js"))) is None


def test_column_widths_take_the_first_widest_row(spark):
    df = spark.createDataFrame([([[{"wpx": 5}], [{"wpx": 30}, {"wpx": 10}], [{"wpx": 1}, {"wpx": 1}]],), ([[{"wpx": 0}, {"wpx": 4}]],)], "rows array<array<struct<wpx:int>>>")
    assert [r.w for r in df.select(mapping.column_widths(F.col("rows"), F.lit(8.0)).alias("w")).collect()] == [[6.0, 2.0], None]


def test_junk_words(spark):
    cases = [("#", 99, True), ("g°", 99, True), ("ab", 99, False), ("abc", 50, True), ("abcd", 50, False), ("a", None, False)]
    df = spark.createDataFrame([(t, c) for t, c, _ in cases], "text string, conf int")
    assert [r.j for r in df.select(segments.is_junk(F.col("text"), F.col("conf")).alias("j")).collect()] == [j for *_, j in cases]


def test_rotation_and_radius(spark):
    assert value(spark, geometry.rotation(F.lit("matrix(0, 1, -1, 0, 0, 0)"))) == 90
    assert value(spark, geometry.rotation(F.lit("none"))) == 0
    assert value(spark, geometry.radius_of(F.lit("50%"), F.lit(40), F.lit(20))) == 10
