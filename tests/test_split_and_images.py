"""Splitting rules, sources, image headers, picture regions."""

import numpy as np
from pyspark.sql import functions as F

from vellum.operators import pixels
from vellum.sources import split
from vellum.sources.image_header import image_size


def test_rules(spark):
    texts = {
        "doctype": " <!DOCTYPE html><html>a</html>\n<!doctype HTML><html>b</html> ",
        "html": "<html lang=x>a</html><html>b</html>",
        "div": "<div class='slide-container'>a</div> <div id=1 class=\"x slide-container\">b</div>",
        "one": "<p>a</p>",
        "empty": " \n",
    }
    df = spark.createDataFrame(list(texts.items()), "path string, content string")
    rows = split.split_documents(df, "content", "path").orderBy("path", "slide_idx").collect()
    assert [(r.path, r.name, r.html[:5]) for r in rows if r.path == "doctype"] == [("doctype", "doctype-01", "<!DOC"), ("doctype", "doctype-02", "<!doc")]
    assert {p: sum(r.path == p for r in rows) for p in texts} == {"doctype": 2, "html": 2, "div": 2, "one": 1, "empty": 0}


def test_read_pages(spark, tmp_path):
    for name, body in (("b.html", "<p>2"), ("a.htm", "<p>1"), ("c.txt", "no")):
        (tmp_path / name).write_text(body)
    assert [r.content for r in split.read_pages(spark, str(tmp_path)).collect()] == ["<p>1", "<p>2"]


def test_image_sizes(spark):
    jpeg = bytes.fromhex("FFD8FFE000104A46494600010100000100010000FFC4000401FF00FFC20011080102030403") + bytes(9)
    png = b"\x89PNG\r\n\x1a\n" + bytes(4) + b"IHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + bytes(5)
    df = spark.createDataFrame([(0, bytearray(jpeg)), (1, bytearray(png)), (2, bytearray(b"\xff\xd8")), (3, bytearray(b"x"))], "i int, c binary")
    got = {r.i: tuple(r.s) for r in df.select("i", image_size(F.col("c")).alias("s")).collect()}
    assert got == {0: (0x0304, 0x0102), 1: (640, 480), 2: (1280, 720), 3: (1280, 720)}


def flood(mask):
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if not out[y, x]:
            n += 1
            stack = [(y, x)]
            while stack:
                a, b = stack.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                    out[a, b] = n
                    stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


def test_labels_match_flood_fill():
    r = np.random.default_rng(3)
    for density in (0.2, 0.45, 0.7):
        for _ in range(5):
            m = r.random((19, 27)) < density
            assert (pixels.label(m) == flood(m)).all()


def test_rectangles_found():
    rgb = np.full((90, 160, 3), 240, np.uint8)
    rgb[10:50, 20:90] = (16, 80, 144)
    rects, art = pixels.find_rects(rgb, np.array([240] * 3, np.int16), np.zeros((90, 160), bool))
    assert [(p["x"], p["y"], p["w"], p["h"], p["color"], p["radius"]) for p in rects] == [(20, 10, 70, 40, "105090", 0)] and not art
    assert pixels.find_rects(np.full((90, 160, 3), 240, np.uint8), np.array([240] * 3, np.int16), np.zeros((90, 160), bool)) == ([], [])


def test_drawn_pictures_are_not_shrunk_further(spark, sf):
    """Pictures are an eighth of a slide, so boxes of 160 slide pixels can be rectangles of their own."""
    from vellum.plans.queries import QUERIES

    rects = QUERIES["decompose_pictures"](spark, sf).where("kind = 'rect'").collect()
    assert any(r.x + r.w > 80 for r in rects) and any(r.y + r.h > 45 for r in rects)


def test_inputs_of_folders_and_files(spark, tmp_path):
    (tmp_path / "d" / "deep").mkdir(parents=True)
    for name in ("b.HTML", "a.Htm", "c.html", "no.txt", "deep/x.html"):
        (tmp_path / "d" / name).write_text(f"<h1>{name}</h1>")
    (tmp_path / "notes 1.TXT").write_text("plain")
    got = split.read_inputs(spark, [(str(tmp_path / "notes 1.TXT"), False), (str(tmp_path / "d"), True)])
    assert [(r.input_idx, r.path.rsplit("/", 1)[1]) for r in got.orderBy("input_idx", "path").collect()] == [(0, "notes 1.TXT"), (1, "a.Htm"), (1, "b.HTML"), (1, "c.html")]
    slides = split.split_documents(got, "content", "path").orderBy("input_idx", "path").collect()
    assert [(r.name, r.title) for r in slides] == [("notes 1", "notes 1"), ("a", "a.Htm"), ("b", "b.HTML"), ("c", "c.html")]


def test_pasted_strings_are_titled_by_their_number(spark):
    df = spark.createDataFrame([(0, "<p>x</p>"), (1, "<h1>T</h1>")], "idx int, content string").withColumn("path", F.lit("paste"))
    out = split.number_documents(split.split_documents(df, "content", "path").withColumn("job", F.lit(1)), ["idx", "slide_idx"], ["job"])
    assert [(r["name"], r.title) for r in out.orderBy("idx").collect()] == [("slide-01", "slide-01"), ("slide-02", "T")]


def test_titles_count_script_units(spark):
    from vellum.functions.text import utf16_prefix

    texts = ["a" * 70, "\U0001f600" * 40, "a" + "\U0001f600" * 40, "short", "é" * 61]
    want = ["a" * 60, "\U0001f600" * 30, "a" + "\U0001f600" * 29, "short", "é" * 60]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.p for r in df.select("i", utf16_prefix(F.col("t"), 60).alias("p")).orderBy("i").collect()] == want


def test_jpeg_with_a_long_header(spark):
    from vellum.sources.image_header import image_size

    comment = b"\xff\xfe\x00\x04ab"
    frame = b"\xff\xc2\x00\x11\x08" + (300).to_bytes(2, "big") + (500).to_bytes(2, "big") + b"\x03"
    df = spark.createDataFrame([(n, bytearray(b"\xff\xd8" + comment * n + frame)) for n in (0, 1, 63, 64, 200)], "n int, c binary")
    assert {(r.s.w, r.s.h) for r in df.select(image_size(F.col("c")).alias("s")).collect()} == {(500, 300)}
