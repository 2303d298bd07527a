"""Pixel sizes from the headers of PNG and JPEG bytes, by column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = (1280, 720)


#: Segments and stray bytes stepped over before the rest of a long header is walked.
STEPS = 64


def _number(content: Column, at: Column | int, size: int) -> Column:
    """The big-endian number of ``size`` bytes from byte ``at``."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(content, at + 1, F.lit(size))), 16, 10).cast("int")


def image_size(content: Column) -> Column:
    """struct(w, h): PNG from its first chunk, JPEG from its first frame segment, else 1280 x 720.

    A JPEG is walked segment by segment (marker, length); bytes outside a segment are stepped over
    one at a time. STEPS steps reach the frame of usual files; only others are walked to their end.
    """
    png = (F.length(content) > 24) & (F.hex(F.substring(content, 2, 3)) == "504E47")
    jpeg = F.hex(F.substring(content, 1, 2)) == "FFD8"

    def step(state: Column, _: Column) -> Column:
        o = state["o"]
        mark = _number(content, o + 1, 1)
        here = _number(content, o, 1) == 0xFF
        frame = here & mark.between(0xC0, 0xCF) & ~mark.isin(0xC4, 0xC8, 0xCC)
        after = F.when(here, o + 2 + F.coalesce(_number(content, o + 2, 2), F.lit(0))).otherwise(o + 1)
        return F.when(state["done"], state).otherwise(F.struct(F.when(frame, o).otherwise(after).alias("o"), (frame | (after >= F.length(content))).alias("done"), frame.alias("found")))

    start = F.struct(F.lit(2).alias("o"), F.lit(False).alias("done"), F.lit(False).alias("found"))
    near = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    walked = F.when(near["done"], near).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(content), F.lit(1))), near, step))
    of = lambda w, h: F.struct(w.alias("w"), h.alias("h"))
    return F.when(png, of(_number(content, 16, 4), _number(content, 20, 4))).when(jpeg & walked["found"], of(_number(content, walked["o"] + 7, 2), _number(content, walked["o"] + 5, 2))).otherwise(of(F.lit(DEFAULT[0]), F.lit(DEFAULT[1])))
