"""Text wiped out of pictures, and crops of artwork and titles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.pixels import find_rects_in

RADIUS = 3
#: Pixels around artwork that its crop takes along, and around a text's box that are wiped with it.
AROUND = 2
#: Pixels that are filled together.
BLOCK = 1 << 14


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) within the radius, without the centre."""
    span = range(-radius, radius + 1)
    return [(dy, dx) for dy in span for dx in span if 0 < dy * dy + dx * dx <= radius * radius]


def inpaint(rgb: np.ndarray, mask: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Fill the masked pixels from what is around them, ring by ring from the mask's edge inwards.

    A ring is the unfilled pixels with a filled neighbour above, below, left or right. Each takes the weighted mean of the
    filled pixels within the radius; a weight falls with the squared distance and with the number of rings between the two.
    A ring only looks at rings before it, so the order in it doesn't matter. A mask over the whole picture changes nothing.
    """
    out = rgb.copy()
    if not mask.any():
        return out
    at = tuple(slice(max(0, int(v.min()) - radius), int(v.max()) + 1 + radius) for v in np.nonzero(mask))
    mask = mask[at]  # no pixel further off than the radius plays a part
    h, w = mask.shape
    wide, inner = w + 2 * radius, (slice(radius, radius + h), slice(radius, radius + w))
    values, ring, open_ = np.zeros((h + 2 * radius, wide, 3)), np.full((h + 2 * radius, wide), -1), np.zeros((h + 2 * radius, wide), bool)
    values[inner], open_[inner] = rgb[at], mask
    ring[inner] = np.where(mask, -1, 0)  # -1: not filled, or outside
    values, ring = values.reshape(-1, 3), ring.ravel()
    offsets = np.array([dy * wide + dx for dy, dx in disc(radius)])[:, None]
    shares = np.array([1.0 / (dy * dy + dx * dx) for dy, dx in disc(radius)])[:, None]
    sides = np.array([-wide, wide, -1, 1])[:, None]
    left = np.flatnonzero(open_)
    for number in range(1, h * w + 1):
        near = (ring[left + sides] >= 0).any(axis=0)
        if not near.any():
            break
        front = left[near]
        for i in range(0, len(front), BLOCK):
            here = front[i : i + BLOCK]
            there = ring[here + offsets]
            own = np.where(there >= 0, shares / (1 + number - there), 0.0)
            parts = own[:, :, None] * values[here + offsets]
            total, weight = np.zeros((len(here), 3)), np.zeros(len(here))
            for part, some in zip(parts, own):  # in the order of the offsets, so that sums round alike
                total += part
                weight += some
            values[here] = np.floor(total / weight[:, None] + 0.5)
        ring[front] = number
        left = left[~near]
    out[at] = values.reshape(-1, wide, 3)[inner]
    return out


def text_roles(texts: DataFrame, inside: DataFrame, slide: str, item: str, height: float) -> DataFrame:
    """Add role: baked (in ``inside``: it stays in its artwork), title (tall: it stays as a crop of its own) or wiped."""
    there = inside.select(F.col(slide).alias("_s"), F.col(item).alias("_i")).distinct()
    joined = texts.join(there, (F.col(slide) == F.col("_s")) & (F.col(item) == F.col("_i")), "left")
    role = F.when(F.col("_s").isNotNull(), "baked").when(F.col("h") >= 0.045 * height, "title").otherwise("wiped")
    return joined.withColumn("role", role).drop("_s", "_i")


def around(box: dict, width: int, height: int, more: int = AROUND) -> tuple[int, int, int, int]:
    """Corners of a box with its surroundings, inside the picture."""
    return max(0, int(box["x"]) - more), max(0, int(box["y"]) - more), min(width, int(box["x"] + box["w"]) + more), min(height, int(box["y"] + box["h"]) + more)


def crops(rgb: np.ndarray, text: np.ndarray, art: list[dict], texts: list[dict]) -> list[dict]:
    """Crops of a picture: each art region, then each title, with replaceable text wiped out (kind, x, y, w, h, pixels).

    Wiped is the text mask less the boxes of texts that stay, baked or as titles. Titles under two pixels give none.
    """
    height, width = text.shape
    clean = rgb
    if text.any():
        wipe = text.copy()
        for t in texts:
            if t["role"] != "wiped":
                x0, y0, x1, y1 = around(t, width, height)
                wipe[y0:y1, x0:x1] = False
        if wipe.any():
            clean = inpaint(rgb, wipe)
    boxes = [("art", around(a, width, height)) for a in art] + [("title", around(t, width, height)) for t in texts if t["role"] == "title"]
    lines = clean.reshape(height, -1)  # whole stretches of bytes are copied
    cut = [{"kind": k, "x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0, "pixels": np.ascontiguousarray(lines[y0:y1, 3 * x0 : 3 * x1]).tobytes()} for k, (x0, y0, x1, y1) in boxes if k == "art" or min(x1 - x0, y1 - y0) >= 2]
    return [{"crop_idx": i} | c for i, c in enumerate(cut)]


def crop_rows(pictures: Iterable[dict], slide: str) -> Iterator[dict]:
    """Crops of some pictures, by ``crops``, of the art regions found in them."""
    for row, rgb, text, _, art in find_rects_in(pictures):
        yield from ({slide: row[slide]} | c for c in crops(rgb, text, art, list(row["texts"])))


def crop_pictures(pictures: DataFrame, slide: str = "slide_idx") -> DataFrame:
    """Crops of pictures (slide, width, height, pixels, bg, text, texts: array of structs x, y, w, h, role)."""
    schema = f"{slide} long, crop_idx int, kind string, x int, y int, w int, h int, pixels binary"

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame(crop_rows(pdf.to_dict("records"), slide), columns=[c.split()[0] for c in schema.split(", ")])

    return pictures.select(slide, "width", "height", "pixels", "bg", "text", "texts").mapInPandas(run, schema)
