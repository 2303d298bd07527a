"""Pixel tables and pixel arrays: sampling, background, differences, regions."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.color import contrast, hex2, quantise
from vellum.operators.cells import crowd, touching
from vellum.operators.geometry import overlap_area

CHANNELS = ("r", "g", "b")


def ring_points(boxes: DataFrame, width: Column, height: Column, away: int = 3) -> DataFrame:
    """Eight points just outside each box, (px, py); those outside the picture are left out."""
    x0, y0, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    mx, my = F.floor((x0 + x1) / 2), F.floor((y0 + y1) / 2)
    at = lambda x, y: F.struct(x.cast("int").alias("px"), y.cast("int").alias("py"))
    points = [at(x, y) for x in (x0, mx, x1) for y in (y0 - away, y1 + away)] + [at(x0 - away, my), at(x1 + away, my)]
    return boxes.select("*", F.explode(F.array(*points)).alias("p")).select("*", "p.px", "p.py").drop("p").where((F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < width) & (F.col("py") < height))


def _halves(c: Column) -> tuple[Column, Column]:
    """A double as the sum of two whose products with other such halves are exact."""
    high = c * 134217729.0 - (c * 134217729.0 - c)
    return high, c - high


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once, for channel values as a or b: the errors of product and sum are exact doubles and added back."""
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    p = a * b
    lost = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = p + c
    z = s - p
    return s + ((p - (s - z)) + (c - z) + lost)


def quantile(ordered: Column, q: float) -> Column:
    """The quantile of an ordered array of doubles between its two nearest values, lo (1 - d) + hi d with product and sum rounded once.

    A limit on it is as sharp as these roundings: DuckDB's quantile_cont takes the same ones, ``percentile`` others.
    """
    at = (F.size(ordered) - 1) * F.lit(q)
    d = at - F.floor(at)
    lo, hi = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return fused(lo, 1.0 - d, hi * d)


def ring_colour(samples: DataFrame, keys: list[str], spread: float = 40) -> DataFrame:
    """Median colour of each ring, and bg: its hex, or null if the channels' 10-90 % range exceeds ``spread``."""
    med = {c: F.median(c).alias(f"med_{c}") for c in CHANNELS}
    ordered = [F.array_sort(F.collect_list(F.col(c).cast("double"))).alias(f"_{c}") for c in CHANNELS]
    wide = F.greatest(*[quantile(F.col(f"_{c}"), 0.9) - quantile(F.col(f"_{c}"), 0.1) for c in CHANNELS])
    out = samples.groupBy(*keys).agg(*med.values(), *ordered).withColumn("spread", wide).drop(*[f"_{c}" for c in CHANNELS])
    colour = F.concat(*[hex2(F.floor(f"med_{c}")) for c in CHANNELS])
    return out.withColumn("bg", F.when(F.col("spread") <= spread, colour))


def middle_colour(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The upper middle of each ring's colours in lexicographic order; white for an empty ring."""
    sorted_ = F.sort_array(F.collect_list(F.struct(*CHANNELS)))
    mid = F.get(sorted_, F.floor(F.size(sorted_) / 2).cast("int"))
    return samples.groupBy(*keys).agg(F.coalesce(F.concat(*[hex2(mid[c]) for c in CHANNELS]), F.lit("FFFFFF")).alias("bg"))


def text_colour(inside: DataFrame, ring: DataFrame, keys: list[str]) -> DataFrame:
    """fg and bg of each box: the median of pixels far (L1 over 120) from the ring's median, if at least 4;
    bg is withdrawn if over 15 % of the pixels are far (over 90) from both; without far pixels fg contrasts;
    a box without any pixel inside keeps its bg, with black text."""
    def away(prefix: str) -> Column:
        return sum((F.abs(F.col(c) - F.col(f"{prefix}_{c}")) for c in CHANNELS), F.lit(0.0))

    near = ring.join(inside, keys, "left").withColumn("far", away("med") > 120)
    fg = near.where("far").groupBy(*keys).agg(*[F.median(c).alias(f"fg_{c}") for c in CHANNELS], F.count(F.lit(1)).alias("n_far")).where("n_far >= 4")
    judged = near.join(fg, keys, "left")
    other = F.count_if((away("med") > 90) & (away("fg") > 90)) / F.count(F.lit(1))
    n_inside = F.count("r").alias("n_inside")
    first = [F.first(c).alias(c) for c in ("bg", *[f"med_{c}" for c in CHANNELS], *[f"fg_{c}" for c in CHANNELS])]
    out = judged.groupBy(*keys).agg(other.alias("other"), n_inside, *first)
    found = F.concat(*[hex2(F.floor(f"fg_{c}")) for c in CHANNELS])
    has = F.col("fg_r").isNotNull()
    return out.select(*keys, F.when(has, found).when(F.col("n_inside") == 0, "000000").otherwise(contrast(*[F.col(f"med_{c}") for c in CHANNELS])).alias("fg"), F.when(~(has & (F.col("other") > 0.15)), F.col("bg")).alias("bg"))


def colour_counts(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """How often each quantised colour occurs."""
    q = pixels.select(*keys, *[quantise(F.col(c)).alias(f"q{c}") for c in CHANNELS])
    return q.groupBy(*keys, "qr", "qg", "qb").agg(F.count(F.lit(1)).alias("n"))


def background_colour(border: DataFrame, keys: list[str], near: int = 60) -> DataFrame:
    """The most frequent quantised border colour (least on ties), refined to the mean of border pixels near it, cut to whole numbers."""
    first = F.struct(-F.col("n"), "qr", "qg", "qb")
    mode = colour_counts(border, keys).groupBy(*keys).agg(F.min_by(F.struct("qr", "qg", "qb"), first).alias("q"))
    joined = border.join(mode, keys)
    close = sum((F.abs(F.col(c) - F.col(f"q.q{c}")) for c in CHANNELS), F.lit(0)) < near
    mean = [F.avg(F.when(close, F.col(c))).alias(f"m{c}") for c in CHANNELS]
    out = joined.groupBy(*keys).agg(*mean, F.first("q").alias("q"))
    return out.select(*keys, *[F.coalesce(F.floor(f"m{c}"), F.col(f"q.q{c}")).cast("int").alias(c) for c in CHANNELS])


def top_colours(pixels: DataFrame, keys: list[str], most: int = 14, share: float = 0.002) -> DataFrame:
    """The most frequent quantised colours of each picture that cover at least ``share`` of it; ties by colour."""
    counts = colour_counts(pixels, keys)
    area = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("area"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "qr", "qg", "qb")
    ranked = counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return ranked.join(area, keys).where(F.col("n") >= F.floor(F.col("area") * share)).drop("area")


def pixel_diff(pairs: DataFrame, keys: list[str], a: list[str], b: list[str], threshold: int = 45) -> DataFrame:
    """changed: whether the channels of two pixels differ by more than the threshold on average."""
    gap = sum((F.abs(F.col(x).cast("int") - F.col(y).cast("int")) for x, y in zip(a, b)), F.lit(0)) / len(a)
    return pairs.withColumn("changed", gap > threshold)


def diff_share(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """diff_pct: the share of changed pixels in percent, to 2 decimals."""
    return pixels.groupBy(*keys).agg(F.bround(100 * F.avg(F.col("changed").cast("int")), 2).alias("diff_pct"))


def worst_cell(pixels: DataFrame, keys: list[str], width: int, height: int, grid: int = 6, frame: tuple[int, int] = (1280, 720)) -> DataFrame:
    """The cell of an even grid with the largest changed share (the first in reading order), in frame pixels.

    Cells have whole sizes; what remains at the right and the bottom belongs to none.
    """
    cw, ch = width // grid, height // grid
    cells = pixels.withColumns({"cx": F.floor(F.col("px") / cw), "cy": F.floor(F.col("py") / ch)}).where((F.col("cx") < grid) & (F.col("cy") < grid))
    share = cells.groupBy(*keys, "cy", "cx").agg(F.avg(F.col("changed").cast("int")).alias("v"))
    best = share.groupBy(*keys).agg(F.min_by(F.struct("cy", "cx", "v"), F.struct(-F.col("v"), "cy", "cx")).alias("c"))
    sx, sy = frame[0] / width, frame[1] / height
    region = [F.floor(F.col("c.cx") * cw * sx), F.floor(F.col("c.cy") * ch * sy), F.lit(int(cw * sx)), F.lit(int(ch * sy))]
    return best.select(*keys, F.array(*[r.cast("int") for r in region]).alias("worst_region"), F.bround(100 * F.col("c.v"), 2).alias("worst_pct"))


def with_missing(sources: DataFrame, diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Every source has a row; those without an output have a null difference and missing true."""
    return sources.select(*keys).join(diffs.withColumn("_there", F.lit(True)), keys, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def embedded_text(texts: DataFrame, parts: DataFrame, slide: str, item: str, width: Column, height: Column) -> DataFrame:
    """Text that stays in its picture: not safe and 60 % inside a padded big part, or tall.

    Big parts cover over 2 % of the picture and are padded by 2.5 % of its width; tall text has
    4.5 % of its height or more.
    """
    pad, large = F.floor(0.025 * width), F.col("w") * F.col("h") > 0.02 * width * height
    sides = [F.lit(None).cast("long").alias(item), (F.col("x") - pad).alias("x"), (F.col("y") - pad).alias("y"), (F.col("w") + 2 * pad).alias("w"), (F.col("h") + 2 * pad).alias("h")]
    asked = texts.where(~F.col("safe")).select(slide, F.col(item).cast("long").alias(item), *[F.col(c) for c in "xywh"])
    both = crowd(asked.unionByName(parts.where(large).select(slide, *sides)), slide)  # both sides of a slide agree whether it is crowded
    met = touching(both.where(F.col(item).isNotNull()), both.where(F.col(item).isNull()).drop(item), slide)
    shared = overlap_area(*[F.col(f"{p}_{c}") for p in "ab" for c in "xywh"]) / F.greatest(F.col("a_w") * F.col("a_h"), F.lit(1))
    inside = met.where(shared >= 0.6).select(F.col(f"a_{slide}").alias(slide), F.col(f"a_{item}").cast(dict(texts.dtypes)[item]).alias(item))
    tall = texts.where(F.col("h") >= 0.045 * height)
    return inside.unionByName(tall.select(slide, item)).distinct()


# ---- regions: per picture, in numpy, as no column function follows connected pixels ----


def closed(mask: np.ndarray, size: int = 7) -> np.ndarray:
    """Morphological closing by a square, of one mask or of each in a stack."""
    return ~dilate(~dilate(mask, size), size, False)


def dilate(mask: np.ndarray, size: int, border: bool = False) -> np.ndarray:
    """True where any pixel of the square around is; beyond the picture counts as ``border``. The last two axes are a picture's."""
    half = size // 2
    out = np.full((*mask.shape[:-2], mask.shape[-2] + 2 * half, mask.shape[-1] + 2 * half), border)
    out[..., half : half + mask.shape[-2], half : half + mask.shape[-1]] = mask
    for axis in (0, 1):
        reach = 1  # doubles: a window of 7 takes three steps
        while reach < size:
            step = min(reach, size - reach)
            ahead, behind = ((..., slice(step, None), slice(None)), (..., slice(None, -step), slice(None))) if axis == 0 else ((..., slice(step, None)), (..., slice(None, -step)))
            out = out[ahead] | out[behind]
            reach += step
    return out


def join_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n things the least one it is linked with, over links a-b: roots are hooked to smaller ones and paths shortened until nothing changes."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root[root] == root).all():
            root = root[root]


@dataclass
class Regions:
    """The 8-connected components of a mask, numbered from 1 in reading order of their first pixel, with all figures as arrays."""

    labels: np.ndarray
    area: np.ndarray
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    h: np.ndarray

    def member(self, i: int) -> np.ndarray:
        """The mask of component i (from 0) in its hull."""
        return self.labels[self.y[i] : self.y[i] + self.h[i], self.x[i] : self.x[i] + self.w[i]] == i + 1


@dataclass
class Runs:
    """The 8-connected components of each mask of a stack by their rows' runs, numbered from 0 in reading order, mask after mask."""

    row: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    number: np.ndarray  # of the component a run belongs to
    mask: np.ndarray  # of components: the place of its mask in the stack, and its figures
    area: np.ndarray
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    h: np.ndarray


def runs_of(masks: np.ndarray) -> Runs:
    """Each row's runs are linked with those they touch in the row above, corners included; all of it in arrays, in linear space."""
    k, h, w = masks.shape
    wide = w + 2
    apart = np.zeros((k, h + 1, wide), bool)  # a free row after each mask and a free column on each side keep masks and rows apart
    apart[:, :h, 1:-1] = masks
    flat = apart.reshape(-1)
    edges = np.flatnonzero(flat[1:] != flat[:-1])
    row, start = np.divmod(edges[::2], wide)
    stop = edges[1::2] - row * wide
    n = len(row)
    # runs of the row above that end at or after this one's start, and start at or before its end
    first = np.searchsorted(edges[1::2], edges[::2] - wide)
    beyond = np.searchsorted(edges[::2], edges[1::2] - wide, side="right")
    count = np.maximum(beyond - first, 0)
    here = np.repeat(np.arange(n), count)
    above = np.arange(len(here)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    roots = join_labels(n, here, above)
    known, number = np.unique(roots, return_inverse=True) if n else (roots, roots)
    parts = len(known)
    low = lambda v: _reduced(np.minimum, v, number, parts)
    high = lambda v: _reduced(np.maximum, v, number, parts)
    x, top = low(start), low(row)
    return Runs(row, start, stop, number, top // (h + 1), np.bincount(number, stop - start, parts).astype(int), x, top % (h + 1), high(stop) - x, high(row) + 1 - top)


def regions(mask: np.ndarray) -> Regions:
    """The components of one mask with their labels."""
    h, w = mask.shape
    r = runs_of(mask[None])
    lengths = r.stop - r.start
    out = np.zeros(h * w, np.int32)
    out[np.repeat(r.row * w + r.start - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())] = np.repeat(r.number + 1, lengths)
    return Regions(out.reshape(h, w), r.area, r.x, r.y, r.w, r.h)


def _reduced(pick: np.ufunc, values: np.ndarray, number: np.ndarray, k: int) -> np.ndarray:
    out = np.empty(k, values.dtype)
    out[number] = values  # any value of its own to begin with
    pick.at(out, number, values)
    return out


def label(mask: np.ndarray) -> np.ndarray:
    """Labels 1, 2, ... of the 8-connected components in reading order of their first pixel; 0 elsewhere."""
    return regions(mask).labels


def box_sums(mask: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How many pixels of a mask each box holds, from one table of running sums."""
    total = np.pad(mask.astype(np.int32).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    return total[y + h, x + w] - total[y, x + w] - total[y + h, x] + total[y, x]


#: The side of the square by which masks are closed.
CLOSING = 7
# Which components of a picture are plain rectangles and which are artwork.
RECT_SIDES, RECT_FILL, RECT_AREA, WHOLE_AREA = (20, 12), 0.72, 0.002, 0.93
ART_AREA, ART_SIDE, ART_MOST = 140, 12, 48
NEAR_BACKGROUND, NEAR_COLOUR, COLOURS = 60, 45, 14
CORNER, CORNER_FILL, ROUND_RADIUS = 6, 0.35, 10


#: Pixels of pictures of one size that are looked at together; a larger picture is alone.
STACK = 1 << 22
#: Cells of masks that are closed together, and rows or columns of cells up to which a picture is taken as cells.
CELLS, FEW = 1 << 17, 64


def colour_codes(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quantised colours as numbers from 0 to 511."""
    return (r >> 5 << 6) | (g >> 5 << 3) | b >> 5


def ranked_colours(picture: np.ndarray, codes: np.ndarray, sizes: np.ndarray, area: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each picture's codes the most frequent ones that cover enough of its area, ties by colour: pictures and colours."""
    counts = np.bincount(picture * 512 + codes, sizes)
    keys = np.flatnonzero(counts)
    n = counts[keys].astype(int)
    order = np.lexsort([keys, -n, keys >> 9])
    keys, n = keys[order], n[order]
    place = np.arange(len(keys)) - np.searchsorted(keys >> 9, keys >> 9)
    keys = keys[(place < COLOURS) & (n >= int(RECT_AREA * area))]
    return keys >> 9, np.stack([keys >> 6 & 7, keys >> 3 & 7, keys & 7], axis=1) * 32 + 16


def main_colours(pixels: np.ndarray, area: int) -> np.ndarray:
    """The ranked colours of a list of pixels of one picture."""
    codes = colour_codes(*pixels.T.astype(np.int64))
    return ranked_colours(np.zeros_like(codes), codes, np.ones_like(codes), area)[1]


def window(masks: np.ndarray, room: int = 6) -> tuple[slice, slice]:
    """The window around all pixels of a stack of masks, with as much room as closing reaches."""
    out = []
    for axis, size in ((2, masks.shape[1]), (1, masks.shape[2])):
        there = np.flatnonzero(masks.any(axis=(0, axis)))
        out.append(slice(max(0, int(there[0]) - room), min(size, int(there[-1]) + 1 + room)) if len(there) else slice(0, 0))
    return out[0], out[1]


def first_of_equal(lines: np.ndarray) -> np.ndarray:
    """Whether each line of each picture (pictures, lines, bytes) differs from the line before it; the first one does."""
    if lines.shape[2] % 8 == 0:
        lines = lines.view(np.uint64)
    out = np.ones(lines.shape[:2], bool)
    out[:, 1:] = (lines[:, 1:] != lines[:, :-1]).any(axis=2)
    return out


def edges_of(starts: np.ndarray) -> np.ndarray:
    """Places of each row's marks and the row's length, which is repeated to fill the table."""
    k, n = starts.shape
    picture, place = np.nonzero(starts)
    counts = starts.sum(axis=1)
    out = np.full((k, counts.max() + 1), n)
    out[picture, np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)] = place
    return out


def cell_starts(rgb: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each picture that aren't like those before them: where its cells begin. A picture of many cells is taken by pixels."""
    k, height, width = text.shape
    flat = rgb.reshape(k, height, width * 3)
    rows = first_of_equal(flat) | first_of_equal(text.view(np.uint8))
    picture, at = np.nonzero(rows)
    begins = np.searchsorted(picture, np.arange(k))
    columns = np.arange(width) == np.zeros((k, 1), int)
    for values, each in ((flat[picture, at], 3), (text[picture, at], 1)):
        n = width * each
        other = np.zeros((len(at), -(-n // 8) * 8), bool)  # put together eight at a time
        np.not_equal(values[:, each:], values[:, :-each], out=other[:, each:n])
        found = np.bitwise_or.reduceat(other.view(np.uint64), begins, axis=0).view(bool)
        for i in range(each):
            columns |= found[:, i:n:each]
    many = (rows.sum(axis=1) > FEW) | (columns.sum(axis=1) > FEW)
    rows[many] = columns[many] = True
    return rows, columns


@dataclass
class Grid:
    """Pictures as cells without a change inside, all of as many rows and columns: those that a picture lacks are empty and come last.

    What closing leaves open is a union of squares, which can be moved until they meet an edge of the mask: a closed mask has no
    edges of its own, and its cells are those of the mask.
    """

    x: np.ndarray  # edges of columns, and of rows, a row a picture
    y: np.ndarray
    pixels: bool  # every cell is a pixel

    @functools.cached_property
    def sizes(self) -> np.ndarray:
        return np.diff(self.y)[:, :, None] * np.diff(self.x)[:, None, :]

    @functools.cached_property
    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        return stretches(self.x, CLOSING), stretches(self.y, CLOSING)

    def closed(self, masks: np.ndarray, picture: np.ndarray) -> np.ndarray:
        """Closing by a square of pixels, of masks of some pictures."""
        out = np.zeros(masks.shape, bool)
        if self.pixels:
            at = window(masks)
            out[:, at[0], at[1]] = closed(masks[:, at[0], at[1]], CLOSING)
            return out
        of_x, of_y = (v[picture] for v in self.stretches)
        inside = np.zeros((len(masks), masks.shape[1] + 2, masks.shape[2] + 2), np.float32)
        inside[:, 1:-1, 1:-1] = masks
        free = (of_y.swapaxes(1, 2) @ ((inside @ of_x) > 0).astype(np.float32)) == 0  # by stretches of rows and columns: squares fit into them
        left = (of_y[:, 1:-1] @ free.astype(np.float32)) > 0
        left = (left.astype(np.float32) @ of_x[:, 1:-1].swapaxes(1, 2)) > 0
        return ~left & (self.sizes[picture] > 0)

    def grown(self, masks: np.ndarray, picture: np.ndarray) -> tuple[Grid, np.ndarray]:
        """Masks of some pictures, grown by one pixel on all sides, with their own cells."""
        if self.pixels:
            return Grid(self.x[picture], self.y[picture], True), dilate(masks, 3)
        new, touched = [], []
        for edges in (self.x[picture], self.y[picture]):
            end = edges[:, -1:]
            cuts = np.sort(np.clip(np.concatenate([edges - 1, edges + 1], axis=1), 0, end), axis=1)
            cuts[:, 1:][cuts[:, 1:] == cuts[:, :-1]] = end[0, 0]  # equal ones go last
            cuts = np.concatenate([cuts, end], axis=1)
            cuts.sort(axis=1)
            new.append(cuts)
            a, b, low, high = edges[:, :-1, None], edges[:, 1:, None], cuts[:, None, :-1], cuts[:, None, 1:]
            touched.append(((a < high + 1) & (b > low - 1) & (low < high)).astype(np.float32))
        return Grid(new[0], new[1], False), (touched[1].swapaxes(1, 2) @ (masks @ touched[0])) > 0


def stretches(edges: np.ndarray, size: int) -> np.ndarray:
    """Which cells (pictures, cells, stretches; 1 or 0) are in each of the least stretches of cells that are ``size`` wide at least.

    They begin or end with any cell. Around a picture are cells of half the size. What is in no stretch is in no column of the table.
    """
    half = size // 2
    e = np.concatenate([edges[:, :1] - half, edges, edges[:, -1:] + half], axis=1)
    low, high, n = e[:, :-1], e[:, 1:], e.shape[1] - 1
    wide = high[:, None, :] - low[:, :, None] >= size  # from a cell to another one
    one = np.arange(n)
    to = np.where(wide.any(axis=2), wide.argmax(axis=2), -1)  # the first that is far enough
    since = np.where(wide.any(axis=1), n - 1 - wide[:, ::-1].argmax(axis=1), n)  # the last that is
    begin = np.concatenate([np.broadcast_to(one, to.shape), since], axis=1)
    end = np.concatenate([to, np.broadcast_to(one, to.shape)], axis=1)
    own = np.concatenate([to >= 0, (since < n) & (np.take_along_axis(to, np.minimum(since, n - 1), axis=1) != one)], axis=1)  # those that are there, once
    order = np.argsort(~own, axis=1, kind="stable")[:, : own.sum(axis=1).max()]
    begin, end, own = (np.take_along_axis(v, order, axis=1)[:, None, :] for v in (begin, end, own))
    return ((one[:, None] >= begin) & (one[:, None] <= end) & own).astype(np.float32)


def rects_of_masks(filled: np.ndarray, picture: np.ndarray, grid: Grid, text: np.ndarray, sums: np.ndarray, cover: np.ndarray) -> list[tuple[int, dict]]:
    """The rectangles among the regions of a stack of closed masks, each with its picture's place; ``cover`` marks where their cells' runs begin and end.

    Text on a rectangle counts as part of it: ``text`` are running sums of its pixels by rows and columns of cells. ``sums`` are those of each channel by columns.
    """
    found = runs_of(filled)
    height, width = grid.y[0, -1], grid.x[0, -1]
    area, of = height * width, picture[found.mask]
    x, y = grid.x[of, found.x], grid.y[of, found.y]
    w, h = grid.x[of, found.x + found.w] - x, grid.y[of, found.y + found.h] - y
    number, line, run_of = found.number, found.row % (filled.shape[1] + 1), of[found.number]
    left, right, upper, lower = grid.x[run_of, found.start], grid.x[run_of, found.stop], grid.y[run_of, line], grid.y[run_of, line + 1]
    total = lambda v: np.bincount(number, v, len(of)).astype(int)  # noqa: E731  whole numbers, exact
    own, hull = total((right - left) * (lower - upper)), w * h
    y1, x1 = found.y + found.h, found.x + found.w
    texts = text[of, y1, x1] - text[of, found.y, x1] - text[of, y1, found.x] + text[of, found.y, found.x]
    good = (own >= int(RECT_AREA * area)) & (w >= RECT_SIDES[0]) & (h >= RECT_SIDES[1]) & (hull <= WHOLE_AREA * area) & ((own + texts) / hull >= RECT_FILL)
    if not good.any():
        return []
    means = np.stack([total(c[run_of, line, found.stop] - c[run_of, line, found.start]) / own for c in sums], axis=1).astype(int)
    high = np.maximum(np.minimum(lower, y[number] + CORNER) - upper, 0)  # rows of the upper corners
    corner = lambda at: total(high * np.maximum(np.minimum(right, at[number] + CORNER) - np.maximum(left, at[number]), 0))
    open_corners = (corner(x) / CORNER**2 < CORNER_FILL) & (corner(x + w - CORNER) / CORNER**2 < CORNER_FILL)
    kept = good[number]
    np.add.at(cover, (run_of[kept], line[kept], found.start[kept]), 1)
    np.add.at(cover, (run_of[kept], line[kept], found.stop[kept]), -1)
    at = np.flatnonzero(good)
    rows = zip(*(v[at].tolist() for v in (of, x, y, w, h, own, open_corners)), means[at].tolist())
    return [(of, {"kind": "rect", "x": x, "y": y, "w": w, "h": h, "area": area, "color": bytes(mean).hex().upper(), "radius": ROUND_RADIUS if rounded else 0}) for of, x, y, w, h, area, rounded, mean in rows]


def find_rects_in_cells(grid: Grid, planes: np.ndarray, bg: np.ndarray, text: np.ndarray) -> list[tuple[list[dict], list[dict]]]:
    """``find_rects_of`` of pictures as cells: a plane of cells (pictures, rows, columns) a channel."""
    sizes, area, out = grid.sizes, int(grid.y[0, -1] * grid.x[0, -1]), [([], []) for _ in bg]
    off = sum(np.abs(planes[c] - bg[:, c, None, None].astype(np.int16)) for c in range(3))
    first = (off >= NEAR_BACKGROUND) & ~text & (sizes > 0)
    at = np.nonzero(first)
    picture, colours = ranked_colours(at[0], colour_codes(*(p[at] for p in planes)).astype(np.int64), sizes[at], area)
    k, height, width = text.shape
    texts, sums = np.zeros((k, height + 1, width + 1), np.int64), [np.zeros((k, height, width + 1), np.int64) for _ in planes]
    texts[:, 1:, 1:] = (text * sizes).cumsum(axis=1).cumsum(axis=2)
    for total, p in zip(sums, planes):
        np.cumsum(p * sizes, axis=2, out=total[:, :, 1:])
    cover = np.zeros(sums[0].shape, np.int32)
    step = max(1, CELLS // first[0].size)
    for i in range(0, len(picture), step):
        some, colour = picture[i : i + step], colours[i : i + step].astype(np.int16)
        near = sum(np.abs(planes[c][some] - colour[:, c, None, None]) for c in range(3)) < NEAR_COLOUR
        for at, rect in rects_of_masks(grid.closed(near & first[some], some), some, grid, texts, sums, cover):
            out[at][0].append(rect)
    rest = first & (cover.cumsum(axis=2)[:, :, :-1] == 0)  # the running sum is how many rectangles' runs hold a cell
    some = np.flatnonzero(rest.any(axis=(1, 2)))
    out = [(sorted(rects, key=lambda r: -r["area"]), art) for rects, art in out]
    if not len(some):
        return out
    cells, grown = grid.grown(grid.closed(rest[some], some), some)
    found = runs_of(grown)
    x, y = cells.x[found.mask, found.x], cells.y[found.mask, found.y]
    w, h = cells.x[found.mask, found.x + found.w] - x, cells.y[found.mask, found.y + found.h] - y
    line, run_of = found.row % (grown.shape[1] + 1), found.mask[found.number]
    own = np.bincount(found.number, (cells.x[run_of, found.stop] - cells.x[run_of, found.start]) * (cells.y[run_of, line + 1] - cells.y[run_of, line]), len(x)).astype(int)
    kept = np.flatnonzero((own >= ART_AREA) & (np.maximum(w, h) >= ART_SIDE))
    kept = kept[np.lexsort([-c[kept] for c in (h, w, y, x, own)])]
    for at, *figures in zip(*(v[kept].tolist() for v in (some[found.mask], x, y, w, h, own))):
        art = out[at][1]
        if len(art) < ART_MOST:
            art.append({"kind": "art", **dict(zip(("x", "y", "w", "h", "area"), figures)), "color": None, "radius": None})
    return out


def find_rects_of(rgb: np.ndarray, bg: np.ndarray, text: np.ndarray) -> list[tuple[list[dict], list[dict]]]:
    """Plain rectangles (area descending) and art regions (at most 48, largest first) of each picture of a stack.

    Slides are flat: neighbouring rows and columns that are alike become one cell, and all pictures of about as many cells and all
    their colours are looked at together, as the cost of small pictures is in the calls.
    """
    rows, columns = cell_starts(rgb, text)
    cells = rows.sum(axis=1) * columns.sum(axis=1)
    kind = np.where(cells == text[0].size, -1, np.frexp(cells)[1] // 2)
    out = [([], [])] * len(text)
    for one in np.unique(kind):
        some = np.flatnonzero(kind == one)
        if one < 0:  # by pixels, in small stacks
            parts = np.split(some, range(max(1, (CELLS << 1) // text[0].size), len(some), max(1, (CELLS << 1) // text[0].size)))
        else:
            parts = [some]
        for part in parts:
            grid = Grid(edges_of(columns[part]), edges_of(rows[part]), bool(one < 0))
            y, x = np.minimum(grid.y[:, :-1, None], text.shape[1] - 1), np.minimum(grid.x[:, None, :-1], text.shape[2] - 1)
            at = part[:, None, None], y, x
            found = find_rects_in_cells(grid, np.moveaxis(rgb[at], -1, 0).astype(np.int16, order="C"), bg[part], text[at])
            for k, f in zip(part, found):
                out[k] = f
    return out


def find_rects(rgb: np.ndarray, bg: np.ndarray, text: np.ndarray) -> tuple[list[dict], list[dict]]:
    """``find_rects_of`` of one picture."""
    return find_rects_of(rgb[None], bg[None], text[None])[0]


def find_rects_in(pictures: Iterable[dict]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, list[dict], list[dict]]]:
    """Rows of pictures with their pixels, text mask, rectangles and art, in order; neighbours of one size are looked at together."""
    for shape, rows in itertools.groupby(pictures, key=lambda row: (int(row["height"]), int(row["width"]))):
        while some := list(itertools.islice(rows, max(1, STACK // max(1, shape[0] * shape[1])))):
            rgb = np.stack([np.frombuffer(row["pixels"], np.uint8).reshape(*shape, 3) for row in some])
            text = np.stack([np.frombuffer(row["text"], np.uint8).reshape(shape) > 0 for row in some])
            found = find_rects_of(rgb, np.array([list(row["bg"]) for row in some], np.int16), text)
            yield from ((row, rgb[i], text[i], *found[i]) for i, row in enumerate(some))


PARTS = "part_idx int, kind string, x int, y int, w int, h int, area int, color string, radius int"


def part_rows(pictures: Iterable[dict], slide: str) -> list[dict]:
    """Parts of some pictures."""
    return [{slide: row[slide], "part_idx": i} | p for row, _, _, rects, art in find_rects_in(pictures) for i, p in enumerate(rects + art)]


def decompose(pictures: DataFrame, slide: str = "slide_idx") -> DataFrame:
    """Rectangles and art regions of pictures (slide, width, height, pixels: flat rgb bytes, bg array, text: flat mask bytes)."""
    schema = f"{slide} long, {PARTS}"

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame(part_rows(pdf.to_dict("records"), slide), columns=[c.split()[0] for c in schema.split(", ")])

    return pictures.select(slide, "width", "height", "pixels", "bg", "text").mapInPandas(run, schema)


def mask_regions(masks: DataFrame, slide: str = "slide_idx", closing: int = 7) -> DataFrame:
    """Regions of masks (slide, width, height, mask: flat bytes, not 0 inside) after closing: region_idx, area and hull."""
    names = ["region_idx", "area", "x", "y", "w", "h"]

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                found = regions(closed(np.frombuffer(row["mask"], np.uint8).reshape(row["height"], row["width"]) > 0, closing))
                yield pd.DataFrame({slide: row[slide], "region_idx": np.arange(len(found.area)), **{k: getattr(found, k) for k in names[1:]}})

    return masks.select(slide, "width", "height", "mask").mapInPandas(run, f"{slide} long, " + ", ".join(f"{k} int" for k in names))
