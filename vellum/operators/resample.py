"""Pictures of any size compared in one frame: letterbox and separable cubic resampling with antialiasing."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# The frame in which pictures are compared, its grid, the mean difference from which a pixel counts as changed, and the slide's size.
FRAME, GRID, CHANGED, SLIDE = (640, 360), 6, 45, (1280, 720)
#: Fractional bits of a weight; sums of weighted 8-bit values stay exact in doubles.
BITS = 22
#: Rows of a resized picture that are summed at a time.
BLOCK = 32


def cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    """The cubic convolution kernel."""
    x = np.abs(x)
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, (((x - 5) * x + 8) * x - 4) * a, 0.0))


@functools.lru_cache(maxsize=64)
def weights(size: int, to: int) -> np.ndarray:
    """A matrix (size, to) of whole weights in 2^-BITS: how an axis of ``size`` samples becomes one of ``to``.

    When the axis shrinks the kernel is widened by as much, so every sample counts.
    """
    scale = size / to
    wide = max(scale, 1.0)
    out = np.zeros((size, to))
    for i in range(to):
        centre = (i + 0.5) * scale
        low, high = max(0, int(centre - 2 * wide + 0.5)), min(size, int(centre + 2 * wide + 0.5))
        w = cubic((np.arange(low, high) + 0.5 - centre) / wide)
        out[low:high, i] = w / w.sum()
    return np.trunc(out * (1 << BITS) + np.where(out < 0, -0.5, 0.5))


@functools.lru_cache(maxsize=64)
def _halved(size: int, to: int) -> np.ndarray:
    """The weights as parts of one, and a last row of halves, which a constant sample of one takes: sums need no more than cutting to whole numbers."""
    return np.vstack([weights(size, to) / (1 << BITS), np.full((1, to), 0.5)])


def _cut(sums: np.ndarray) -> np.ndarray:
    return np.clip(sums, 0, 255, out=sums).astype(np.uint8)


def _along_rows(planes: np.ndarray, to: int) -> np.ndarray:
    h, c, w = planes.shape
    if w == to:
        return planes
    samples = np.ones((h * c, w + 1))
    samples[:, :w] = planes.reshape(-1, w)
    return _cut(samples @ _halved(w, to)).reshape(h, c, to)


def _along_columns(planes: np.ndarray, to: int) -> np.ndarray:
    h, c, w = planes.shape
    if h == to:
        return planes
    samples = np.ones((h + 1, c * w))
    samples[:h] = planes.reshape(h, -1)
    across, out = np.ascontiguousarray(_halved(h, to).T), np.empty((to, c * w), np.uint8)
    some = np.empty((min(BLOCK, to), c * w))  # sums of some rows at a time stay in the cache
    for i in range(0, to, BLOCK):
        part = some[: min(BLOCK, to - i)]
        out[i : i + BLOCK] = _cut(np.matmul(across[i : i + BLOCK], samples, out=part))
    return out.reshape(to, c, w)


def resize_planes(planes: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pictures of one size as planes (height, channels of all of them, width): rows first, then columns, each rounded to 8 bits."""
    return _along_columns(_along_rows(planes, width), height)


def resize(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """One picture (height, width, 3)."""
    return resize_planes(rgb.swapaxes(1, 2), width, height).swapaxes(1, 2)


def letterbox(rgb: np.ndarray, width: int, height: int, background: int = 255) -> np.ndarray:
    """The picture scaled to fit the frame, in its middle."""
    h, w = rgb.shape[:2]
    s = min(width / w, height / h)
    nw, nh = max(1, int(w * s)), max(1, int(h * s))
    out = np.full((height, width, 3), background, np.uint8)
    x, y = (width - nw) // 2, (height - nh) // 2
    out[y : y + nh, x : x + nw] = resize(rgb, nw, nh)
    return out


def compare(source: np.ndarray, output: np.ndarray) -> tuple[float, list[int], float]:
    """Changed share in percent, and the worst cell (in slide pixels) with its share, of a source against its output.

    The source is put into the output's frame first, so content fitted into it compares fairly.
    """
    both = np.concatenate([letterbox(source, output.shape[1], output.shape[0]), output], axis=2).swapaxes(1, 2)  # of one size now
    both = resize_planes(both, *FRAME)
    gaps = np.maximum(both[:, :3], both[:, 3:]) - np.minimum(both[:, :3], both[:, 3:])
    changed = gaps.sum(axis=1, dtype=np.int16) > CHANGED * 3
    cw, ch = FRAME[0] // GRID, FRAME[1] // GRID
    cells = changed[: ch * GRID, : cw * GRID].reshape(GRID, ch, GRID, cw).mean(axis=(1, 3))
    cy, cx = divmod(int(cells.argmax()), GRID)
    sx, sy = SLIDE[0] / FRAME[0], SLIDE[1] / FRAME[1]
    return round(float(changed.mean()) * 100, 2), [int(cx * cw * sx), int(cy * ch * sy), int(cw * sx), int(ch * sy)], round(float(cells.max()) * 100, 2)


def compare_pictures(pairs: DataFrame, slide: str = "slide_idx") -> DataFrame:
    """Differences of pairs (slide, src_w, src_h, src, out_w, out_h, out: flat rgb bytes) of any sizes; without an output the slide is missing.

    A pair's pictures never leave its row, and rows are compared one by one.
    """
    schema = f"{slide} long, diff_pct double, worst_region array<int>, worst_pct double, missing boolean"

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                if r["out"] is None:
                    rows.append((r[slide], None, None, None, True))
                else:
                    picture = lambda side, r=r: np.frombuffer(r[side], np.uint8).reshape(int(r[f"{side}_h"]), int(r[f"{side}_w"]), 3)
                    rows.append((r[slide], *compare(picture("src"), picture("out")), False))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            yield out.astype({"diff_pct": float, "worst_pct": float}) if len(out) else out

    return pairs.select(slide, "src_w", "src_h", "src", "out_w", "out_h", "out").mapInPandas(run, schema)
