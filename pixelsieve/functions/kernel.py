"""The perceptual hash: 144 bytes of an image's gradients on a 6 x 6 grid.

A summed-area table gives box means at three radii around the centres of a 12 x 12 grid; central
differences of their weighted sums, split by sign into four channels, are spread onto the 6 x 6
grid, scaled to unit length, clipped, scaled again and quantised. Additions run in a fixed order,
so the bytes are the same on every machine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelsieve.types import COMPONENTS, VERSION

# Fixed values of version 1.
GRID, OUT, CHANNELS = 12, 6, 4
RADII, WEIGHTS = (0.02, 0.05, 0.10), (0.50, 0.30, 0.20)
CLIP, EPSILON = 0.20, 1e-12
LOW_ENERGY = 12.0 * 2.2204460492503131e-16 * 8.0

ZERO = bytes(COMPONENTS)


def _spread() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets, sources (among the inner 10 x 10 cells) and weights of the bilinear spread, in order."""
    inner, step = GRID - 2, (OUT - 1) / (GRID - 1)
    target, source, weight = [], [], []
    for j in range(1, GRID - 1):
        for i in range(1, GRID - 1):
            x, y = i * step, j * step
            x0, y0 = int(np.floor(x)), int(np.floor(y))
            tx, ty = x - x0, y - y0
            taps = ((x0, y0, (1.0 - tx) * (1.0 - ty)), (x0 + 1, y0, tx * (1.0 - ty)), (x0, y0 + 1, (1.0 - tx) * ty), (x0 + 1, y0 + 1, tx * ty))
            for ox, oy, w in taps:
                if 0 <= ox < OUT and 0 <= oy < OUT and w > 0.0:
                    target.append(oy * OUT + ox)
                    source.append((j - 1) * inner + i - 1)
                    weight.append(w)
    return np.array(target), np.array(source), np.array(weight)


_TARGET, _SOURCE, _WEIGHT = _spread()


def _norm(v: np.ndarray) -> float:
    return float(np.sqrt(np.cumsum(v * v)[-1]))  # a running sum, not a pairwise one


def _box_means(table: np.ndarray, cx: np.ndarray, cy: np.ndarray, radius: float) -> np.ndarray:
    """Means of the boxes around all centres, clipped to the image."""
    height, width = table.shape[0] - 1, table.shape[1] - 1
    left, right = (np.clip(cx + s * radius, 0.0, float(width)) for s in (-1, 1))
    top, bottom = (np.clip(cy + s * radius, 0.0, float(height)) for s in (-1, 1))

    def at(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
        tx, ty = (x - x0)[None, :], (y - y0)[:, None]
        xs, ys = (np.clip(v, 0, n) for v, n in ((np.stack([x0, x0 + 1]), width), (np.stack([y0, y0 + 1]), height)))
        corner = lambda i, j: table[np.ix_(ys[j], xs[i])].astype(np.float64)
        upper = corner(0, 0) * (1.0 - tx) + corner(1, 0) * tx
        lower = corner(0, 1) * (1.0 - tx) + corner(1, 1) * tx
        return upper * (1.0 - ty) + lower * ty

    total = at(right, bottom) - at(left, bottom) - at(right, top) + at(left, top)
    area = (right - left)[None, :] * (bottom - top)[:, None]
    return np.where(area > 0.0, total / np.where(area > 0.0, area, 1.0), 0.0)


def fingerprint(rgb: np.ndarray, version: int = VERSION) -> bytes:
    """The 144 bytes of an image (height x width x 3); zeros for empty, uniform or flat ones."""
    if version != VERSION or rgb.size == 0 or (rgb == rgb[0, 0]).all():
        return ZERO
    height, width = rgb.shape[:2]
    table = np.zeros((height + 1, width + 1), np.int64)
    np.cumsum(np.cumsum(rgb.sum(2, dtype=np.int64), 0), 1, out=table[1:, 1:])
    centre = (np.arange(GRID) + 0.5) / GRID
    features = np.zeros((GRID, GRID))
    for r, w in zip(RADII, WEIGHTS, strict=True):
        features += w * _box_means(table, centre * float(width), centre * float(height), r * float(min(width, height)))
    gx = features[1:-1, 2:] - features[1:-1, :-2]
    gy = features[2:, 1:-1] - features[:-2, 1:-1]
    grid = np.zeros((CHANNELS, OUT * OUT))
    for channel, values in enumerate((gx, -gx, gy, -gy)):
        np.add.at(grid[channel], _TARGET, np.maximum(values, 0.0).ravel()[_SOURCE] * _WEIGHT)
    v = grid.ravel()
    norm = _norm(v)
    if norm <= LOW_ENERGY * np.abs(features).max() or norm < EPSILON:
        return ZERO
    v = np.minimum(v / norm, CLIP)
    norm = _norm(v)
    if norm < EPSILON:
        return ZERO
    scaled = np.clip(v / norm / CLIP, 0.0, 1.0) * 255.0
    return np.floor(scaled + 0.5).astype(np.uint8).tobytes()  # halves away from zero


def from_rgb(width: int, height: int, rgb: bytes) -> bytes:
    """The same of raw bytes, of which those beyond width * height * 3 are ignored."""
    if width <= 0 or height <= 0 or len(rgb) < width * height * 3:
        return ZERO
    return fingerprint(np.frombuffer(rgb, np.uint8, width * height * 3).reshape(height, width, 3))


@F.pandas_udf(T.BinaryType())
def fingerprint_udf(width: pd.Series, height: pd.Series, rgb: pd.Series) -> pd.Series:
    """The fingerprint of decoded images (RGB, row by row); null where there is no image."""
    return pd.Series([None if p is None else from_rgb(int(w), int(h), bytes(p)) for w, h, p in zip(width.fillna(0), height.fillna(0), rgb, strict=True)], dtype=object)
