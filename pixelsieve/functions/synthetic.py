"""Synthetic fingerprints and images by rule."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelsieve.types import COMPONENTS


def synthetic_components(seed: Column, multiplier: int = 17, shifted: bool = True) -> Column:
    """Component i is seed + multiplier * i (+ seed >> 4 where ``shifted``), modulo 256."""
    seed = seed.cast("long")
    base = seed + F.shiftright(seed, 4) if shifted else seed
    return F.transform(F.sequence(F.lit(0), F.lit(COMPONENTS - 1)), lambda i: F.pmod(base + i * multiplier, F.lit(256)).cast("int"))


def gradient(width: int, height: int) -> np.ndarray:
    x, y = np.arange(width)[None, :], np.arange(height)[:, None]
    r = np.broadcast_to(x * 255 // max(1, width - 1), (height, width))
    g = np.broadcast_to(y * 255 // max(1, height - 1), (height, width))
    return np.stack([r, g, (x + y) * 255 // max(1, width + height - 2)], 2).astype(np.uint8)


def checkerboard(width: int, height: int, cell: int = 8) -> np.ndarray:
    x, y = np.arange(width)[None, :] // cell, np.arange(height)[:, None] // cell
    return np.repeat(np.where((x + y) % 2 == 0, 32, 224)[:, :, None], 3, 2).astype(np.uint8)


def uniform(width: int, height: int, rgb: tuple[int, int, int]) -> np.ndarray:
    return np.broadcast_to(np.array(rgb, np.uint8), (height, width, 3)).copy()
