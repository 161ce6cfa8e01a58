"""Distances and normalisation of fingerprints as column expressions.

Components are arrays of 144 whole numbers from 0 to 255. Sums run from the first component to the
last, so doubles are the same on every engine that does so too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelsieve.types import COMPONENTS, MatchConfig

#: Up to this sum of squares a vector keeps its length: the smallest step above 1 of a double.
EPSILON = 2.220446049250313e-16


def components(binary: str | Column) -> Column:
    """The components of 144 bytes."""
    pairs = F.regexp_extract_all(F.hex(binary), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))


def from_components(array: str | Column) -> Column:
    """144 bytes of components."""
    return F.unhex(F.array_join(F.transform(array, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))


def _sum(array: Column, zero: Column) -> Column:
    return F.aggregate(array, zero, lambda a, x: a + x)


def l1(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("long") - y.cast("long"))), F.lit(0).cast("long"))


def l2_squared(a: str | Column, b: str | Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("long") - y.cast("long")
        return d * d

    return _sum(F.zip_with(a, b, square), F.lit(0).cast("long"))


def l2(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(l2_squared(a, b).cast("double"))


def normalized(a: str | Column) -> Column:
    """Components divided by 255, then scaled to unit length unless they are all but zero."""
    unit = F.transform(a, lambda x: x.cast("double") / F.lit(255.0))
    # bound once by a one-element array, so that the sum isn't taken again for each component
    scaled = F.transform(F.array(F.struct(unit.alias("v"), _sum(F.transform(unit, lambda x: x * x), F.lit(0.0)).alias("s"))), lambda t: F.when(t["s"] <= EPSILON, t["v"]).otherwise(F.transform(t["v"], lambda x: x * (F.lit(1.0) / F.sqrt(t["s"])))))
    return F.element_at(scaled, 1)


def normalized_l2(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(_sum(F.zip_with(normalized(a), normalized(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0)))


def compare(a: str | Column, b: str | Column, metric: str) -> Column:
    """Distance by a metric as a double; only components count."""
    return {"l1": l1, "l2": l2, "l2_squared": l2_squared}[metric](a, b).cast("double")


def configured(a: str | Column, b: str | Column, config: MatchConfig) -> Column:
    return normalized_l2(a, b) if config.use_normalized else compare(a, b, config.metric)


def within(distance: str | Column, threshold: float) -> Column:
    """Whether a distance matches: the threshold is inclusive and must be above zero."""
    distance = F.col(distance) if isinstance(distance, str) else distance
    return F.lit(threshold > 0) & (distance <= F.lit(float(threshold)))


def is_zero(a: str | Column) -> Column:
    return ~F.exists(a, lambda x: x != 0)


# --- blocks of fingerprints in NumPy, for bulk work ---------------------------------------------


def stack(binaries: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(binaries), np.uint8).reshape(-1, COMPONENTS)


def normalized_block(a: np.ndarray) -> np.ndarray:
    v = a.astype(np.float64) / 255.0
    s = np.cumsum(v * v, axis=1)[:, -1:]
    small = s <= EPSILON
    return np.where(small, v, v * (1.0 / np.sqrt(np.where(small, 1.0, s))))


def paired(a: np.ndarray, b: np.ndarray, config: MatchConfig) -> np.ndarray:
    """Distance of each row of ``a`` to the same row of ``b``, as the column expressions give it."""
    if config.use_normalized:
        d = normalized_block(a) - normalized_block(b)
        return np.sqrt(np.cumsum(d * d, axis=1)[:, -1]) if len(d) else np.zeros(0)
    d = a.astype(np.int64) - b
    if config.metric == "l1":
        return np.abs(d).sum(1).astype(np.float64)
    square = (d * d).sum(1).astype(np.float64)
    return np.sqrt(square) if config.metric == "l2" else square


def crossed(a: np.ndarray, b: np.ndarray, config: MatchConfig) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b``."""
    if config.use_normalized:
        x, y = normalized_block(a), normalized_block(b)
        out = np.zeros((len(a), len(b)))
        for k in range(COMPONENTS):  # one component after the other, as a running sum
            d = x[:, k, None] - y[None, :, k]
            out += d * d
        return np.sqrt(out)
    if config.metric == "l1":
        out = np.zeros((len(a), len(b)), np.int64)
        for k in range(COMPONENTS):
            out += np.abs(a[:, k, None].astype(np.int64) - b[None, :, k])
        return out.astype(np.float64)
    x, y = a.astype(np.float64), b.astype(np.float64)  # whole numbers far below 2**53: exact
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2.0 * (x @ y.T)
    return np.sqrt(square) if config.metric == "l2" else square


def distance_udf(config: MatchConfig):
    """Distance of two BINARY columns, a batch at a time."""

    @F.pandas_udf(T.DoubleType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(paired(stack(a), stack(b), config))

    return distance
