"""Image scans: encoded files to RGB rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelsieve.functions.kernel import fingerprint_udf
from pixelsieve.types import DecodeLimits


@F.pandas_udf(T.BinaryType())
def _to_rgb(channels: pd.Series, data: pd.Series) -> pd.Series:
    """RGB bytes of the image source's BGR, BGRA or gray ones; alpha is dropped."""
    out = []
    for n, raw in zip(channels, data, strict=True):
        if raw is None or n not in (1, 3, 4):
            out.append(None)
            continue
        pixels = np.frombuffer(bytes(raw), np.uint8).reshape(-1, int(n))
        rgb = np.repeat(pixels, 3, 1) if n == 1 else pixels[:, 2::-1]
        out.append(np.ascontiguousarray(rgb[:, :3]).tobytes())
    return pd.Series(out, dtype=object)


def within_limits(size: Column, width: Column, height: Column, limits: DecodeLimits) -> Column:
    """Whether an image may be decoded: encoded size, width, height and pixels."""
    fits = size.between(1, limits.max_encoded_bytes) & width.between(1, limits.max_width) & height.between(1, limits.max_height)
    return fits & (width.cast("long") * height.cast("long") <= limits.max_decoded_pixels)


def read_images(spark: SparkSession, path: str | list[str], limits: DecodeLimits = DecodeLimits()) -> DataFrame:
    """path, width, height, rgb, sha256_hex of each file; all but the path null where it can't be decoded."""
    found = spark.read.format("image").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), "image.*")
    decoded = (F.col("nChannels") > 0) & within_limits(F.col("size"), F.col("width"), F.col("height"), limits)
    keep = lambda c: F.when(F.coalesce(decoded, F.lit(False)), F.col(c))
    rows = found.select("path", keep("width").alias("width"), keep("height").alias("height"), keep("nChannels").alias("n"), keep("data").alias("data"))
    rows = rows.select("path", "width", "height", _to_rgb("n", "data").alias("rgb"))
    return rows.withColumn("sha256_hex", rgb_sha256("rgb"))


def rgb_sha256(rgb: str) -> Column:
    return F.sha2(F.col(rgb), 256)


def with_fingerprints(images: DataFrame) -> DataFrame:
    """Adds algorithm, version and bytes to images; bytes is null where there is no image."""
    return images.withColumn("algorithm", F.lit(1)).withColumn("version", F.lit(1)).withColumn("bytes", fingerprint_udf("width", "height", "rgb"))


def pixel(rgb: np.ndarray, x: int, y: int) -> tuple[int, int, int]:
    """Red, green and blue of a pixel (height x width x 3)."""
    return tuple(int(v) for v in rgb[y, x])
