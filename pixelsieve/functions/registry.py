"""Registers the engine's functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pixelsieve.functions.kernel import fingerprint_udf


def register(spark: SparkSession, prefix: str = "fp_") -> None:
    """fp_hash(width, height, rgb), fp_l1/fp_l2/fp_l2_squared(a, b), fp_hex(bytes), fp_components(bytes)."""
    spark.udf.register(f"{prefix}hash", fingerprint_udf)
    square = "aggregate(zip_with(a, b, (x, y) -> (CAST(x AS BIGINT) - y) * (CAST(x AS BIGINT) - y)), 0L, (s, x) -> s + x)"
    sql = {
        "l1(a ARRAY<INT>, b ARRAY<INT>) RETURNS BIGINT": "aggregate(zip_with(a, b, (x, y) -> abs(CAST(x AS BIGINT) - y)), 0L, (s, x) -> s + x)",
        "l2_squared(a ARRAY<INT>, b ARRAY<INT>) RETURNS BIGINT": square,
        "l2(a ARRAY<INT>, b ARRAY<INT>) RETURNS DOUBLE": f"sqrt({square})",
        "hex(b BINARY) RETURNS STRING": "concat('fp:v1:', lower(hex(b)))",
        "components(b BINARY) RETURNS ARRAY<INT>": "transform(regexp_extract_all(hex(b), '(..)', 1), h -> CAST(conv(h, 16, 10) AS INT))",
    }
    for head, body in sql.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURN {body}")
