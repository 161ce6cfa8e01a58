"""A Bloom filter over fingerprints as a table of 32-bit words, to turn away exact lookups early.

Results never depend on it: what it turns away has no exact match. Spark injects filters of its own
into joins where that pays; this one serves lookups in a store whose records lie elsewhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 32


def size(n: int, rate: float = 0.01) -> tuple[int, int]:
    """Bits and hashes for n fingerprints and a rate of false positives; no bits for none."""
    if n <= 0:
        return 0, 0
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / n * math.log(2)))


def positions(bits: int, hashes: int) -> Column:
    """The bits of a fingerprint (algorithm, version, bytes)."""
    return F.array(*[F.pmod(F.xxhash64("algorithm", "version", "bytes", F.lit(k)), F.lit(bits)) for k in range(hashes)])


def build(records: DataFrame, bits: int, hashes: int) -> DataFrame:
    """word, mask: the words that have bits, combined on the map side."""
    p = records.select(F.explode(positions(bits, hashes)).alias("p"))
    words = p.select((F.col("p") / WORD).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % WORD).cast("int")).alias("mask"))
    return words.groupBy("word").agg(F.bit_or("mask").alias("mask"))


def might_contain(queries: DataFrame, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The queries (query_id, algorithm, version, bytes) that the filter doesn't turn away."""
    if not bits:
        return queries.limit(0)
    p = queries.select("query_id", F.explode(positions(bits, hashes)).alias("p"))
    p = p.select("query_id", (F.col("p") / WORD).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % WORD).cast("int")).alias("bit"))
    hit = F.coalesce(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    passed = p.join(filter_, "word", "left").groupBy("query_id").agg(F.bool_and(hit).alias("all")).where("all")
    return queries.join(passed.select("query_id"), "query_id", "left_semi")
