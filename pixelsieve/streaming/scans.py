"""Streaming scans and enrolment over folders in which files arrive (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.operators import policy
from pixelsieve.sources.store import FingerprintStore
from pixelsieve.types import EXACT_MATCH, NO_MATCH, PolicyConfig


def fingerprint_stream(spark: SparkSession, path: str, schema: str = "id string, bytes binary, label string, created_at timestamp") -> DataFrame:
    """Fingerprints from Parquet files that arrive under a path."""
    return spark.readStream.schema(schema).parquet(path)


def scan_stream(stream: DataFrame, catalog: DataFrame, rules: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Exact matching of a stream of fingerprints (id, bytes) with a static catalog: stateless."""
    known = catalog.groupBy("bytes").agg(F.min(F.struct("seq", "id", "label")).alias("r")).select("bytes", F.col("r.id").alias("matched_id"), F.col("r.label").alias("matched_label"))
    joined = stream.join(known, "bytes", "left")
    status = F.when(F.col("matched_id").isNotNull(), EXACT_MATCH).otherwise(NO_MATCH)
    joined = joined.withColumn("match_status", status).withColumn("detected", F.lit(False)).withColumn("confidence", F.lit(0.0))
    return policy.evaluate(joined, rules).drop("detected", "confidence")


def enroll_stream(stream: DataFrame, store: FingerprintStore, checkpoint: str):
    """Enrols what arrives, batch by batch; ids that are taken stay out, so a replay adds nothing."""

    def enroll(batch: DataFrame, _: int) -> None:
        store.enroll(batch)

    return stream.writeStream.foreachBatch(enroll).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decision_counts(scans: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Decisions by event-time window, with a watermark."""
    return scans.withWatermark(ts, late).groupBy(F.window(ts, window), "decision").agg(F.count("*").alias("n"))


