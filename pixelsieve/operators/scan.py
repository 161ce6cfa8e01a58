"""The scan: fingerprint, database match, classification where needed, decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelsieve.functions import codec, distance
from pixelsieve.operators import classify, evaluate, policy, search
from pixelsieve.sources.images import with_fingerprints
from pixelsieve.types import EXACT_MATCH, NO_MATCH, SIMILAR_MATCH, MatchConfig, PolicyConfig

# States of the classifier.
SKIPPED, UNAVAILABLE, AVAILABLE = "skipped", "unavailable", "available"
AFTER_MATCH, NOT_CONFIGURED, NO_CONFIG, NO_CLASSIFIER = "skipped (database match)", "not configured", "configuration invalid", "initialization failed"


def match_status(rows: DataFrame, catalog: DataFrame | None, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Adds match_status, nearest_distance, matched_id and matched_label to rows (query_id, bytes).

    The nearest distance is kept also where it is beyond the threshold, the record only where it
    matches; without a catalog there is no match at distance 0.
    """
    if catalog is None:
        none = F.lit(None).cast("string")
        return rows.select("*", F.lit(NO_MATCH).alias("match_status"), F.lit(0.0).alias("nearest_distance"), none.alias("matched_id"), none.alias("matched_label"))
    near = search.nearest(rows, catalog, config).withColumnRenamed("id", "_id").withColumnRenamed("label", "_label").drop("seq")
    found = rows.join(near, "query_id")
    similar = F.col("_id").isNotNull() & distance.within("distance", config.threshold)
    status = F.when(F.col("exact_match"), EXACT_MATCH).when(similar, SIMILAR_MATCH).otherwise(NO_MATCH)
    found = found.withColumn("match_status", status).withColumnRenamed("distance", "nearest_distance")
    record = F.col("match_status") != NO_MATCH
    return found.withColumn("matched_id", F.when(record, F.col("_id"))).withColumn("matched_label", F.when(record, F.col("_label"))).drop("_id", "_label", "exact_match")


def scan(images: DataFrame, catalog: DataFrame | None = None, classifier: classify.Classifier | None = None, config: MatchConfig = MatchConfig(), rules: PolicyConfig = PolicyConfig(), missing: str = NOT_CONFIGURED) -> DataFrame:
    """Scans images (path, width, height, rgb, ...): one row for each that was decoded.

    Only images without an exact match are classified. ``missing`` is the status where there is
    no classifier: NOT_CONFIGURED, NO_CONFIG or NO_CLASSIFIER.
    """
    rows = with_fingerprints(images.where("rgb IS NOT NULL")).withColumn("query_id", F.col("path"))
    rows = match_status(rows, catalog, config)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("label", "string"), ("confidence", "double"), ("detected", "boolean"))]
    known, rest = rows.where(F.col("match_status") == EXACT_MATCH).select("*", *none), rows.where(F.col("match_status") != EXACT_MATCH)
    rest = rest.select("*", *none) if classifier is None else classify.classify_images(rest, classifier)
    out = known.unionByName(rest)
    exact = F.col("match_status") == EXACT_MATCH
    state, status = (AVAILABLE, AVAILABLE) if classifier else (SKIPPED if missing == NOT_CONFIGURED else UNAVAILABLE, missing)
    out = out.withColumn("classifier_availability", F.when(exact, SKIPPED).otherwise(state)).withColumn("classifier_status", F.when(exact, AFTER_MATCH).otherwise(status))
    return policy.evaluate(out, rules).drop("query_id", "rgb")


def json_string(text: Column) -> Column:
    """A JSON string that escapes only backslash, quote, newline, return and tab."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, escaped in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _object(fields: dict[str, Column]) -> Column:
    return F.concat(F.lit("{"), *[F.concat(F.lit(f'{"," if i else ""}"{k}":'), v) for i, (k, v) in enumerate(fields.items())], F.lit("}"))


def scan_json(scans: DataFrame) -> DataFrame:
    """path, json of scan rows, with six decimals."""
    six = lambda c: F.format_string("%.6f", c)
    fields = {"image": json_string(F.col("path")), "decision": json_string(F.col("decision")), "reason": json_string(F.col("reason")), "match": json_string(F.col("match_status")), "distance": six("nearest_distance"), "classifier_available": (F.col("classifier_availability") == AVAILABLE).cast("string")}
    more = {"classifier_label": json_string(F.col("label")), "classifier_confidence": six("confidence"), "classifier_detected": F.col("detected").cast("string")}
    return scans.select("path", F.when(F.col("label").isNull(), _object(fields)).otherwise(_object(fields | more)).alias("json"))


def hash_json(images: DataFrame, algorithm: str = "fp") -> DataFrame:
    """path, json of fingerprinted images: algorithm, version, sha256_rgb, hex, base64."""
    fields = {"algorithm": json_string(F.lit(algorithm)), "version": F.col("version").cast("string"), "sha256_rgb": json_string(F.col("sha256_hex")), "hex": json_string(codec.encode_hex("bytes")), "base64": json_string(codec.encode_base64("bytes"))}
    return images.select("path", _object(fields).alias("json"))


def evaluate_dataset(samples: DataFrame, scans: DataFrame) -> DataFrame:
    """The report of samples (path, expected) over scans (path, decision); without a scan skipped."""
    both = samples.join(scans.select("path", F.col("decision").alias("predicted")), "path", "left")
    return evaluate.evaluate(both)
