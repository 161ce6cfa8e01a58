"""Moderation policy: from match status and classification to a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelsieve.types import ALLOW, BLOCK, EXACT_MATCH, REVIEW, SIMILAR_MATCH, PolicyConfig

# Texts of reasons, and exit codes of decisions.
NONE, KNOWN_HASH, SIMILAR_HASH, MODEL = "none", "exact fingerprint match", "similar fingerprint match", "classifier score"
INVALID_INPUT, PROCESSING_ERROR = "invalid input", "processing error"
EXIT_CODES, EXIT_ERROR = {ALLOW: 0, REVIEW: 1, BLOCK: 2}, 10


def severity(decision: Column) -> Column:
    return F.when(decision == BLOCK, 3).when(decision == REVIEW, 2).otherwise(1)


def _outcome(decision: Column | str, reason: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(decision).alias("decision"), lit(reason).alias("reason"))


def from_match(match_status: Column, config: PolicyConfig) -> Column:
    known = F.when(match_status == EXACT_MATCH, _outcome(config.exact_match, KNOWN_HASH))
    return known.when(match_status == SIMILAR_MATCH, _outcome(config.similar_match, SIMILAR_HASH)).otherwise(_outcome(ALLOW, NONE))


def from_classifier(detected: Column, confidence: Column, config: PolicyConfig) -> Column:
    detected = F.coalesce(detected, F.lit(False))
    blocked = F.when(detected & (confidence >= config.block_threshold), _outcome(BLOCK, MODEL))
    return blocked.when(detected & (confidence >= config.review_threshold), _outcome(REVIEW, MODEL)).otherwise(_outcome(ALLOW, NONE))


def merge(left: Column, right: Column) -> Column:
    """The more severe outcome; of equal ones the right one if it has a reason."""
    a, b = severity(left["decision"]), severity(right["decision"])
    return F.when((b > a) | ((b == a) & (right["reason"] != NONE)), right).otherwise(left)


def evaluate(rows: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Adds decision, reason and exit_code to rows with match_status, detected and confidence."""
    default = _outcome(config.default, NONE)
    both = merge(merge(default, from_match(F.col("match_status"), config)), from_classifier(F.col("detected"), F.col("confidence"), config))
    out = rows.withColumn("_outcome", both)
    out = out.withColumn("decision", F.col("_outcome.decision")).withColumn("reason", F.col("_outcome.reason")).drop("_outcome")
    return out.withColumn("exit_code", exit_code(F.col("decision")))


def exit_code(decision: Column) -> Column:
    code = F.lit(EXIT_ERROR)
    for name, value in EXIT_CODES.items():
        code = F.when(decision == name, value).otherwise(code)
    return code


def parse_decision(label: Column) -> Column:
    """The decision that a label names, in any case; null for others."""
    low = F.lower(label)
    named = F.when(low.isin("allow", "safe"), ALLOW).when(low.isin("review", "flag", "flagged"), REVIEW)
    return named.when(low.isin("block", "blocked", "bad"), BLOCK)
