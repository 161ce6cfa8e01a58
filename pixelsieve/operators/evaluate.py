"""Evaluation of decisions against expected ones.

The report's ``precision`` and ``recall`` keep the meaning that they have in the system whose
reports these are to match: precision of a class is correct over expected, recall correct over
predicted, support the number predicted, and flagged_recall counts false alarms in its
denominator. The columns ``std_*`` have the usual meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelsieve.types import ALLOW, BLOCK, REVIEW

CLASSES = (ALLOW, REVIEW, BLOCK)


def _cell(expected: str, predicted: str) -> str:
    return f"{expected}_{predicted}".lower()


def confusion(rows: DataFrame) -> DataFrame:
    """One row of nine counts <expected>_<predicted>, and skipped: rows without a prediction."""
    counts = [F.count_if((F.col("expected") == e) & (F.col("predicted") == p)).alias(_cell(e, p)) for e in CLASSES for p in CLASSES]
    return rows.agg(*counts, F.count_if(F.col("predicted").isNull()).alias("skipped"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def _sum(cells: list[str]) -> Column:
    out = F.lit(0).cast("long")
    for c in cells:
        out = out + F.col(c)
    return out


def report(matrix: DataFrame) -> DataFrame:
    """The evaluation report of a confusion row."""
    cells = {(e, p): _cell(e, p) for e in CLASSES for p in CLASSES}
    evaluated = _sum(list(cells.values()))
    out = [evaluated.alias("evaluated"), (evaluated + F.col("skipped")).alias("total"), F.col("skipped")]
    out.append(_ratio(_sum([cells[k, k] for k in CLASSES]), evaluated).alias("accuracy"))
    for k in CLASSES:
        correct, n = F.col(cells[k, k]), k.lower()
        expected, predicted = _sum([cells[k, p] for p in CLASSES]), _sum([cells[e, k] for e in CLASSES])
        precision, recall = _ratio(correct, expected), _ratio(correct, predicted)
        out += [precision.alias(f"{n}_precision"), recall.alias(f"{n}_recall"), _f1(precision, recall).alias(f"{n}_f1"), predicted.alias(f"{n}_support")]
        out += [recall.alias(f"std_{n}_precision"), precision.alias(f"std_{n}_recall"), expected.alias(f"std_{n}_support")]
    flagged = [REVIEW, BLOCK]
    correct = _sum([cells[e, p] for e in flagged for p in flagged])
    predicted = _sum([cells[e, p] for e in CLASSES for p in flagged])
    either = _sum([c for (e, p), c in cells.items() if (e, p) != (ALLOW, ALLOW)])
    precision, recall = _ratio(correct, predicted), _ratio(correct, either)
    out += [precision.alias("flagged_precision"), recall.alias("flagged_recall"), _f1(precision, recall).alias("flagged_f1")]
    out.append(_ratio(correct, _sum([cells[e, p] for e in flagged for p in CLASSES])).alias("std_flagged_recall"))
    return matrix.select(*out)


def evaluate(rows: DataFrame) -> DataFrame:
    """The report of rows (expected, predicted)."""
    return report(confusion(rows))
