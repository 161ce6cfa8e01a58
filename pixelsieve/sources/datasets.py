"""Labelled datasets: manifests and label folders as rows (path, expected)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.operators.policy import parse_decision

FOLDERS = ("allow", "review", "block")


def trim(x: str | Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def parse_manifest(lines: DataFrame, root: str, order: str = "line_no") -> DataFrame:
    """path, expected of manifest lines (line_no, value): the first line of each path counts.

    A line is a path and a label with a comma between; blank lines, comments (#), lines without a
    comma, without a path or with an unknown label are passed by.
    """
    line = trim("value")
    rows = lines.withColumn("value", line).where(~F.col("value").startswith("#") & F.contains("value", F.lit(",")))
    comma = F.instr("value", ",")
    rows = rows.select(order, trim(F.substr("value", F.lit(1), comma - 1)).alias("p"), parse_decision(trim(F.substr("value", comma + 1))).alias("expected"))
    rows = rows.where((F.col("p") != "") & F.col("expected").isNotNull())
    rows = rows.withColumn("path", F.when(F.col("p").startswith("/"), F.col("p")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "p")))
    return rows.groupBy("path").agg(F.min_by("expected", order).alias("expected"))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def load_dataset(spark: SparkSession, root: str) -> DataFrame:
    """path, expected, sorted by path: from manifest.csv, else manifest.tsv, else label folders.

    A manifest that exists is the only source, also when it is empty; both kinds separate by comma.
    """
    root = root.rstrip("/")
    for name in ("manifest.csv", "manifest.tsv"):
        if _exists(spark, f"{root}/{name}"):
            lines = spark.read.text(f"{root}/{name}").withColumn("line_no", F.monotonically_increasing_id())
            return parse_manifest(lines, root).orderBy("path")
    folders = [f"{root}/{f}" for f in FOLDERS if _exists(spark, f"{root}/{f}")]
    if not folders:
        return spark.createDataFrame([], "path string, expected string")
    files = spark.read.format("binaryFile").load([f"{f}/*" for f in folders]).select("path")
    return files.select("path", parse_decision(F.element_at(F.split("path", "/"), -2)).alias("expected")).orderBy("path")


def local(path: str | Column) -> Column:
    """A path without the scheme of local files."""
    return F.regexp_replace(path, r"^file:/+", "/")


def sample_files(spark: SparkSession, samples: DataFrame) -> list[str]:
    """Paths to read of the samples' files that exist, wherever they are; the folders they lie in are listed."""
    plain = lambda path: re.sub(r"([*?\[\]{}\\])", r"\\\1", path)
    folders = [r["folder"] for r in samples.select(F.regexp_extract("path", r"^(.*/)[^/]*$", 1).alias("folder")).distinct().collect()]
    folders = [plain(f) for f in folders if f and _exists(spark, f)]
    if not folders:
        return []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders).select("path")
    asked = samples.select(local("path").alias("p")).distinct()
    found = files.withColumn("p", local("path")).join(asked, "p", "left_semi").select("path").distinct()
    return [plain(r["path"]) for r in found.collect()]
