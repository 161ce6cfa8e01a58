"""Tables written once in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset on a local master a temporary folder is made."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="pixelsieve-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if the session still can."""
    try:
        sc = spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may be gone when the driver ends
        pass


def held(rows: DataFrame) -> DataFrame:
    """The rows, written and read again: what follows doesn't compute them anew. Removed when the driver ends."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/pixelsieve-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
