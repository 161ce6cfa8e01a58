"""A store of labelled fingerprints in Parquet: records and the bucket table derived from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.functions import buckets
from pixelsieve.functions.distance import components
from pixelsieve.operators import search
from pixelsieve.sources.shared import held
from pixelsieve.types import BUCKETS, FINGERPRINTS, MatchConfig


#: Bucket entries of a fingerprint.
ENTRIES = 2 * buckets.BANDS + 1


class FingerprintStore:
    """Records under ``path/fingerprints``, bucket entries under ``path/buckets``, which searches join.

    Only the record inserted first of equal fingerprints has entries (25), so copies of one image don't fill
    its buckets. Enrolment appends; the entries are derived once for each append, and ``rebuild``
    derives all anew. One writer at a time. A table is replaced by renaming; where that was broken off, the next
    opening takes the old table back.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name in ("fingerprints", "buckets"):  # left by a replacement that was broken off between its renames
            here, old = self._hadoop(f"{self.path}/{name}"), self._hadoop(f"{self.path}/_old-{name}")
            if not self._fs(self.path).exists(here) and self._fs(self.path).exists(old):
                self._fs(self.path).rename(old, here)
        for name, schema in (("fingerprints", FINGERPRINTS), ("buckets", BUCKETS)):
            if not self._fs(f"{self.path}/{name}").exists(self._hadoop(f"{self.path}/{name}")):
                spark.createDataFrame([], schema).write.parquet(f"{self.path}/{name}")

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._hadoop(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def records(self) -> DataFrame:
        return self.spark.read.schema(FINGERPRINTS).parquet(f"{self.path}/fingerprints")

    def catalog(self) -> DataFrame:
        return self.records().withColumn("components", components("bytes"))

    def buckets(self) -> DataFrame:
        return self.spark.read.schema(BUCKETS).parquet(f"{self.path}/buckets")

    def index(self) -> search.Index:
        """The stored tables as searches read them."""
        records = search.with_identity(self.records())
        firsts = self.buckets().where(F.col("band_index") == buckets.PREFIX_BAND).select("id")  # one entry for each
        return search.Index(records, records.drop("components").join(firsts, "id", "left_semi"), self.buckets())

    def enroll(self, rows: DataFrame) -> int:
        """Appends rows (id or null, bytes, label, created_at if given); returns how many went in.

        Rows with an empty or null label or without 144 bytes, and those whose id is taken, stay
        out; of rows that share an id the first by (label, bytes) goes in. A null id becomes the
        hexadecimal ordinal of the row. Times are cut to whole seconds.
        """
        size, last = self.records().agg(F.count("*"), F.coalesce(F.max("seq"), F.lit(0))).first()
        created = F.col("created_at") if "created_at" in rows.columns else F.current_timestamp()
        rows = rows.where("label <> '' AND octet_length(bytes) = 144").select("id", "bytes", "label", F.date_trunc("second", created).alias("created_at"))
        # ordinals by rank within hash partitions and offsets of the partitions: no global sort
        parts = max(1, -(-rows.count() // 100_000))
        # dealt by time too, and rows that are equal in all by chance: which of them gets which number makes no difference
        rows = held(rows.withColumn("_salt", F.rand(1)))
        keyed = rows.withColumn("_p", F.pmod(F.xxhash64("id", "bytes", "label", F.when(F.col("id").isNull(), F.col("_salt"))), F.lit(parts)))
        counts = keyed.groupBy("_p").agg(F.count("*").alias("_k"))  # a row for each 100,000
        before = counts.select("_p", F.expr("coalesce(sum(_k) OVER (ORDER BY _p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_before"))
        ranked = keyed.withColumn("_rank", F.expr("row_number() OVER (PARTITION BY _p ORDER BY id, label, bytes)"))
        numbered = ranked.join(before, "_p").withColumn("seq", F.col("_rank") + F.col("_before") + F.lit(last))
        numbered = numbered.withColumn("id", F.coalesce("id", F.lower(F.hex(F.col("seq")))))
        first = numbered.groupBy("id").agg(F.min(F.struct("seq", "bytes", "label", "created_at")).alias("r")).select("id", "r.*")
        fresh = first.join(self.records().select("id"), "id", "left_anti")
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        fresh.select("id", "seq", F.lit(1).cast("tinyint").alias("algorithm"), F.lit(1).alias("version"), "bytes", "label", "created_at").write.parquet(staged)
        new = self.spark.read.schema(FINGERPRINTS).parquet(staged)
        new.write.mode("append").parquet(f"{self.path}/fingerprints")
        known = self.records().where(F.col("seq") <= last).select(*search.IDENTITY)
        firsts = search.distinct_fingerprints(search.with_identity(new)).join(known, search.IDENTITY, "left_anti")
        buckets.buckets(firsts).write.mode("append").parquet(f"{self.path}/buckets")
        self._fs(staged).delete(self._hadoop(staged), True)
        return self.records().count() - size

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The records of the given ids."""
        return self.records().join(ids.select("id").distinct(), "id", "left_semi")

    def find_exact(self, queries: DataFrame) -> DataFrame:
        return search.exact_matches(search.with_identity(queries), self.index().firsts)

    def find_nearest(self, queries: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
        return search.nearest(queries, self.index(), config)

    def find_similar(self, queries: DataFrame, config: MatchConfig = MatchConfig(), limit: int = 0) -> DataFrame:
        """As a persistent store: a query without candidates is held against all records."""
        return search.similar(queries, self.index(), config, limit, fallback="always")

    def size(self) -> int:
        return self.records().count()

    def stats(self) -> DataFrame:
        """One row: fingerprint_count, bucket_count, file_size_bytes. Copies count as their first record's entries."""
        size = self._fs(self.path).getContentSummary(self._hadoop(self.path)).getLength()
        n = self.records().count()
        row = (n, ENTRIES * n, int(size))
        return self.spark.createDataFrame([row], "fingerprint_count long, bucket_count long, file_size_bytes long")

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Writes beside the old table, then renames."""
        new, old = f"{self.path}/_new-{name}", f"{self.path}/_old-{name}"
        rows.write.mode("overwrite").parquet(new)
        fs = self._fs(self.path)
        fs.rename(self._hadoop(f"{self.path}/{name}"), self._hadoop(old))
        fs.rename(self._hadoop(new), self._hadoop(f"{self.path}/{name}"))
        fs.delete(self._hadoop(old), True)

    def rebuild(self) -> None:
        """Derives the bucket table anew from the records."""
        self._replace("buckets", buckets.buckets(search.distinct_fingerprints(self.catalog())))

    def vacuum(self) -> None:
        """Rewrites both tables into few files, so that small appends don't pile up."""
        for name, table in (("fingerprints", self.records()), ("buckets", self.buckets())):
            size = self._fs(self.path).getContentSummary(self._hadoop(f"{self.path}/{name}")).getLength()
            self._replace(name, table.repartition(max(1, int(size // (128 << 20)))))


def open_store(spark: SparkSession, path: str) -> FingerprintStore | None:
    """The store at a path, made where there is none; None where that fails."""
    try:
        return FingerprintStore(spark, path)
    except Exception:  # noqa: BLE001
        return None
