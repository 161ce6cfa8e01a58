"""Nearest and similar fingerprint search for batches of queries.

Queries have query_id, bytes and components (algorithm and version where they are kept); a catalog
has id, seq, algorithm, version, bytes, components, label. seq is the order of insertion and
settles ties. Exact matches are equal in algorithm, version and bytes; distances compare bytes.

Searches read an index: the different fingerprints and their bucket table. A store keeps both; for any
other catalog they are built, and written, when the search begins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelsieve.functions import buckets, distance
from pixelsieve.sources.shared import held
from pixelsieve.types import MatchConfig

#: Fingerprints of a block of queries and of a block of the catalog in a full scan.
QUERY_BLOCK, CATALOG_BLOCK = 1_024, 8_192
IDENTITY = ["algorithm", "version", "bytes"]


def with_identity(rows: DataFrame) -> DataFrame:
    """Adds what a table of fingerprints may leave out: algorithm, version and bytes."""
    if "bytes" not in rows.columns:
        rows = rows.withColumn("bytes", distance.from_components("components"))
    if "components" not in rows.columns:
        rows = rows.withColumn("components", distance.components("bytes"))
    for c in ("algorithm", "version"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(1))
    return rows


def distinct_fingerprints(catalog: DataFrame) -> DataFrame:
    """One row for each fingerprint: that inserted first. Copies would fill the same buckets."""
    first = catalog.groupBy(*IDENTITY).agg(F.min(F.struct("seq", "id", "label")).alias("r"), F.first("components").alias("components"))
    return first.select("r.seq", "r.id", "r.label", *IDENTITY, "components")


@dataclass(frozen=True)
class Index:
    """What searches read: all labelled records, the different fingerprints among them, their buckets."""

    records: DataFrame
    firsts: DataFrame
    buckets: DataFrame | None = None


def build_index(catalog: DataFrame, with_buckets: bool = True) -> Index:
    """An index of a catalog, in written tables."""
    records = with_identity(catalog).where("label <> ''")
    firsts = held(distinct_fingerprints(records))
    return Index(records, firsts.drop("components"), held(buckets.buckets(firsts)) if with_buckets else None)


def exact_matches(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, id, seq, label: the record inserted first among those equal to the query.

    Queries equal to each other ask once, and the catalog is aggregated only where it is asked for.
    """
    asked = queries.select(*IDENTITY).distinct()
    firsts = catalog.select("id", "seq", "label", *IDENTITY).join(asked, IDENTITY, "left_semi").groupBy(*IDENTITY).agg(F.min(F.struct("seq", "id", "label")).alias("r"))
    return queries.join(firsts, IDENTITY).select("query_id", "r.id", "r.seq", "r.label")


# --- candidates ---------------------------------------------------------------------------------


def _candidates(queries: DataFrame, index: DataFrame, probes) -> DataFrame:
    """query_id, id, seq, probe: records that share a bucket, with the first probe that finds them."""
    asked = queries.select("query_id", F.posexplode(probes)).select("query_id", F.col("pos").alias("probe"), "col.band_index", "col.bucket_key")
    return asked.join(index, ["band_index", "bucket_key"]).groupBy("query_id", "id", "seq").agg(F.min("probe").alias("probe"))


def _by_buckets(rows: DataFrame, ids: list[str], refs) -> DataFrame:
    """ids, times, refs: all buckets of the rows of each id, packed and in order, and how many rows these are."""
    sets = rows.select(*ids, buckets.packed(refs).alias("refs")).groupBy(*ids).agg(F.count("*").alias("times"), F.collect_set("refs").alias("refs"))
    return sets.withColumn("refs", F.array_sort(F.array_distinct(F.flatten("refs"))))


def candidate_counts(queries: DataFrame, catalog: DataFrame, config: MatchConfig, mode: str) -> DataFrame:
    """query_id, candidates: how many records the buckets yield; all records where nearest finds none.

    Records of the same buckets are found together and counted before the join, and queries of the same
    buckets ask once: the join grows with the different ones only. A record (id, seq) counts once, however many
    of its buckets are hit; a query_id has one row, in which its records count for each of its repetitions.
    """
    c = F.col("components")
    refs = buckets.nearest_probes(c) if mode == "nearest" else buckets.nibble_refs(c)
    asked, records = _by_buckets(queries, ["query_id"], refs), _by_buckets(catalog, ["id", "seq"], refs).groupBy("refs").agg(F.count("*").alias("n"))
    probes = asked.select("refs").distinct().select(F.col("refs").alias("asks"), F.explode("refs").alias("ref"))
    if mode != "nearest":
        probes = probes.select("asks", F.explode(buckets.packed_similar_probes(F.col("ref"), config.threshold)).alias("ref"))
    found = probes.join(records.select("refs", "n", F.explode("refs").alias("ref")), "ref").select("asks", "refs", "n").distinct()
    found = found.groupBy(F.col("asks").alias("refs")).agg(F.sum("n").alias("n"))
    counts = asked.join(found, "refs", "left").select("query_id", F.coalesce(F.col("n") * F.col("times"), F.lit(0)).alias("n"))
    if mode == "nearest":
        counts = counts.withColumn("n", F.when(F.col("n") == 0, F.lit(catalog.count())).otherwise(F.col("n")))
    return counts.select("query_id", F.col("n").cast("long").alias("candidates"))


def _measured(pairs: DataFrame, queries: DataFrame, catalog: DataFrame, config: MatchConfig) -> DataFrame:
    """Adds the distance and label to (query_id, id, seq, probe)."""
    pairs = pairs.join(queries.select("query_id", F.col("bytes").alias("q")), "query_id")
    pairs = pairs.join(catalog.select("id", "seq", "label", F.col("bytes").alias("c")), ["id", "seq"])
    return pairs.select("query_id", "id", "seq", "label", "probe", distance.distance_udf(config)("q", "c").alias("distance"))


# --- full scans, in blocks ------------------------------------------------------------------------


def _blocks(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of both sides, dealt so that each block of queries meets each block of the catalog once."""
    nq, nc = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (catalog, CATALOG_BLOCK)))
    q = queries.select(F.lit(True).alias("asks"), F.col("query_id"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("label"), "bytes", F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("i"))
    q = q.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    null = F.lit(None).cast(queries.schema["query_id"].dataType)
    c = catalog.select(F.lit(False).alias("asks"), null.alias("query_id"), "id", "seq", "label", "bytes", F.pmod(F.xxhash64("id", "seq"), F.lit(nc)).alias("j"))
    c = c.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    return q.select(*q.columns).unionByName(c).withColumn("i", F.col("i").cast("long")).withColumn("j", F.col("j").cast("long"))


def _scan(queries: DataFrame, catalog: DataFrame, config: MatchConfig, pick) -> DataFrame:
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        q, c = rows[rows["asks"]], rows[~rows["asks"]].sort_values(["seq", "id"])
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": q["query_id"].iloc[:0], "id": c["id"].iloc[:0], "seq": c["seq"].iloc[:0], "label": c["label"].iloc[:0], "distance": np.zeros(0)})
        d = distance.crossed(distance.stack(q["bytes"]), distance.stack(c["bytes"]), config)
        x, y = pick(d)
        found = c.iloc[y]
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[x], "id": found["id"].to_numpy(), "seq": found["seq"].to_numpy(), "label": found["label"].to_numpy(), "distance": d[x, y]})

    return _blocks(queries, catalog).groupBy("i", "j").applyInPandas(run, f"query_id {kind}, id string, seq long, label string, distance double")


def scan_nearest(queries: DataFrame, catalog: DataFrame, config: MatchConfig) -> DataFrame:
    """The nearest record of each query by distance, then order of insertion."""
    best = _scan(queries, catalog, config, lambda d: (np.arange(len(d)), d.argmin(1)))
    return best.groupBy("query_id").agg(F.min(F.struct("distance", "seq", "id", "label")).alias("b")).select("query_id", "b.id", "b.seq", "b.label", "b.distance")


def scan_similar(queries: DataFrame, catalog: DataFrame, config: MatchConfig) -> DataFrame:
    return _scan(queries, catalog, config, lambda d: np.nonzero(d <= config.threshold if config.threshold > 0 else np.zeros_like(d, bool)))


# --- results -----------------------------------------------------------------------------------------


def _nearest_result(queries: DataFrame, exact: DataFrame, near: DataFrame) -> DataFrame:
    found = exact.select("query_id", F.lit(True).alias("exact_match"), F.lit(0.0).alias("distance"), "id", "label", "seq")
    found = found.unionByName(near.select("query_id", F.lit(False).alias("exact_match"), "distance", "id", "label", "seq"))
    out = queries.select("query_id").join(found, "query_id", "left")
    return out.select("query_id", F.coalesce("exact_match", F.lit(False)).alias("exact_match"), F.coalesce("distance", F.lit(0.0)).alias("distance"), "id", "label", "seq")


def nearest(queries: DataFrame, catalog: DataFrame | Index, config: MatchConfig = MatchConfig(), index: str = "lsh") -> DataFrame:
    """query_id, exact_match, distance, id, label, seq: the nearest record of each query.

    An exact match wins at distance 0. ``lsh`` looks among the records that share a bucket, and
    among all only where there are none; then ties go to the earlier probe, then the earlier
    record. ``brute`` looks among all. Over an empty catalog the distance is 0 and the record null.
    """
    queries, index_of = with_identity(queries), catalog if isinstance(catalog, Index) else build_index(catalog, index != "brute")
    exact = exact_matches(queries, index_of.firsts)
    rest = queries.join(exact, "query_id", "left_anti")
    if index == "brute":
        return _nearest_result(queries, exact, scan_nearest(held(rest.select("query_id", *IDENTITY)), index_of.firsts, config))
    pairs = _measured(_candidates(rest, index_of.buckets, buckets.nearest_probes(F.col("components"))), rest, index_of.firsts, config)
    near = pairs.groupBy("query_id").agg(F.min(F.struct("distance", "probe", "seq", "id", "label")).alias("b")).select("query_id", "b.id", "b.seq", "b.label", "b.distance")
    # a row for each query: which are missed decides whether and how all are scanned
    near = held(rest.select("query_id", *IDENTITY).join(near, "query_id", "left"))
    found, missed = near.where("distance IS NOT NULL").drop(*IDENTITY), near.where("distance IS NULL").select("query_id", *IDENTITY)
    if missed.limit(1).count():
        found = found.unionByName(scan_nearest(missed, index_of.firsts, config))
    return _nearest_result(queries, exact, found)


def similar(queries: DataFrame, catalog: DataFrame | Index, config: MatchConfig = MatchConfig(), limit: int = 0, index: str = "lsh", fallback: str = "never") -> DataFrame:
    """query_id, rank, id, label, seq, distance: records within the threshold, without exact matches.

    Sorted by distance, then order of insertion, and cut to the effective limit. With
    ``fallback="always"`` a query without any candidate is held against all records, as a
    persistent store does.
    """
    queries, index_of = with_identity(queries), catalog if isinstance(catalog, Index) else build_index(catalog, index != "brute")
    unique, catalog = index_of.firsts, index_of.records
    if index == "brute":
        found = scan_similar(queries, unique, config)
    else:
        candidates = _candidates(queries, index_of.buckets, buckets.similar_probes(F.col("components"), config.threshold))
        if fallback == "always":
            candidates = held(candidates)
        found = _measured(candidates, queries, unique, config).where(distance.within("distance", config.threshold)).drop("probe")
        if fallback == "always":
            missed = held(queries.join(candidates, "query_id", "left_anti").select("query_id", *IDENTITY))
            if missed.limit(1).count():
                found = found.unionByName(scan_similar(missed, unique, config))
    # from fingerprints to all their records, without those equal to the query
    found = found.select("query_id", F.col("seq").alias("first_seq"), F.col("id").alias("first_id"), "distance")
    found = found.join(unique.select(F.col("seq").alias("first_seq"), F.col("id").alias("first_id"), *IDENTITY), ["first_seq", "first_id"])
    equal = queries.select("query_id", *IDENTITY)
    found = found.join(equal, ["query_id", *IDENTITY], "left_anti").join(catalog.select("id", "label", "seq", *IDENTITY), IDENTITY)
    ranked = found.select("query_id", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY distance, seq, id)").alias("rank"), "id", "label", "seq", "distance")
    most = config.effective_limit(limit)
    return ranked.where(F.col("rank") <= most) if most else ranked


def near_duplicate_pairs(catalog: DataFrame, config: MatchConfig) -> DataFrame:
    """(a, b, distance): distinct fingerprints of a catalog within the threshold, by their first seq."""
    firsts = held(distinct_fingerprints(with_identity(catalog).where("label <> ''")))
    as_queries = firsts.withColumnRenamed("seq", "query_id").select("query_id", *IDENTITY, "components")
    pairs = similar(as_queries, Index(firsts, firsts.drop("components"), held(buckets.buckets(firsts))), config)
    return pairs.where("query_id < seq").select(F.col("query_id").alias("a"), F.col("seq").alias("b"), "distance")
