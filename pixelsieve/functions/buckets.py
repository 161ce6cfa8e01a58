"""Locality-sensitive bucket keys of fingerprints.

A fingerprint has 25 keys: band 24 hashes its first 16 components, bands 0-11 hash 12 components
each, and bands 12-23 pack the high nibbles of four components of the same bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS, BAND_COMPONENTS, PREFIX_COMPONENTS, PREFIX_BAND = 12, 12, 16, 24

# The hash's start and factor. Keys keep 16 bits, for which 16 bits of state suffice.
HASH_START, HASH_FACTOR, KEY_MASK = 0x9DC5, 0x193, 0xFFFF


def _hash(array: Column) -> Column:
    return F.aggregate(array, F.lit(HASH_START), lambda h, x: ((h.bitwiseXOR(x.cast("int"))) * HASH_FACTOR).bitwiseAND(KEY_MASK))


def prefix_key(c: Column) -> Column:
    return _hash(F.slice(c, 1, PREFIX_COMPONENTS))


def exact_key(c: Column, band: int) -> Column:
    return _hash(F.slice(c, BAND_COMPONENTS * band + 1, BAND_COMPONENTS))


def _nibbles(c: Column, band: int) -> list[Column]:
    return [F.shiftright(c[BAND_COMPONENTS * band + (5 * g + band) % BAND_COMPONENTS].cast("int"), 4) for g in range(4)]


def nibble_key(c: Column, band: int) -> Column:
    a, b, d, e = _nibbles(c, band)
    return F.shiftleft(a, 12).bitwiseOR(F.shiftleft(b, 8)).bitwiseOR(F.shiftleft(d, 4)).bitwiseOR(e)


def _ref(band: int, key: Column) -> Column:
    return F.struct(F.lit(band).alias("band_index"), key.cast("int").alias("bucket_key"))


def _in_band(keys: Column, band: int) -> Column:
    return F.transform(keys, lambda k: _ref(band, k))


def index_refs(c: Column) -> Column:
    """The 25 (band_index, bucket_key) under which a fingerprint is found."""
    refs = [_ref(PREFIX_BAND, prefix_key(c))]
    for b in range(BANDS):
        refs += [_ref(b, exact_key(c, b)), _ref(BANDS + b, nibble_key(c, b))]
    return F.array(*refs)


def nibble_refs(c: Column) -> Column:
    """Those of the 25 among which similar fingerprints are sought."""
    return F.array(*[_ref(BANDS + b, nibble_key(c, b)) for b in range(BANDS)])


def neighbour_delta(threshold: float) -> int:
    """How far single nibbles are varied, by the threshold whatever the metric."""
    return 1 if threshold <= 15 else 2 if threshold <= 50 else 3


def _varied(key: Column, nibbles: list[Column], delta: int) -> Column:
    """A nibble key and those with one nibble varied."""
    keys = [F.array(key)]
    for g, nibble in enumerate(nibbles):
        for step in [s for s in range(-delta, delta + 1) if s]:
            moved = key + F.shiftleft(F.lit(1), 12 - 4 * g) * step
            keys.append(F.when((nibble + step).between(0, 15), F.array(moved)).otherwise(F.array().cast("array<int>")))
    return F.concat(*keys)


def nearest_probes(c: Column) -> Column:
    """Where the nearest fingerprint is sought, in order: prefix, then whole bands."""
    return F.array(_ref(PREFIX_BAND, prefix_key(c)), *[_ref(b, exact_key(c, b)) for b in range(BANDS)])


def similar_probes(c: Column, threshold: float) -> Column:
    """Where similar fingerprints are sought: nibble keys and those with one nibble varied."""
    delta = neighbour_delta(threshold)
    return F.array_distinct(F.concat(*[_in_band(_varied(nibble_key(c, b), _nibbles(c, b), delta), BANDS + b) for b in range(BANDS)]))


def packed(refs: Column) -> Column:
    """Buckets as whole numbers: the band above the 16 bits of the key."""
    return F.transform(refs, lambda r: F.shiftleft(r["band_index"], 16).bitwiseOR(r["bucket_key"]))


def packed_similar_probes(ref: Column, threshold: float) -> Column:
    """Where ``similar_probes`` seeks by a packed nibble key."""
    return _varied(ref, [F.shiftright(ref, 12 - 4 * g).bitwiseAND(15) for g in range(4)], neighbour_delta(threshold))


def buckets(records: DataFrame) -> DataFrame:
    """The bucket table of fingerprint records (id, seq, components)."""
    return records.select("id", "seq", F.inline(index_refs(F.col("components"))))
