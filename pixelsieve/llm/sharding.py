"""Sharding by jump consistent hashing (native: DataFrame functions only).

A row's shard follows from its key and the number of shards alone, without a ring table. With one
more shard a row stays or moves to the new one, and about one in (shards + 1) moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelsieve.llm.common import Scratch

# Fixed value of the published jump hash: the multiplier of its 64-bit linear congruence.
MULTIPLIER = 2862933555777941757
_A_HIGH, _A_LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_LOW32 = 0xFFFFFFFF

#: Rows that a bin of a shard holds about, and the most bins a shard is cut into for numbering.
ROWS_PER_BIN, MOST_BINS = 500, 4096
#: Equal rows that are numbered together at most.
PIECE = 65_536


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The congruence modulo 2**64 on two 32-bit halves; no product leaves the signed range."""
    low16, high16 = lo.bitwiseAND(0xFFFF), F.shiftright(lo, 16)
    p1 = high16 * F.lit(_A_LOW)
    p0 = low16 * F.lit(_A_LOW) + F.lit(1) + F.shiftleft(p1.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(p0, 32) + F.shiftright(p1, 16)
    hi_lo = hi.bitwiseAND(0xFFFF) * F.lit(_A_LOW) + F.shiftleft((F.shiftright(hi, 16) * F.lit(_A_LOW)).bitwiseAND(0xFFFF), 16)
    new_hi = (hi_lo.bitwiseAND(_LOW32) + (lo * F.lit(_A_HIGH)).bitwiseAND(_LOW32) + carry).bitwiseAND(_LOW32)
    return new_hi, p0.bitwiseAND(_LOW32)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards - 1 of a 64-bit integer key.

    A jump moves forward by one shard at least, so ``shards`` steps always suffice; a step after
    the last jump changes nothing.
    """
    if shards < 1:
        raise ValueError("at least one shard")

    def step(state: Column, _: Column) -> Column:
        hi, lo = _next_state(state["hi"], state["lo"])
        top = F.shiftright(hi, 1) + F.lit(1)
        jump = F.floor((state["j"] + 1).cast("double") * (F.lit(2147483648.0) / top.cast("double"))).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), state["j"].alias("b"), jump.alias("j"))
        return F.when(state["j"] < F.lit(shards), moved).otherwise(state)

    start = F.struct(
        F.shiftrightunsigned(key.cast("long"), 32).alias("hi"),
        key.cast("long").bitwiseAND(_LOW32).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def bin_of(key: Column, bins: Column) -> Column:
    """Which bin numbers a key: the upper half of its first state, modulo the number of bins."""
    hi, _ = _next_state(F.shiftrightunsigned(key.cast("long"), 32), key.cast("long").bitwiseAND(_LOW32))
    return F.pmod(hi, bins).cast("int")


def shard_rows(rows: DataFrame, shards: int, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Puts every row into a shard by its key and numbers the rows of each shard from 0.

    Returns key, size, text_crc32, law, shard, slot, grown_shard. Size is the text's UTF-8 bytes
    plus 1. Rows equal in key, size and text_crc32 are counted before any shuffle, and pieces of
    up to PIECE of them numbered as one. Slots follow (bin, key, size, text_crc32, piece), and bins
    are dealt by all but the size, so neither a key nor a repeated row that very many rows share
    gathers in one bin; the bins of a shard are numbered apart and shifted by a table of at most
    ``shards * MOST_BINS`` counts, so that no task sorts a whole shard. Texts are read once. Null
    texts count as empty, null keys as key 0 (the key stays null in the result), repeated rows get
    a slot each, an empty table gives no rows, other columns are ignored.
    """
    number = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sized = rows.select(F.col(key).alias("_key"), number.alias("_number"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    equal = sized.groupBy("_key", "_number", "size", "text_crc32").agg(F.count("*").alias("_equal"))
    equal = (scratch or Scratch(rows.sparkSession)).write(equal, "equal-rows")

    n = equal.agg(F.coalesce(F.sum("_equal"), F.lit(0))).first()[0]
    bins = F.lit(min(MOST_BINS, 1 + n // ROWS_PER_BIN)).cast("long")
    pieces = equal.select("*", F.explode(F.expr(f"sequence(0L, (_equal - 1) div {PIECE})")).alias("_piece"))
    salted = F.col("_number").bitwiseXOR(F.col("text_crc32")).bitwiseXOR(F.shiftleft("_piece", 32))
    placed = pieces.select(
        "_key", "size", "text_crc32", "_piece",
        F.expr(f"least({PIECE}L, _equal - _piece * {PIECE})").alias("_rows"),
        jump_shard(F.col("_number"), shards).alias("shard"),
        bin_of(salted, bins).alias("_bin"),
        jump_shard(F.col("_number"), shards + 1).alias("grown_shard"),
    )
    counts = placed.groupBy("shard", "_bin").agg(F.sum("_rows").alias("n"))
    # the counts of one shard are at most MOST_BINS numbers
    listed = counts.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("_bin", "n"))).alias("bins"))
    before = F.expr("transform(bins, (x, i) -> struct(x._bin AS _bin, aggregate(slice(bins, 1, i), 0L, (a, y) -> a + y.n) AS first_slot))")
    offsets = listed.select("shard", F.inline(before))

    in_bin = F.expr("sum(_rows) OVER (PARTITION BY shard, _bin ORDER BY _key, size, text_crc32, _piece ROWS UNBOUNDED PRECEDING)")
    out = placed.withColumn("_end", in_bin).join(F.broadcast(offsets), ["shard", "_bin"])
    out = out.withColumn("_first", F.col("first_slot") + F.col("_end") - F.col("_rows"))
    out = out.select("*", F.explode(F.expr("sequence(_first, _first + _rows - 1)")).alias("slot"))
    return out.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
