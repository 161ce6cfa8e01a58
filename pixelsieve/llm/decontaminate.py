"""Benchmark decontamination by size-partitioned MinHash containment (native: DataFrame functions).

An item counts as contained in a document when at least a share t of its word shingles stands
there. A shingle is k consecutive words; an item of fewer words is one shingle of its own length, so
it is found wherever its words stand together. Items are partitioned by that length and by their
number of shingles n. At most m = n - ceil(t n) shingles may be missing, so one at least of the
m + 1 smallest hashes of the item, its MinHash sketch, is in every document that contains it. Each
partition thus has sketches as long as its sizes ask for and loses nothing; a document's side of
the sketch is its hashes up to the partition's largest sketch value, and documents with fewer
shingles than a partition needs are passed by. Candidates are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelsieve.llm.common import Scratch

#: Largest number of sketch entries of a benchmark that is broadcast; beyond, the join is shuffled.
BROADCAST_ENTRIES = 20_000


def words(text: Column) -> Column:
    """Lower-case words: runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _once(expression: Column) -> Column:
    """A generator of one row. The optimiser moves no expression across it, so the words of a
    text are split once and not again for every place that reads them."""
    return F.explode(F.array(expression))


def _shingles(k: int, of: str) -> str:
    """SQL of all k consecutive words of the array column ``w``, each by ``of``; none where there are fewer."""
    args = ", ".join(f"w[i + {j}]" for j in range(k))
    kind = "bigint" if of.startswith("xxhash64") else "string"
    return f"CASE WHEN size(w) >= {k} THEN transform(sequence(0, size(w) - {k}), i -> {of.format(args=args)}) ELSE CAST(array() AS array<{kind}>) END"


def hashes(k: int) -> Column:
    return F.expr(_shingles(k, "xxhash64({args})"))


def strings(k: int) -> Column:
    return F.expr(_shingles(k, "concat_ws(' ', {args})"))


def _by_length(lengths: list[int], make) -> Column:
    """``make`` of the shingle length in column ``k``."""
    out = F.when(F.col("k") == lengths[0], make(lengths[0]))
    for n in lengths[1:]:
        out = out.when(F.col("k") == n, make(n))
    return out


def sketches(items: DataFrame, k: int, percent: int) -> DataFrame:
    """item_id, k (words of a shingle), shingles, size, least (shingles needed), part, sketch of each item.

    ``part`` is the size partition: sizes of equal bit length.
    """
    own = items.select("item_id", _once(words(F.col("text"))).alias("w"))
    own = own.select("item_id", "w", F.least(F.lit(k), F.size("w")).alias("k")).where("k > 0")
    lengths = list(range(1, k + 1))
    own = own.select("item_id", "k", F.array_sort(F.array_distinct(_by_length(lengths, strings))).alias("shingles"), F.array_sort(F.array_distinct(_by_length(lengths, hashes))).alias("h"))
    own = own.dropDuplicates(["item_id", "k", "shingles"])
    least = F.expr(f"CAST((size(shingles) * {percent} + 99) DIV 100 AS INT)")
    own = own.select("item_id", "k", "shingles", "h", F.size("shingles").alias("size"), least.alias("least"), F.expr("CAST(floor(log2(size(shingles))) AS INT)").alias("part"))
    return own.withColumn("sketch", F.slice("h", 1, F.col("size") - F.col("least") + 1))


def contained_items(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) of every contained item.

    Words are lower-case runs of letters, marks and digits; an item of fewer than k words is one
    shingle of all its words. Items and documents without words, null texts and empty tables give no
    rows. Null ids stay null; rows that repeat a document or an item give a pair once, with its
    largest containment; other columns are ignored.
    """
    entries = scratch.write(sketches(items, k, percent), "sketches").withColumn("item_key", F.xxhash64("item_id", "k", "shingles"))
    probes = entries.select("item_key", "k", F.col("least").alias("need"), F.explode("sketch").alias("h"))
    bounds = entries.groupBy("k", "part").agg(F.max(F.element_at("sketch", -1)).alias("top"), F.min("least").alias("least")).orderBy("k", "part").collect()
    if not bounds:  # a row for each length of shingles and each bit length of sizes
        return docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("item_shingles"), F.lit(0).alias("shared"), F.lit(0.0).alias("containment"))
    lengths = sorted({b["k"] for b in bounds})
    few = probes.count() <= BROADCAST_ENTRIES

    key = F.xxhash64("text").alias("text_key")
    rows = docs.select("doc_id", key, _once(words(F.col("text"))).alias("w")).where(F.size("w") >= lengths[0])

    def side_of(n: int) -> Column:
        """A document's sketch for shingles of n words: those of its hashes that a partition's sketches reach and its size allows."""
        if few:  # look the hashes up where they are made
            values = sorted({r[0] for r in probes.where(F.col("k") == n).select("h").distinct().collect()})
            found = F.filter(hashes(n), lambda h: h.isin(values))
        else:
            tops = [F.when(F.size("w") >= b["least"] + n - 1, F.lit(b["top"])) for b in bounds if b["k"] == n]
            top = F.greatest(F.lit(-(1 << 63)), *tops)
            found = F.filter(hashes(n), lambda h: h <= top)
        return F.transform(F.array_distinct(found), lambda h: F.struct(F.lit(n).alias("k"), h.alias("h")))

    # words stay behind: what goes on is a text's key and a hash
    exploded = rows.select("doc_id", "text_key", F.size("w").alias("n_words"), F.inline(F.concat(*map(side_of, lengths))))
    side = F.broadcast(probes) if few else probes
    candidates = exploded.join(side, ["k", "h"]).where("n_words - k + 1 >= need").select("doc_id", "text_key", "item_key").distinct()
    known = entries.select("item_id", "item_key", "k", "shingles", "size")
    candidates = scratch.write(candidates.join(F.broadcast(known) if few else known, "item_key").drop("item_key"), "candidates")
    # the words of candidates' texts again
    wanted = candidates.select("doc_id", "text_key").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ENTRIES else wanted
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), "text")
    texts = texts.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")), "left_semi")
    texts = texts.select("_id", "_key", _once(words(F.col("text"))).alias("w"))
    pairs = texts.join(candidates, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")))
    shared = F.size(F.array_intersect("shingles", _by_length(lengths, strings)))
    pairs = pairs.select("doc_id", "item_id", F.col("size").alias("item_shingles"), shared.alias("shared"))
    pairs = pairs.where(F.col("shared") * 100 >= F.col("item_shingles") * percent)
    pairs = pairs.withColumn("containment", F.col("shared") / F.col("item_shingles"))
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "item_shingles", "shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.item_shingles", "b.shared", "b.containment")


def clean_documents(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that contain no item; rows with a null doc_id stay."""
    leaks = contained_items(docs, items, scratch, k, percent).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti")
