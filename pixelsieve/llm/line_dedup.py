"""Line deduplication by pairwise alignment.

The unit of comparison is the passage: a shortest run of consecutive lines with ``block_words`` words
(a line with so many words is one by itself). Every passage that several documents hold makes a
pair of each later holder and the first one, so a passage held by very many documents makes no more
pairs a document than a rare one, and pairs grow with the text. A pair is aligned by patience
diff on the passages that are unique in both; passages that stand in another order or are
repeated are aligned as blocks of their own. As a passage stands for consecutive lines in both
documents, aligned ones are common blocks, and neighbouring ones merge. All blocks go from the later
document. What goes is therefore just what aligning a document with every earlier one would
find: each block of consecutive lines, with words enough, that some earlier document holds too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelsieve.llm.common import Scratch, bounded_batches, tidy

#: A block of consecutive aligned lines goes when it has so many words.
BLOCK_WORDS = 8
#: Up to so many ids of documents that lose lines are broadcast, so that only their texts are shuffled.
BROADCAST_IDS = 1_000_000


def line_hash(line: str) -> int:
    """Signed 64-bit hash of a line without the white space around it."""
    return _signed(line.strip().encode("utf-8", "surrogatepass"))


def _signed(data: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(data)
    return value - (1 << 64) if value >= 1 << 63 else value


def passages(text: str, block_words: int = BLOCK_WORDS) -> list[tuple[int, int, list[int]]]:
    """(hash, place, line numbers) of a text's passages, in order; places count lines that aren't blank.

    For each line the shortest run that begins with it and the shortest that ends with it: all
    runs of so many words are unions of these.
    """
    numbers, hashes, ends = [], [], [0]
    for number, line in enumerate(text.split("\n")):
        if words := len(line.split()):
            numbers.append(number)
            hashes.append(line_hash(line))
            ends.append(ends[-1] + words)
    spans, last = [], None
    raw = np.array(hashes, np.int64).tobytes()
    begin = 0
    for end in range(1, len(numbers) + 1):  # the shortest run up to each end, and those from begins it passes by
        if ends[end] - ends[begin] < block_words:
            continue
        while ends[end] - ends[begin + 1] >= block_words:
            if last is None or begin > last:
                spans.append((begin, end))  # the first end that is far enough
                last = begin
            begin += 1
        spans.append((begin, end))
        last = begin
    return [(hashes[a] if b == a + 1 else _signed(raw[8 * a : 8 * b]), a, numbers[a:b]) for a, b in spans]


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs with increasing first members, a longest run whose second members increase too."""
    tails, rows, back = [], [], [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        back[i] = rows[at - 1] if at else -1
        if at == len(tails):
            tails.append(y)
            rows.append(i)
        else:
            tails[at], rows[at] = y, i
    out, i = [], rows[-1] if rows else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(later: list[tuple[int, int]], earlier: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Aligned (place in later, place in earlier) of two lists of (place, hash).

    Hashes that stand once in both lists of a range anchor it; the ranges between anchors are
    aligned in turn. Where nothing is unique, equal ones at the range's ends are matched.
    """
    out, todo = [], [(0, len(later), 0, len(earlier))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and later[a][1] == earlier[c][1]:
            out.append((later[a][0], earlier[c][0]))
            a, c = a + 1, c + 1
        while a < b and c < d and later[b - 1][1] == earlier[d - 1][1]:
            b, d = b - 1, d - 1
            out.append((later[b][0], earlier[d][0]))
        if a >= b or c >= d:
            continue
        ours, theirs = Counter(h for _, h in later[a:b]), Counter(h for _, h in earlier[c:d])
        place = {earlier[j][1]: j for j in range(c, d) if theirs[earlier[j][1]] == 1}
        anchors = longest_increasing([(i, place[later[i][1]]) for i in range(a, b) if ours[later[i][1]] == 1 and later[i][1] in place])
        if not anchors:
            continue
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            todo.append((i + 1, k, j + 1, m))
        out += [(later[i][0], earlier[j][0]) for i, j in anchors]
    return sorted(out)


def aligned_blocks(matches: list[dict]) -> list[dict]:
    """The blocks that a document shares with its partners, by place.

    ``matches``: the document's passages with an earlier first holder: first (its id), there (place
    in it; -1 - place where it repeats there), hash, at (places and line numbers here). A block:
    first, place, there, lines, moved (whether it stands out of the order of both documents).
    """
    by = defaultdict(list)
    for m in matches:
        by[m["first"]].append(m)
    blocks = []
    for first, own in by.items():
        once = lambda m: m["there"] >= 0 and len(m["at"]) == 1
        later = sorted((m["at"][0]["n"], m["hash"]) for m in own if once(m))
        earlier = sorted((m["there"], m["hash"]) for m in own if once(m))
        in_order = {here for here, _ in patience(later, earlier)}
        places = []
        for m in own:
            there = m["there"] if m["there"] >= 0 else -1 - m["there"]
            places += [(p["n"], there, not (once(m) and p["n"] in in_order), p["lines"]) for p in m["at"]]
        block: dict | None = None
        for n, there, moved, lines in sorted(places, key=lambda p: (p[1] - p[0], p[2], p[0], p[3])):
            if block and moved == block["moved"] and there - n == block["there"] - block["place"] and n <= block["place"] + len(block["lines"]):
                block["lines"] += [x for x in lines if x > block["lines"][-1]]
            else:
                block = {"first": first, "place": n, "there": there, "moved": moved, "lines": list(lines)}
                blocks.append(block)
    return sorted(blocks, key=lambda b: (b["place"], b["first"], b["there"]))


_AT_ARROW = pa.list_(pa.struct([("n", pa.int32()), ("lines", pa.list_(pa.int32()))]))
_PASSAGES = "array<struct<hash:long,at:array<struct<n:int,lines:array<int>>>>>"


def _passages(docs: DataFrame, block_words: int) -> DataFrame:
    """doc_id, key, hash, at: one row for each different passage of a document (doc_id, key, text)."""
    schema = pa.list_(pa.struct([("hash", pa.int64()), ("at", _AT_ARROW)]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2):
                found: dict[int, list] = {}
                for h, n, lines in passages(text.as_py() or "", block_words):
                    found.setdefault(h, []).append({"n": n, "lines": lines})
                rows.append([{"hash": h, "at": at} for h, at in found.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, schema)], names=["doc_id", "key", "passages"])

    made = docs.mapInArrow(tidy(run), f"doc_id long, key long, passages {_PASSAGES}")
    return made.select("doc_id", "key", F.inline("passages"))


_BLOCK = pa.struct([("first", pa.int64()), ("place", pa.int32()), ("there", pa.int32()), ("lines", pa.list_(pa.int32())), ("moved", pa.bool_())])
_BLOCKS = "array<struct<first:long,place:int,there:int,lines:array<int>,moved:boolean>>"


def shared_blocks(docs: DataFrame, scratch: Scratch, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, key (hash of the text), blocks, removed: of each document that an earlier one shares blocks with.

    ``removed`` are the numbers of the lines in its blocks. Passages and their first holders are
    written tables: the texts are split into lines once, and the join of the two is one whose large
    partitions the engine can split where a passage is very common. With a match travels one place
    of the first holder, however often the passage stands there.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    own = scratch.write(_passages(texts, block_words), "passages")
    place = F.when(F.size("at") > 1, -1 - F.col("at")[0]["n"]).otherwise(F.col("at")[0]["n"])
    held = own.select("hash", "doc_id", place.alias("place")).groupBy("hash")
    first = held.agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min_by("place", "doc_id").alias("there"))
    first = scratch.write(first.where("first < last").select("hash", "first", "there"), "first")
    match = F.struct("first", "there", "hash", "at")
    # all passages of one document: bounded by that document, as rows that repeat it add nothing to a set
    matches = own.join(first, "hash").where("doc_id > first").groupBy("doc_id", "key").agg(F.collect_set(match).alias("matches"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [aligned_blocks(m.as_py()) for m in batch.column(2)]
            removed = [sorted({x for b in found for x in b["lines"]}) for found in blocks]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blocks, pa.list_(_BLOCK)), pa.array(removed, pa.list_(pa.int32()))], names=["doc_id", "key", "blocks", "removed"])

    return matches.mapInArrow(tidy(run), f"doc_id long, key long, blocks {_BLOCKS}, removed array<int>")


def dedup_lines(docs: DataFrame, scratch: Scratch, block_words: int = BLOCK_WORDS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """Deletes from each document the blocks that earlier ones hold; adds n_lines, n_removed, or ``counts``.

    Earlier is the smaller doc_id. Lines are compared without the white space around them; blank lines
    never go and don't end a block; a block goes when it has ``block_words`` words, so an exact copy of
    as many words keeps only its blank lines. What a document itself repeats stays. Rows with a null
    doc_id or text stay as they are (a null text has no lines); rows of one doc_id, whether of the same
    text or of others, are not compared with each other; an empty table gives no rows; all other
    columns stay, but for columns named as ``counts``, which are replaced.
    """
    own = [c for c in docs.columns if c not in counts]
    gone = scratch.write(shared_blocks(docs, scratch, block_words).select(F.col("doc_id").alias("id"), "key", "removed"), "removed")
    # the row as one column: no other name of it meets those used here
    rows = docs.select(F.struct(*own).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    ids = gone.select("id").distinct()
    if ids.count() <= BROADCAST_IDS:  # only the texts of documents that lose lines are shuffled
        ids = F.broadcast(ids)
        rest = rows.join(ids, "id", "left_anti").select("row", F.lit(None).cast("array<int>").alias("removed"))
        # by merging at every size: with line numbers of many documents a broadcast would be large
        joined = rows.join(ids, "id", "left_semi").join(gone.hint("merge"), ["id", "key"], "left").select("row", "removed").unionByName(rest)
    else:
        joined = rows.join(gone, ["id", "key"], "left").select("row", "removed")
    text, removed = F.col("row.text"), F.col("removed")
    joined = joined.withColumn("lines", F.when(removed.isNotNull(), F.split(text, "\n", -1)))
    # the numbers of the lines that stay, without a search for each line
    kept = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), removed), i -> lines[i]), '\\n')")
    n_lines = F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    columns = [F.when(removed.isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in own]
    n_removed = F.when(removed.isNull(), 0).otherwise(F.size(removed))
    return joined.select(*columns, n_lines.cast("long").alias(counts[0]), n_removed.cast("long").alias(counts[1]))
