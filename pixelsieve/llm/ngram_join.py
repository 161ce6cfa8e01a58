"""Word n-gram Jaccard self-join by count vectors in R-trees.

Each text becomes the set of hashes of its word shingles. Sets are hashed into groups; the counts
of the groups are a point, and the summed coordinate minima of two points bound the overlap of
their sets from above. Random counts have no low-dimensional structure, so a single R-tree over
all points prunes next to nothing at its upper levels (README has the figures). They are
therefore cut where the bound is tightest, at groups that must be whole:

* Sets with Jaccard similarity t or more differ in at most D = n (1 - t) / t members, n being the
  smaller size. Of any D + 1 non-empty groups of a partition of the hash space, one is therefore
  equal in both. Each set emits its first D + 1 non-empty groups, by the partition of its size
  class (and, near the upper end of the class, of the next one too); linked sets meet in a tile
  of an equal group. This loses no pair.
* In a tile every set is held against the tile's smallest one first. While the links found so
  far leave a tile in more than one component, an R-tree over its count vectors, descended from the root, yields the
  pairs of different components whose bound reaches the threshold: only so many as would join
  the components that they touch, if all of them link, as long as half of such pairs do link,
  and then all that are left.
* Surviving pairs are verified on their whole shingle sets.

Equal sets are one class all the way; copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelsieve.llm.common import NOT_SPACE, Scratch, bounded_batches, components, list_array, mix64, shingle_hashes, tidy, utf8_chunks, whole_hash, words_of

#: Coordinates of a point, members of a leaf, and members of a block of a tile.
DIMENSIONS, LEAF, BLOCK = 512, 32, 512
#: Children of an inner node, and pairs of nodes whose bounds are looked at together.
FANOUT, NODE_PAIRS = 4, 4096
BOTH_SIDES, OUT_SIDE, ALL_SIDE = 0, 1, 2
#: Share of pairs that must link for another round of only pairs that would join components, and rows that are broadcast.
JOINING_SHARE, BROADCAST_ROWS = 0.5, 500_000
_SHIFT = np.uint64(64 - DIMENSIONS.bit_length() + 1)


def shingle_sets(column: pa.Array, k: int, is_word: np.ndarray = NOT_SPACE) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct k-word shingles."""
    for _, raw, offsets in utf8_chunks(column):
        words, counts = words_of(raw, offsets, is_word)
        at = 0
        for n in counts.tolist():
            own = words[at : at + n]
            at += n
            got = np.sort(shingle_hashes(own, k) if n >= k else whole_hash(own) if n else own)
            yield got[np.r_[True, got[1:] != got[:-1]]] if len(got) > 1 else got


def set_hash(members: np.ndarray) -> int:
    total = mix64(members).sum(dtype=np.uint64) + np.uint64(len(members))
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


def group_signatures(members: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the groups in which a set meets all sets of similarity num / den or more."""
    n = len(members)
    level = n.bit_length() - 1
    most = n * (den - num) // num
    levels = [level] + [level + 1] * (den * n >= num * (2 << level))
    out = []
    for c in levels:
        groups = (2 << c) * (den - num) * 13 // (num * 10) + 4
        group = ((members >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        content = np.add.reduceat(mix64(members), starts)
        group = group[starts]
        if len(starts) > most:
            group, content = group[: most + 1], content[: most + 1]
        else:  # too few groups have members: then the empty ones are compared too
            every = np.zeros(groups, np.uint64)
            every[group] = content
            group, content = np.arange(groups, dtype=np.uint64), every
        out.append(mix64(content + mix64(group + np.uint64((c + 1) << 40))))
    return np.concatenate(out)


def point(members: np.ndarray) -> np.ndarray:
    """Counts of the groups, at most 255 each; with the set's size they bound overlaps."""
    return np.minimum(np.bincount((members >> _SHIFT).astype(np.int64), minlength=DIMENSIONS), 255).astype(np.uint8)


def excess(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Members beyond the counts of each point: as many more may overlap."""
    return sizes - points.sum(1, dtype=np.int64)


def least_overlap(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """The overlap from which sets of sizes a and b have similarity num / den."""
    return -((-num * (a + b)) // (num + den))


def _overlap(a: np.ndarray, b: np.ndarray, more_a: np.ndarray, more_b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(-1, dtype=np.int64) + np.minimum(more_a, more_b)


def leaf_pairs(points: np.ndarray, sizes: np.ndarray, more: np.ndarray, num: int, den: int, seen: list | None = None) -> np.ndarray:
    """Pairs (i, j), i <= j, of leaves of rows in order of size that may hold a pair of rows, by descent from the root.

    A node's corner is the maximum of each coordinate of its rows, so summed minima of two corners bound
    those of every two rows below. ``seen`` gets (pairs looked at, pairs that stay) of each level.
    """
    if len(sizes) <= LEAF:  # the root is the only leaf, as in most tiles
        return np.zeros((1, 2), np.int64)
    levels, width = [], LEAF
    while True:
        starts = np.arange(0, len(sizes), width)
        last = np.minimum(starts + width, len(sizes)) - 1
        levels.append((np.maximum.reduceat(points, starts), np.maximum.reduceat(more, starts), sizes[starts], sizes[last]))
        if len(starts) == 1:
            break
        width *= FANOUT
    pairs = np.zeros((1, 2), np.int64)
    for level, (corner, corner_more, small, large) in enumerate(levels[::-1]):
        if level:  # children of the pairs that stay
            step = np.arange(FANOUT)
            i, j = (np.broadcast_to(x, (len(pairs), FANOUT, FANOUT)).ravel() for x in ((pairs[:, :1] * FANOUT + step)[:, :, None], (pairs[:, 1:] * FANOUT + step)[:, None]))
            pairs = np.stack([i, j], 1)[(i <= j) & (j < len(small))]
        keep = []
        for at in range(0, len(pairs), NODE_PAIRS):
            i, j = pairs[at : at + NODE_PAIRS].T
            ok = small[j] * num <= large[i] * den
            i, j = i[ok], j[ok]
            bound = _overlap(corner[i], corner[j], corner_more[i], corner_more[j])
            ok = bound >= least_overlap(small[i], np.maximum(small[j], small[i]), num, den)
            keep.append(np.stack([i[ok], j[ok]], 1))
        if seen is not None:
            seen.append((len(pairs), sum(map(len, keep))))
        pairs = np.concatenate(keep) if keep else pairs[:0]
    return pairs


def tree_pairs(points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, first: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose summed coordinate minima reach the least overlap.

    Only pairs of different ``parts``, one row being of ``first`` (a mask) and, where the mask
    doesn't hold for all, the other not. Rows are packed into a tree in order of size.
    """
    order = np.lexsort((points[:, 0], sizes))
    points, sizes, parts, first = points[order], sizes[order], parts[order], first[order]
    more = excess(points, sizes)
    split = not first.all()
    for i, j in leaf_pairs(points, sizes, more, num, den).tolist():
        own, others = (np.arange(x * LEAF, min((x + 1) * LEAF, len(order))) for x in (i, j))
        corner, corner_more, small = points[others].max(0), more[others].max(), sizes[others[0]]
        bound = _overlap(points[own], corner, more[own], corner_more)  # rows against leaf
        mine = own[bound >= least_overlap(sizes[own], np.maximum(small, sizes[own] * num // den), num, den)]
        ok = parts[mine][:, None] != parts[others][None]
        ok &= (first[mine][:, None] != first[others][None]) if split else True
        ok &= mine[:, None] < others[None]
        x, y = np.nonzero(ok)
        x, y = mine[x], others[y]
        ok = _overlap(points[x], points[y], more[x], more[y]) >= least_overlap(sizes[x], sizes[y], num, den)
        yield order[x[ok]], order[y[ok]]


def joining(parts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs would join components one after the other, if all of them linked."""
    above: dict[int, int] = {}

    def root(p: int) -> int:
        while (q := above.get(p, p)) != p:
            above[p] = above.get(q, q)
            p = q
        return p

    out = np.zeros(len(x), bool)
    for k, (p, q) in enumerate(zip(parts[x].tolist(), parts[y].tolist(), strict=True)):
        if (p := root(p)) != (q := root(q)):
            above[p] = q
            out[k] = True
    return out


def _prepare(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, node (hash of the set), signatures, point."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, signatures, points = [], [], [], []
            for members in shingle_sets(batch.column(2), k):
                n.append(len(members))
                full = len(members) > 0
                node.append(set_hash(members) if full else None)
                signatures.append(group_signatures(members, num, den).view(np.int64) if full else np.zeros(0, np.int64))
                points.append(point(members).tobytes() if full else None)
            made = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), list_array(signatures, pa.int64()), pa.array(points, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "key", "n_shingles", "node", "signatures", "point"])

    return _texts(docs).mapInArrow(tidy(run), "doc_id long, key long, n_shingles long, node long, signatures array<long>, point binary")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, members) for the wanted (node, doc_id, key), computed from the texts again; ids may be null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = list(shingle_sets(batch.column(1), k))
            node = [set_hash(m) if len(m) else None for m in members]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), list_array([m.view(np.int64) for m in members], pa.int64())], names=["wanted", "node", "members"])

    held, asked = (x.withColumn("id", F.coalesce("doc_id", F.lit(0).cast("long"))).drop("doc_id") for x in (_texts(docs), wanted))
    found = held.join(asked, ["id", "key"]).select(F.col("node").alias("wanted"), "text")
    found = found.mapInArrow(tidy(run), "wanted long, node long, members array<long>").where("wanted = node")
    return found.select("node", "members").dropDuplicates(["node"])  # rows may repeat a document


def _bounded(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose summed coordinate minima reach the least overlap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, q = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, DIMENSIONS) for i in (2, 3))
                m, n = (batch.column(i).to_numpy() for i in (4, 5))
                bound = np.minimum(p, q).sum(1, dtype=np.int64) + np.minimum(excess(p, m), excess(q, n))
                ok = bound >= least_overlap(m, n, num, den)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["a", "b"])

    own = pairs.join(points.select(F.col("node").alias("a"), F.col("point").alias("p"), F.col("n").alias("m")), "a")
    own = own.join(points.select(F.col("node").alias("b"), F.col("point").alias("q"), "n"), "b").select("a", "b", "p", "q", "m", "n")
    return own.mapInArrow(tidy(run), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    own = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    own = own.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y")).cast("long")
    own = own.select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).cast("long").alias("sum"))
    return own.where(F.col("both") * den >= (F.col("sum") - F.col("both")) * num).select("a", "b")


def _tile_pairs(tiles: DataFrame, num: int, den: int, only_joining: int | None) -> DataFrame:
    """(signature, a, b): pairs of different components within tiles (signature, node, part, point, n).

    ``only_joining`` is the number of a round that only takes pairs which would join components; each round
    tries them in another order, so that pairs that didn't link stand back.
    A pair of different components has a set outside the tile's largest one. A tile of more than
    BLOCK sets is therefore cut into blocks of those outside and blocks of all, which meet pair by
    pair: a task holds two blocks at most, and where few sets are outside, the rows stay linear.
    """
    parts = tiles.groupBy("signature", "part").agg(F.count("*").alias("k")).groupBy("signature")
    sizes = parts.agg(F.max_by("part", F.struct("k", "part")).alias("largest"), F.sum("k").alias("k"), F.max("k").alias("inside"))
    blocks = lambda x: F.ceil(x / BLOCK).cast("int")
    sizes = sizes.select("signature", "largest", blocks(F.col("k")).alias("all_blocks"), blocks(F.col("k") - F.col("inside")).alias("out_blocks"))
    cut = tiles.join(sizes, "signature")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.alias("lo"), j.alias("hi"))
    zero = F.lit(0)
    against = F.transform(every("out_blocks"), lambda i: place(ALL_SIDE, i, own("all_blocks")))
    outside = F.when(F.col("part") != F.col("largest"), F.transform(every("all_blocks"), lambda j: place(OUT_SIDE, own("out_blocks"), j)))
    places = F.when(F.col("all_blocks") == 1, F.array(place(BOTH_SIDES, zero, zero))).otherwise(F.concat(against, F.coalesce(outside, F.slice(against, 1, 0))))
    cut = cut.select("signature", F.inline(places), "node", "part", "point", "n").select("signature", "lo", "hi", "side", "node", "part", "point", "n")
    cut = cut.repartition("signature", "lo", "hi").sortWithinPartitions("signature", "lo", "hi")

    def tile(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, part, signature = (rows[c].to_numpy() for c in ("node", "part", "signature"))
        points = np.frombuffer(b"".join(rows["point"].to_pylist()), np.uint8).reshape(-1, DIMENSIONS)
        first = rows["side"].to_numpy() != ALL_SIDE
        found = list(tree_pairs(points, rows["n"].to_numpy(), part, first, num, den))
        x = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        y = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        if only_joining is not None:
            turn = np.argsort(mix64((node[x] ^ node[y]).view(np.uint64) + np.uint64(only_joining)), kind="stable")
            x, y = x[turn], y[turn]
            keep = joining(part, x, y)
            x, y = x[keep], y[keep]
        return np.full(len(x), signature[0]), np.minimum(node[x], node[y]), np.maximum(node[x], node[y])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in tile(rows)], names=["signature", "a", "b"])

        held: list[pa.RecordBatch] = []  # the rows of the last tile seen, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for at, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if held and any(held[-1].column(i)[0] != batch.column(i)[int(at)] for i in range(3)):
                    yield out(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(int(at), int(end - at)))
        if held:
            yield out(pa.Table.from_batches(held))

    return cut.mapInArrow(tidy(run), "signature long, a long, b long")


def jaccard_components(docs: DataFrame, scratch: Scratch, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key, group_key: groups of documents linked by den * both >= num * union.

    component_id is the smallest doc_id that links reach; text_key is the hash of the text, and group_key
    tells groups apart where ids are null or repeat (null without shingles). Words are split at ASCII white space
    after lower-casing A-Z; texts of fewer than k words are one shingle; null and empty texts
    have no shingles and link with nothing. Rows that repeat a doc_id are rows of their own;
    a row with a null doc_id takes part in links and gets its group's id, if it has one; an
    empty table gives no rows; other columns are ignored. Sets are compared by 64-bit hashes.
    """
    bounded_batches(docs.sparkSession)
    rows = scratch.write(_prepare(docs, k, num, den), "rows")
    full = rows.where("node IS NOT NULL")

    # tiles: equal groups of at least two different sets. Joins of written tables, so that the engine can split large tiles
    classes = scratch.write(full.groupBy("node").agg(F.first("signatures").alias("signatures")), "classes")
    exploded = classes.select("node", F.explode(F.array_distinct("signatures")).alias("signature"))
    shared = scratch.write(exploded.groupBy("signature").agg(F.count("*").alias("k")).where("k > 1").select("signature"), "shared")
    tiles = scratch.write(exploded.join(shared, "signature").select("signature", "node"), "tiles")
    centres = scratch.write(tiles.groupBy("signature").agg(F.min("node").alias("centre")), "centres")

    met = tiles.select("node").distinct()
    points = full.join(met, "node", "left_semi").groupBy("node").agg(F.first("point").alias("point"), F.coalesce(F.min_by("key", "doc_id"), F.min("key")).alias("key"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    points = scratch.write(points, "points")

    star = tiles.join(centres, "signature").where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    star = scratch.write(_bounded(star, points, num, den), "star")
    links = scratch.write(_verify(star, docs, points, scratch, "star", k, num, den), "star-links")
    found, tested = scratch.write(components(links, scratch, "star-components"), "star-found"), star
    turn, last = 0, JOINING_SHARE > 1
    while True:
        # tiles that the links so far leave in several components
        split = tiles.select("signature", "node").join(found, "node", "left").select("signature", "node", F.coalesce("component", "node").alias("part"))
        open_tiles = split.groupBy("signature").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("signature")
        tiles = scratch.write(split.join(open_tiles, "signature"), f"tiles-{turn}")
        if not tiles.limit(1).count():
            break
        close = _tile_pairs(tiles.join(points.select("node", "point", "n"), "node"), num, den, None if last else turn)
        close = scratch.write(close, f"close-{turn}")
        rest = scratch.write(close.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), f"rest-{turn}")
        tested = tested.unionByName(rest)
        more = scratch.write(_verify(rest, docs, points, scratch, f"rest-{turn}", k, num, den), f"links-{turn}")
        links = links.unionByName(more)
        n_rest, n_more = rest.count(), more.count()
        if n_more:
            found = scratch.write(components(links, scratch, f"components-{turn}"), f"found-{turn}")
        if last:
            break
        # a tile without a pair now has none later: components only merge
        tiles = tiles.join(close.select("signature").distinct(), "signature", "left_semi").select("signature", "node")
        turn, last = turn + 1, n_more <= JOINING_SHARE * n_rest

    # the smallest doc_id of each component, for every document
    classes = full.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(found, "node", "left")
    whole = classes.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("whole"))
    group = F.coalesce("component", "node").alias("group_key")
    named = classes.join(whole, "component", "left").where("n > 1 OR whole IS NOT NULL").select("node", F.coalesce("whole", "least").alias("component_id"), group)
    named = scratch.write(named, "named")  # so that the join can be split where a class has very many copies
    out = rows.select("doc_id", "key", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("key").alias("text_key"), F.coalesce("group_key", "node").alias("group_key"))


def keep_first(docs: DataFrame, scratch: Scratch, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents but one of each group of near duplicates, with all their columns.

    Of a group stays the row with the smallest doc_id, then the smallest hash of the text; rows without
    an id stand last. Of rows equal in doc_id (or both without one) and text one stays. Documents without
    words are in no group; an empty table gives no rows.
    """
    found = scratch.write(jaccard_components(docs, scratch, k, num, den), "found")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    groups = found.where("group_key IS NOT NULL").groupBy("group_key").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    groups = scratch.write(groups.where("first <> last").select("group_key", "first"), "groups")
    gone = found.select("group_key", row.alias("row")).join(groups, "group_key").where("row <> first").select("row.doc_id", "row.text_key").distinct()
    again = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_key")
    gone, again = scratch.write(gone, "gone"), scratch.write(again, "again")

    def same(other: DataFrame) -> Column:
        return docs["doc_id"].cast("long").eqNullSafe(other["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == other["text_key"])

    rest = docs.join(gone, same(gone), "left_anti")
    if not again.limit(1).count():
        return rest
    key = "_" * (1 + max(map(len, docs.columns)))  # no column has this name
    once = rest.join(again, same(again), "left_semi").withColumn(key, F.xxhash64(docs["text"].cast("string"))).dropDuplicates(["doc_id", key]).drop(key)
    return rest.join(again, same(again), "left_anti").unionByName(once)


def _verify(pairs: DataFrame, docs: DataFrame, points: DataFrame, scratch: Scratch, name: str, k: int, num: int, den: int) -> DataFrame:
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = scratch.write(points.join(nodes, "node").select("node", "doc_id", "key"), f"{name}-wanted")
    if wanted.count() <= BROADCAST_ROWS:  # else the texts are shuffled
        wanted = F.broadcast(wanted)
    sets = scratch.write(_sets_of(docs, wanted, k), f"{name}-sets")
    return _verified(pairs, sets, num, den)
