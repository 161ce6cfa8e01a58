"""Near duplicates among embeddings by int8 tiles with rigorous error bounds.

Unit vectors are quantised to int8 with a scale for each. A tile of two blocks is one integer
matrix product; the norms of the quantised vectors and of their errors bound how far it can be
from the true cosine. Only pairs whose upper bound reaches the threshold are computed in double
precision, so the bound decides nothing but the work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelsieve.llm.common import Scratch, components
from pixelsieve.llm.ngram_join import joining

#: Vectors of a block: a tile holds two of them, and its product takes BLOCK**2 floats.
BLOCK = 2048
#: Rows of a tile whose bounds are looked at together.
STRIP = 32
#: Slack for the rounding of the bounds themselves, far above the error of 64-bit sums.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, norms of the quantised vectors, norms of the errors."""
    scale = np.abs(unit).max(axis=1, initial=0) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Row numbers of the pairs with cosine >= threshold, and how many pairs were computed in full."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    (qa, sa, ba, ea), (qb, sb, bb, eb) = quantise(a / na[:, None]), quantise(b / nb[:, None])
    # whole numbers below 2**24 for up to 1,040 dimensions are exact in single precision
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    product = qa.astype(kind) @ qb.astype(kind).T
    x, y, full = [], [], 0
    for at in range(0, len(a), STRIP):  # bounds and pairs in strips: memory stays at a strip of a dense tile
        s = slice(at, at + STRIP)
        upper = product[s] * sa[s, None] * sb + ba[s, None] * eb + ea[s, None] * (bb + eb)
        i, j = np.nonzero(upper >= threshold - SLACK)
        i += at
        exact = np.einsum("ij,ij->i", a[i], b[j]) / (na[i] * nb[j])
        full += len(i)
        x.append(i[exact >= threshold])
        y.append(j[exact >= threshold])
    return np.concatenate(x), np.concatenate(y), full


def class_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, others) of classes (class, n, label, vector): every pair of a label is compared in one tile.

    A tile yields two kinds of rows, as many as it has classes at most: with b null, how many
    vectors of other classes class a links with in it; else, links that join the tile's
    components. Links themselves would be as many as the square of a dense group.
    """
    sizes = classes.groupBy("label", F.size("vector").alias("dim")).agg(F.count("*").alias("k"))
    sizes = sizes.select("label", "dim", F.expr(f"CAST(CEIL(k / {BLOCK}) AS INT)").alias("blocks"))
    placed = classes.withColumn("dim", F.size("vector")).join(sizes, ["label", "dim"])
    placed = placed.withColumn("i", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    placed = placed.withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.select("label", "dim", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "class", "n", "vector")

    def run(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        _, _, lo, hi = key
        mine = (tile["i"] == lo).to_numpy()
        ids, n = tile["class"].to_numpy(), tile["n"].to_numpy()
        other = mine if lo == hi else ~mine
        a, b, others = [], [], []
        if mine.any() and other.any():
            vectors = np.stack(tile["vector"].to_numpy()).astype(np.float64)
            x, y, _ = tile_links(vectors[mine], vectors[other], threshold)
            x, y = np.flatnonzero(mine)[x], np.flatnonzero(other)[y]
            keep = ids[x] != ids[y] if lo != hi else (ids[x] != ids[y]) & (x < y)
            x, y = x[keep], y[keep]
            counts = np.bincount(x, n[y], len(ids)) + np.bincount(y, n[x], len(ids))
            linked = np.flatnonzero(counts)
            forest = joining(np.arange(len(ids)), x, y)
            a = [*ids[linked], *np.minimum(ids[x[forest]], ids[y[forest]])]
            b = [*[None] * len(linked), *np.maximum(ids[x[forest]], ids[y[forest]])]
            others = [*counts[linked].astype(np.int64), *[None] * int(forest.sum())]
        return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "others": pd.array(others, "Int64")})

    return placed.groupBy("label", "dim", "lo", "hi").applyInPandas(run, "a long, b long, others long")


def near_duplicates(rows: DataFrame, scratch: Scratch, threshold: float = 0.93) -> DataFrame:
    """Links of equal label and cosine >= threshold: vec_id, n_links, component_id, kept.

    Equal vectors of a label are one class, compared once and never expanded into pairs. A vector
    that is null, empty, zero or holds a null or a non-finite component, and one with a null label
    or a null vec_id, links with nothing and is its own component. Rows that repeat a vec_id count
    as one vector, with other components as one that links wherever one of them does; vectors of different lengths never link; an empty table gives no
    rows; other columns are ignored.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0)
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("vector"), F.coalesce(sound, F.lit(False)).alias("sound"))
    keyed = plain.withColumn("key", F.when(F.col("sound"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("vector", lambda x: x.cast("string"))), 256)))
    sound_rows = keyed.where("sound")
    classes = sound_rows.groupBy("key").agg(F.min("vec_id").alias("class"), F.count_distinct("vec_id").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = scratch.write(classes, "classes")
    links = scratch.write(class_links(classes, threshold), "links")
    found = components(links.where("b IS NOT NULL").select("a", "b"), scratch, "vector-components")
    weight = links.where("b IS NULL").groupBy("a").agg(F.sum("others").alias("others"))
    facts = classes.select("key", "class", "n").join(weight, F.col("class") == F.col("a"), "left").join(found, F.col("class") == F.col("node"), "left")
    facts = facts.select("key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    facts = scratch.write(facts, "facts")  # so that the join can be split where a class has very many copies
    out = keyed.select("vec_id", "key").join(facts, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
