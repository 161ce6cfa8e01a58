"""What the corpus operators share: tables, scratch storage, hashing of texts, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- tables and scratch storage ---------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset on a local master does this make a temporary folder; on a cluster
    an unset folder is an error, because executors would not see each other's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="pixelsieve-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


class Scratch:
    """Tables written once in the shared folder, so that lineage ends there.

    A lost executor only costs the tasks of the running stage. The tables stay until the driver
    ends (lazy results read them), except those that ``drop`` removes earlier.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/pixelsieve-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._remove(self.path(name))

    def _remove(self, path: str) -> None:
        try:
            sc = self.spark.sparkContext
            hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may be gone when the driver ends
            pass


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, so that very long texts don't fill a Python worker."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(name) == default:
        spark.conf.set(name, "8m")


def tidy(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A function of Arrow batches that gives free memory back when its task ends.

    Workers wait for further tasks, more of them than run at a time; what their allocators keep
    would otherwise add up on an executor.
    """

    def tidied(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


# --- texts in Arrow batches -------------------------------------------------------------------

#: Texts are hashed in pieces of about so many bytes, so that memory doesn't follow batch sizes.
CHUNK_BYTES = 1 << 18

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32  # A-Z only

#: Word characters by byte, after lower-casing A-Z.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_OR_HIGH = np.zeros(256, bool)
ALNUM_OR_HIGH[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the rolling base and of its inverse modulo 2**64, longer when needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, CHUNK_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.cumprod(p, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def utf8_chunks(column: pa.Array | pa.ChunkedArray) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) of a string column; nulls are empty texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the rows, in order, and how many words each row has.

    A word is a longest run of bytes of ``is_word`` (looked up after lower-casing A-Z) within
    one row. Equal words have equal hashes; others differ but for chance collisions of 64 bits.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    low = _LOW[raw]
    inside = is_word[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    # a run ends before a byte that is no word byte, or where the next row begins
    stop = np.ones(n + 1, bool)
    stop[:n] = ~inside
    stop[begins] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, "right")]
    up, down = _Powers.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[low] * up[:n], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, offsets))


_ODD = mix64(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words; [] when there are fewer."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += words[i : i + n] * _ODD[i]
    return mix64(out)


def whole_hash(words: np.ndarray) -> np.ndarray:
    """One hash of a whole sequence of words, apart from those of shingles."""
    _, down = _Powers.upto(len(words) + 1)
    total = (words * down[1 : len(words) + 1]).sum(dtype=np.uint64) + np.uint64(len(words))
    return mix64(mix64(np.array([total], np.uint64)) ^ _ODD[63])


def list_array(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


# --- connected components ---------------------------------------------------------------------


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every node on an edge (a, b); component is the smallest node reached.

    Alternates large-star and small-star rounds: each hangs every node below a smaller one, so
    the number of edges never grows and rounds follow the logarithm of the longest path. The
    minimum of a neighbourhood is a partial aggregate, so a node with very many neighbours
    combines on the map side; the join that follows can be split by the engine where skewed.
    Every round is written to the shared folder, which ends its lineage.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = scratch.write(edges, f"{name}-0")
    mark, turn = _fingerprint(edges), 0
    while mark[0]:
        turn += 1
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        new = scratch.write(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        edges, before, mark = new, mark, _fingerprint(new)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    got = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))), F.lit(0))).first()
    return tuple(got)
