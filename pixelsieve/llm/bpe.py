"""Byte-level BPE encoding and decoding with a published vocabulary.

Each pre-token is merged with a segment tree over its byte positions: leaf i holds the rank of the
pair that starts at the live token i, every inner node the smallest rank below it, the left one on
ties. A merge takes the leftmost smallest rank from the root and updates the two pairs that
changed, so a pre-token of n bytes takes O(n log n), also where a text is one run of letters.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pixelsieve.llm.common import bounded_batches, tidy

_NONE = 1 << 30
#: Pre-tokens up to so many characters are remembered, and at most twice so many in a worker.
REMEMBER_CHARS, REMEMBER = 48, 300_000


class Codec:
    """Encodes and decodes by the ranks of a .tiktoken file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern).findall
        self.known = _Known(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, longest, rank = len(piece), self.longest, self.ranks.get
        size = 1 << max(1, (n - 1).bit_length())
        after, before = list(range(1, n + 2)), list(range(-1, n))
        tree = [_NONE] * (2 * size)
        tree[size : size + n - 1] = [rank(piece[i : i + 2], _NONE) for i in range(n - 1)]
        for k in range(size - 1, 0, -1):
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left <= right else right

        while (least := tree[1]) != _NONE:
            k = 1
            while k < size:
                k += k
                if tree[k] != least:
                    k += 1
            i = k - size
            gone = after[i]
            end = after[i] = after[gone]
            if end < n:
                before[end] = i
                stop = after[end]
                here = rank(piece[i:stop], _NONE) if stop - i <= longest else _NONE
            else:
                here = _NONE
            changed = [(gone, _NONE), (i, here)]
            if (j := before[i]) >= 0:
                changed.append((j, rank(piece[j:end], _NONE) if end - j <= longest else _NONE))
            for j, value in changed:
                k = size + j
                tree[k] = value
                while k > 1:
                    other = tree[k ^ 1]
                    if other < value:
                        value = other
                    k >>= 1
                    if tree[k] == value:
                        break
                    tree[k] = value
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Known(dict):
    """Packed ids by pre-token, in two generations: when the younger is full it becomes the older,
    which is forgotten but for what is asked again. A worker's memory is bounded."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(self.codec.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= REMEMBER_CHARS:
            if len(self) >= REMEMBER:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes whole texts and decodes the ids again, row by row and without a shuffle.

    Returns the columns ``keep`` (default: all), n_tokens, ids_sha256 and decoded_sha256, with
    ``with_ids`` also ids (array of int). ``path`` must be readable on every executor. Null and
    empty texts have no ids; a text of one very long pre-token takes O(n log n); repeated rows
    are encoded each; an empty table gives no rows; columns of the input that have a result's
    name are left out.
    """
    bounded_batches(docs.sparkSession)
    own = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    taken = docs.select(*keep, docs[text].alias("_text"))
    schema = [taken.schema[c] for c in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for value in batch.column(len(keep)):
                packed = c.encode(value.as_py() or "")
                columns[0].append(len(packed) // 4)
                columns[1].append(hashlib.sha256(packed).hexdigest())
                columns[2].append(hashlib.sha256(c.decode(packed)).hexdigest())
                if with_ids:
                    columns[3].append(np.frombuffer(packed, "<i4"))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
            made = [pa.array(x, k) for x, k in zip(columns[: len(own)], kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, *own])
        c.known.older = {}

    kinds = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "ids": T.ArrayType(T.IntegerType())}
    return taken.mapInArrow(tidy(run), T.StructType([*schema, *(T.StructField(c, kinds[c]) for c in own)]))
