"""WARC archives of Zstandard frames that share an embedded dictionary.

An archive file starts with a skippable frame that holds the dictionary; every record follows as a
frame of its own, so that a reader can start at any record. Between pieces of
some records stands an empty skippable frame: it is the row separator with which Spark's text writer puts archive files into any
file system that Spark can write, under its commit protocol, so a lost executor leaves no half file.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelsieve.llm.common import Scratch, bounded_batches, tidy

# Fixed values of the formats: magic numbers of the dictionary's frame and of the empty frame,
# and the profile of a record whose payload is stored elsewhere.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: The dictionary is trained on at most so many records of at most so many characters each.
SAMPLE_RECORDS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 65_536, 65_536
#: A file holds FILE_PIECES pieces. A piece is a row of Spark's writer: it ends with its share of FILE_RECORDS, or
#: with the record that brings it to its share of FILE_BYTES, so a file has FILE_BYTES and a record for each piece at most.
FILE_RECORDS, FILE_BYTES, FILE_PIECES, LEVEL = 2_000, 64 << 20, 8, 6
#: Rows that a reader gives back together.
READ_ROWS = 2_000
WARC_DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(pages: DataFrame, html: str = "html", page_id: str = "page_id") -> bytes:
    """A dictionary from a bounded sample; b"" where there are no payloads.

    The sample takes the records that come first by a hash of the id, so it is the same on each
    run. A threshold on the hash lets about twice as many through, so that tasks send few rows.
    """
    usable = pages.where(F.length(html).between(1, SAMPLE_CHARS)).select(F.pmod(F.xxhash64(page_id), F.lit(1 << 31)).alias("_h"), html)
    n = usable.count()
    if n > 2 * SAMPLE_RECORDS:
        usable = usable.where(F.col("_h") <= (2 * SAMPLE_RECORDS << 31) // n)
    some = usable.orderBy("_h", html).limit(SAMPLE_RECORDS)
    samples = [r[0].encode() for r in some.select(html).collect()]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform records to train on: their own bytes serve
        return b"".join(samples)[-DICTIONARY_BYTES:]


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with the payload's length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_urn(page_id)}"]
    lines += [f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return None if number == "none" else int(number)


def parse_record(raw: bytes) -> dict:
    """The fields of a record; a response's digest and length are taken from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out = {"page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": None}
    if out["record_type"] == "revisit":
        length = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"]
        return out | {"payload_bytes": int(length), "payload_digest": fields["WARC-Payload-Digest"].partition(":")[2], "refers_to": _page(fields["WARC-Refers-To"])}
    if fields["WARC-Payload-Digest"] != f"sha1:{payload_digest(payload)}":
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't have the payload of its digest")
    return out | {"payload_bytes": len(payload), "payload_digest": payload_digest(payload)}


def frames(archive: bytes) -> Iterator[tuple[bool, memoryview]]:
    """(whether it is skippable, frame) of an archive, by the lengths that the frames state."""
    view, at = memoryview(archive), 0
    while at < len(view):
        magic = struct.unpack_from("<I", view, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + struct.unpack_from("<I", view, at + 4)[0]
            yield True, view[at:end]
        else:
            head = view[at : at + 18]
            end, last = at + zstandard.frame_header_size(head), False
            while not last:
                block = int.from_bytes(view[end : end + 3], "little")
                last, kind, size = block & 1, block >> 1 & 3, block >> 3
                end += 3 + (1 if kind == 1 else size)
            end += 4 * zstandard.get_frame_parameters(head).has_checksum
            yield False, view[at:end]
        at = end


def read_archive(archive: bytes) -> Iterator[dict]:
    reader = zstandard.ZstdDecompressor()
    for skippable, frame in frames(archive):
        if not skippable:
            yield parse_record(reader.decompress(frame))
        elif frame[:4] == struct.pack("<I", DICTIONARY_MAGIC):
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(frame[8:])))


def with_revisits(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """Adds refers_to: the largest page_id of equal payloads, on the others that have an id.

    Payloads shorter than ``least_bytes`` never refer. The largest ids are partial aggregates, so
    copies combine before the shuffle, and a written table of the payloads that have copies: where
    it is small the engine broadcasts it, else it splits the join where a payload has very many.
    """
    key = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    long = F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes
    last = pages.where(long).select(key.alias("_key"), "page_id").groupBy("_key").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
    last = scratch.write(last.where("_n > 1").select("_key", "_last"), "copied-payloads")
    joined = pages.withColumn("_key", F.when(long, key)).join(last, "_key", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("_last"), F.col("_last")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes a record for every page: (page_id, url, html) into archive files under ``path``."""
    bounded_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    dictionary = train_dictionary(pages)
    pieces = min(FILE_PIECES, FILE_RECORDS)
    records, size = FILE_RECORDS // pieces, FILE_BYTES // pieces

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        rows = 0
        piece: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            nonlocal rows, held
            out = [b"".join(piece)]
            if rows % (pieces + 1) == 0:  # the first row of each file
                out.insert(0, lead)
            rows += len(out)
            held = 0
            piece.clear()
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                piece.append(writer.compress(record_bytes(page_id, url, (html or "").encode(), refers_to)))
                held += len(piece[-1])
                if len(piece) >= records or held >= size:
                    yield row()
        if piece:
            yield row()

    lines = with_revisits(pages, Scratch(pages.sparkSession), least_bytes).mapInArrow(tidy(run), "frame binary").select(F.col("frame").cast("string").alias("value"))
    lines.write.option("lineSep", EMPTY_FRAME).option("compression", "none").option("maxRecordsPerFile", pieces + 1).text(path)


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark, path: str) -> DataFrame:
    """The records of all archive files under ``path``, read one at a time; rows go out READ_ROWS at a time."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    schema = pa.schema([(n, pa.string() if "string" in c else pa.int64()) for n, c in zip(names, RECORD.split(", "), strict=True)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                for found in itertools.batched(read_archive(archive.as_py()), READ_ROWS):
                    yield pa.RecordBatch.from_pylist(list(found), schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(tidy(run), RECORD)


def round_trip(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Writes the pages' archives to the new folder ``path`` and reads them back, a row per page.

    Null payloads are empty, null urls about:blank; a null page_id is never referred to and refers
    to nothing; rows that repeat the largest page_id of a payload are responses each; an empty
    table gives no rows; other columns are ignored.
    """
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)
