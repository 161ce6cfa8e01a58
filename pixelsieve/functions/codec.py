"""Text and binary forms of fingerprints, and strict parsing of numbers."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelsieve.types import ALGORITHM, COMPONENTS, VERSION

#: Encoded fingerprints start with ``<scheme>:v<version>:``. The scheme is a parameter, so that
#: files of other systems with the same layout can be read and written.
SCHEME = "fp"


def _prefix(version: Column, scheme: str) -> Column:
    return F.concat(F.lit(f"{scheme}:v"), version.cast("string"), F.lit(":"))


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def encode_raw(binary: str | Column, version: Column | None = None, scheme: str = SCHEME) -> Column:
    return F.concat(F.encode(_prefix(F.lit(VERSION) if version is None else version, scheme), "UTF-8"), _col(binary))


def encode_hex(binary: str | Column, version: Column | None = None, scheme: str = SCHEME) -> Column:
    return F.concat(_prefix(F.lit(VERSION) if version is None else version, scheme), F.lower(F.hex(_col(binary))))


def encode_base64(binary: str | Column, version: Column | None = None, scheme: str = SCHEME) -> Column:
    plain = F.regexp_replace(F.base64(_col(binary)), r"[\r\n]", "")
    return F.concat(_prefix(F.lit(VERSION) if version is None else version, scheme), plain)


def payload(text: str | Column, expected_version: int = VERSION, scheme: str = SCHEME) -> Column:
    """What follows the prefix; all of it without a prefix; null for another version or no colon."""
    text, tag = _col(text), f"{scheme}:v"
    rest = F.substr(text, F.lit(len(tag) + 1))
    colon = F.instr(rest, ":")
    # the version may be followed by anything up to the colon
    version = F.regexp_extract(F.substr(rest, F.lit(1), colon - 1), r"^\s*\+?(\d+)", 1)
    right = (colon > 0) & F.coalesce(version.try_cast("long") == expected_version, F.lit(False))
    return F.when(~text.startswith(tag), text).when(right, F.substr(rest, colon + 1))


def _sized(binary: Column) -> Column:
    return F.when(F.octet_length(binary) == COMPONENTS, binary)


def decode_hex(text: str | Column, expected_version: int = VERSION, scheme: str = SCHEME, lenient: bool = False) -> Column:
    """144 bytes, else null. ``lenient`` takes a pair that starts with a digit as that digit."""
    body = payload(text, expected_version, scheme)
    if not lenient:
        return _sized(F.try_to_binary(body, F.lit("hex")))
    pair = r"(?s)(..)"
    pairs = F.regexp_extract_all(body, F.lit(pair), F.lit(1))

    def value(two: Column) -> Column:
        digits = F.regexp_extract(two, r"^\s*([+-]?[0-9A-Fa-f]+)", 1)
        number = F.conv(F.regexp_replace(digits, r"[+-]", ""), 16, 10).cast("int")
        return F.when(digits != "", F.when(digits.startswith("-"), F.pmod(-number, F.lit(256))).otherwise(number))

    numbers = F.transform(pairs, value)
    whole = (F.length(body) % 2 == 0) & ~F.exists(numbers, lambda x: x.isNull())
    return _sized(F.when(whole, F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 2, "0")), ""))))


def decode_base64(text: str | Column, expected_version: int = VERSION, scheme: str = SCHEME) -> Column:
    """144 bytes, else null; white space is passed over and what follows the padding ignored."""
    body = F.regexp_replace(payload(text, expected_version, scheme), r"\s", "")
    bare = F.regexp_extract(body, r"^([A-Za-z0-9+/]*)(=|$)", 1)
    valid = body.rlike(r"^[A-Za-z0-9+/]*(=|$)")
    padded = F.rpad(bare, ((F.length(bare) + 3) / 4).cast("int") * 4, "=")
    return _sized(F.when(valid, F.try_to_binary(padded, F.lit("base64"))))


def decode_raw(binary: str | Column, expected_version: int = VERSION, scheme: str = SCHEME) -> Column:
    """144 bytes after the prefix, else null."""
    binary, tag = _col(binary), f"{scheme}:v{expected_version}:".encode()
    head = F.substring(binary, 1, len(tag))
    tagged = F.substring(binary, 1, len(f"{scheme}:v")) == F.lit(f"{scheme}:v".encode())
    return F.when(head == F.lit(tag), _sized(F.substring(binary, len(tag) + 1, COMPONENTS + 1))).when(~tagged, _sized(binary))


def encode_blob(binary: str | Column, algorithm: Column | None = None, version: Column | None = None) -> Column:
    """149 bytes: version (4 bytes, little-endian), algorithm (1 byte), components."""
    version = F.lit(VERSION) if version is None else version
    algorithm = F.lit(ALGORITHM) if algorithm is None else algorithm
    little = [F.lpad(F.hex(F.shiftright(version.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)]
    return F.concat(F.unhex(F.concat(*little, F.lpad(F.hex(algorithm.cast("long").bitwiseAND(255)), 2, "0"))), _col(binary))


def decode_blob(blob: str | Column) -> Column:
    """STRUCT<version, algorithm, bytes>, null unless the blob has 149 bytes."""
    blob = _col(blob)
    head = F.hex(F.substring(blob, 1, 5))
    version = F.conv(F.concat(*[F.substring(head, 2 * i + 1, 2) for i in (3, 2, 1, 0)]), 16, 10).cast("long")
    algorithm = F.conv(F.substring(head, 9, 2), 16, 10).cast("int")
    return F.when(F.octet_length(blob) == COMPONENTS + 5, F.struct(version.alias("version"), algorithm.alias("algorithm"), F.substring(blob, 6, COMPONENTS).alias("bytes")))


_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
#: A mantissa that isn't zero: where the number is, it was too small for a double.
_NOT_ZERO = r"^[^eE]*[1-9]"


def strict_double(text: str | Column) -> Column:
    """A double where the whole text is one, without white space around it; else null.

    Decimal numbers, ``inf``/``infinity`` and ``nan`` are taken, in any case; numbers beyond the
    range of doubles, too large or too small, are not.
    """
    text = _col(text)
    number = F.when(text.rlike(rf"^{_NUMBER}\z"), text.try_cast("double"))
    number = F.when((F.abs(number) != float("inf")) & ((number != 0) | ~text.rlike(_NOT_ZERO)), number)
    word = F.lower(F.regexp_replace(text, r"^[+-]", ""))
    special = F.when(text.rlike(r"^[+-]?[A-Za-z]+\z") & word.isin("inf", "infinity"), F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return F.coalesce(number, special, F.when(text.rlike(r"^[+-]?[A-Za-z]+\z") & (word == "nan"), F.lit(float("nan"))))


def parse_double(text: str) -> float | None:
    """The same for one string on the driver; hexadecimal numbers too."""
    if re.fullmatch(r"[+-]?0[xX][0-9A-Fa-f]+(\.[0-9A-Fa-f]*)?([pP][+-]?\d+)?", text):
        return float.fromhex(text)
    if re.fullmatch(_NUMBER, text):
        value = float(text)
        return None if math.isinf(value) or (value == 0 and re.match(_NOT_ZERO, text)) else value
    return float(text) if re.fullmatch(r"(?i)[+-]?(inf|infinity|nan)", text) else None


def split_list(text: str | Column) -> Column:
    """Parts between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(_col(text), ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
