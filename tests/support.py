"""Encoders for test images and models."""

import struct
import zlib

import numpy as np


def png(rgb: np.ndarray) -> bytes:
    height, width = rgb.shape[:2]
    rows = b"".join(b"\0" + rgb[y].tobytes() for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    colour = {3: 2, 4: 6, 1: 0}[rgb.shape[2]]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def mean_model(channels: int, height: int, width: int) -> bytes:
    """An ONNX model that averages each channel (GlobalAveragePool)."""
    shape = lambda dims: b"".join(_field(1, _field(1, d)) for d in dims)
    value = lambda name, dims: _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape(dims))))
    node = _field(1, "x") + _field(2, "y") + _field(4, "GlobalAveragePool")
    graph = _field(1, node) + _field(2, "g") + _field(11, value("x", (1, channels, height, width))) + _field(12, value("y", (1, channels, 1, 1)))
    return _field(1, 7) + _field(7, graph) + _field(8, _field(2, 13))
