"""PNG files of RGBA pixels, written and read with the standard library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: np.ndarray) -> bytes:
    """A PNG of an array (rows, columns, 4) of bytes."""
    rows, columns, _ = pixels.shape
    lines = np.concatenate([np.zeros((rows, 1), np.uint8), pixels.reshape(rows, -1).astype(np.uint8)], axis=1)
    header = struct.pack(">IIBBBBB", columns, rows, 8, 6, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """The pixels of a file that encode() wrote (8-bit RGBA, no filters)."""
    if data[:8] != SIGNATURE:
        raise ValueError("this is no PNG")
    at, packed, size = 8, b"", (0, 0)
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            packed += body
        at += n + 12
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(size[1], size[0] * 4 + 1)
    return lines[:, 1:].reshape(size[1], size[0], 4)
