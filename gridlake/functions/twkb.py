"""TWKB (tiny well-known binary) for polygons, after the public specification, as Arrow functions on batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from gridlake.functions.geometry import POLYGONS_TYPE

POLYGON, MULTIPOLYGON = 3, 6
_ARROW = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def encode(polygons, precision: int = 6) -> bytes:
    """Always a MultiPolygon; one cursor runs through all rings, and a ring's closing point is left out."""
    out = bytearray([_zigzag(precision) << 4 | MULTIPOLYGON, 0x10 if not polygons else 0])
    if not polygons:
        return bytes(out)
    out += _varint(len(polygons))
    scale, at = 10.0**precision, [0, 0]
    for polygon in polygons:
        out += _varint(len(polygon))
        for ring in polygon:
            points = [(round(p["x"] * scale), round(p["y"] * scale)) for p in ring]
            if len(points) > 1 and points[0] == points[-1]:
                points.pop()
            out += _varint(len(points))
            for x, y in points:
                out += _varint(_zigzag(x - at[0])) + _varint(_zigzag(y - at[1]))
                at = [x, y]
    return bytes(out)


def decode(data: bytes):
    """Polygons with closed rings; ValueError for other types, optional blocks, bad counts and trailing bytes."""
    if len(data) < 2:
        raise ValueError("too short")
    kind, precision = data[0] & 15, data[0] >> 4
    precision = (precision >> 1) ^ -(precision & 1)
    if kind not in (POLYGON, MULTIPOLYGON):
        raise ValueError(f"type {kind} is not a polygon")
    if data[1] & 0x10:
        return []
    if data[1]:
        raise ValueError("bounding boxes, sizes, id lists and more dimensions are not read")
    place, at, scale = 2, [0, 0], 10.0**precision

    def number() -> int:
        nonlocal place
        value = shift = 0
        while True:
            if place >= len(data) or shift > 63:
                raise ValueError("a number runs past the end")
            byte = data[place]
            place += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    def count() -> int:
        n = number()
        if n > len(data) - place + 1:
            raise ValueError("a count is larger than what follows")
        return n

    found = []
    for _ in range(count() if kind == MULTIPOLYGON else 1):
        polygon = []
        for _ in range(count()):
            ring = []
            for _ in range(count()):
                for axis in (0, 1):
                    n = number()
                    at[axis] += (n >> 1) ^ -(n & 1)
                ring.append({"x": at[0] / scale, "y": at[1] / scale})
            if ring and ring[0] != ring[-1]:
                ring.append(dict(ring[0]))
            polygon.append(ring)
        found.append(polygon)
    if place != len(data):
        raise ValueError("bytes follow the geometry")
    return found


def looks_like_twkb(data: bytes) -> bool:
    return len(data) > 0 and data[0] & 15 in (POLYGON, MULTIPOLYGON) and data[0] >= 0x20


@arrow_udf(BinaryType())
def twkb_encode(polygons: pa.Array) -> pa.Array:
    return pa.array([None if p is None else encode(p) for p in polygons.to_pylist()], pa.binary())


@arrow_udf(POLYGONS_TYPE)
def twkb_decode(data: pa.Array) -> pa.Array:
    """Null where the bytes are no TWKB polygon."""

    def one(b):
        try:
            return None if b is None else decode(b)
        except ValueError:
            return None

    return pa.array(map(one, data.to_pylist()), _ARROW)
