"""Block codecs: none, deflate, LZW, PackBits, and the two predictors. JPEG is refused."""

from __future__ import annotations

import zlib

import numpy as np

NONE, LZW, JPEG, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 7, 8, 32946, 32773
#: (bits, sample format) -> numpy kind; formats: 1 unsigned, 2 signed, 3 float.
SAMPLES = {(8, 1): "u1", (8, 2): "i1", (16, 1): "u2", (16, 2): "i2", (32, 1): "u4", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}


def lzw_decode(data: bytes, expected: int | None = None) -> bytes:
    """Most significant bit first, 9 to 12 bits, width growing one code early as the format has it.

    Where that doesn't give the expected length, the late variant of old writers is tried, block by block."""
    out = _lzw(data, early=1)
    if expected is not None and len(out) < expected:
        late = _lzw(data, early=0)
        if len(late) > len(out):
            return late
    return out


def _lzw(data: bytes, early: int) -> bytes:
    out, table, width, buffer, held, before = bytearray(), [], 9, 0, 0, b""
    base = [bytes([k]) for k in range(256)] + [b"", b""]
    table = list(base)
    for byte in data:
        buffer, held = buffer << 8 | byte, held + 8
        while held >= width:
            code = buffer >> (held - width) & ((1 << width) - 1)
            held -= width
            buffer &= (1 << held) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, before = list(base), 9, b""
                continue
            if code < len(table):
                entry = table[code]
            elif code == len(table) and before:
                entry = before + before[:1]
            else:
                return bytes(out)
            out += entry
            if before:
                table.append(before + entry[:1])
            before = entry
            if len(table) + early >= 1 << width and width < 12:
                width += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    table, width, buffer, held, out = {bytes([k]): k for k in range(256)}, 9, 0, 0, bytearray()
    size = 258

    def put(code: int) -> None:
        nonlocal buffer, held
        buffer, held = buffer << width | code, held + width
        while held >= 8:
            out.append(buffer >> (held - 8) & 255)
            held -= 8
        buffer &= (1 << held) - 1

    put(256)
    word = b""
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
        if size >= 4094:
            put(256)
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        word = data[k : k + 1]
    if word:
        put(table[word])
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if held:
        out.append(buffer << (8 - held) & 255)
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        elif n > 128:
            out += data[k + 1 : k + 2] * (257 - n)
            k += 2
        else:
            k += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        run = 1
        while run < 128 and k + run < len(data) and data[k + run] == data[k]:
            run += 1
        if run > 1:
            out += bytes([257 - run]) + data[k : k + 1]
        else:
            while run < 128 and k + run < len(data) and (k + run + 1 >= len(data) or data[k + run] != data[k + run + 1]):
                run += 1
            out += bytes([run - 1]) + data[k : k + run]
        k += run
    return bytes(out)


def decompress(data: bytes, compression: int, expected: int | None = None) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, DEFLATE_OLD):
        return zlib.decompress(data)
    if compression == LZW:
        return lzw_decode(data, expected)
    if compression == PACKBITS:
        return packbits_decode(data)
    raise ValueError(f"compression {compression} is not supported")


def compress(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, DEFLATE: zlib.compress, LZW: lzw_encode, PACKBITS: packbits_encode}[compression](data)


def undo_predictor(data: bytes, predictor: int, width: int, samples: int, bits: int, big_endian: bool = False) -> bytes:
    """Rows of width x samples values; 2 sums neighbours of a band, 3 sums bytes and then puts byte planes together."""
    if predictor in (0, 1):
        return data
    if bits % 8 or predictor not in (2, 3):
        raise ValueError(f"predictor {predictor} of {bits} bits is not supported")
    size = bits // 8
    row = width * samples * size
    whole = len(data) // row * row
    order = ">" if big_endian else "<"
    if predictor == 2:
        values = np.frombuffer(data[:whole], f"{order}u{size}").reshape(-1, width, samples)
        return np.cumsum(values, axis=1, dtype=f"u{size}").astype(f"{order}u{size}").tobytes() + data[whole:]
    planes = np.cumsum(np.frombuffer(data[:whole], "u1").reshape(-1, width * size, samples), axis=1, dtype="u1").reshape(-1, size, width * samples)
    values = planes.transpose(0, 2, 1)
    return np.ascontiguousarray(values if big_endian else values[:, :, ::-1]).tobytes() + data[whole:]


def predict(data: bytes, predictor: int, width: int, samples: int, bits: int) -> bytes:
    """The inverse, for little-endian data."""
    size = bits // 8
    if predictor == 2:
        values = np.frombuffer(data, f"<u{size}").reshape(-1, width, samples)
        return np.concatenate([values[:, :1], np.diff(values, axis=1)], axis=1).astype(f"<u{size}").tobytes()
    if predictor == 3:
        planes = np.frombuffer(data, "u1").reshape(-1, width * samples, size)[:, :, ::-1].transpose(0, 2, 1).reshape(-1, width * size, samples)
        return np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype("u1").tobytes()
    return data


def to_floats(data: bytes, bits: int, sample_format: int, big_endian: bool = False) -> np.ndarray:
    """Samples as 32-bit floats; kinds that are not known become 0."""
    kind = SAMPLES.get((bits, sample_format))
    if kind is None:
        return np.zeros(len(data) * 8 // max(bits, 1), np.float32)
    usable = len(data) // (bits // 8) * (bits // 8)
    return np.frombuffer(data[:usable], (">" if big_endian else "<") + kind).astype(np.float32)
