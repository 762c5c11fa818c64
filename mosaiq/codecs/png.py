"""PNG: decoding of 8-bit pictures, encoding of RGBA."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from mosaiq.codecs.base import DecodeError, Grid, check_size, gray, opaque, padded, unpack

MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        size, kind = unpack(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IEND":
            return


def unfilter(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """Undo the row filters. Sub is a running sum and Up a sum of rows; Average and Paeth depend on each byte before."""
    rows = padded(raw, h * (stride + 1)).reshape(h, stride + 1)
    out = np.zeros((h + 1, stride), np.uint8)
    for y in range(h):
        kind, row, up = rows[y, 0], rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = row
        elif kind == 1:
            wide = np.zeros((-(-stride // step), step), np.uint8)
            wide.ravel()[:stride] = row
            out[y + 1] = np.cumsum(wide, axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            out[y + 1] = row + up
        elif kind == 3:
            done, above = [0] * step, up.tolist()
            for i, v in enumerate(row.tolist()):
                done.append((v + (done[i] + above[i] >> 1)) & 255)
            out[y + 1] = done[step:]
        elif kind == 4:
            done, above = [0] * step, [0] * step + up.tolist()
            for i, v in enumerate(row.tolist()):
                a, b, c = done[i], above[i + step], above[i]
                pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                done.append((v + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255)
            out[y + 1] = done[step:]
        else:
            raise DecodeError(f"Unknown PNG filter: {kind}")
    return out[1:]


def decode_png(data: bytes) -> Grid:
    """Colour types 0, 2, 3, 4 and 6 with 8 bits, not interlaced."""
    if data[:8] != MAGIC:
        raise DecodeError("Not a PNG file")
    header, table, body = None, None, []
    for kind, content in _chunks(data):
        if kind == b"IHDR":
            header = unpack(">IIBBBBB", content)
        elif kind == b"PLTE":
            table = np.frombuffer(content[: len(content) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(content)
    if header is None:
        raise DecodeError("PNG without a header")
    w, h, depth, colour, _, _, interlaced = header
    w, h = check_size(w, h)
    if depth != 8:
        raise DecodeError(f"Unsupported PNG bit depth: {depth}")
    if interlaced:
        raise DecodeError("Interlaced PNG is not supported")
    if colour not in _CHANNELS:
        raise DecodeError(f"Unsupported PNG colour type: {colour}")
    try:
        raw = zlib.decompressobj().decompress(b"".join(body), h * (w * _CHANNELS[colour] + 1))
    except zlib.error as e:
        raise DecodeError(f"PNG data: {e}") from None
    n = _CHANNELS[colour]
    if len(raw) < h * (w * n + 1):
        raise DecodeError("PNG data end early")
    rows = unfilter(raw, h, w * n, n).reshape(h, w, n)
    if colour == 3:
        if table is None:
            raise DecodeError("PNG without a palette")
        whole = np.zeros((256, 3), np.uint8)
        whole[: len(table)] = table[:256]
        return opaque(whole[rows[..., 0]])
    if n < 3:
        out = gray(rows[..., 0])
    else:
        out = opaque(rows[..., :3])
    if n in (2, 4):
        out.rgba[..., 3] = rows[..., -1]
    return out


def _chunk(kind: bytes, content: bytes) -> bytes:
    return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))


def encode_png(grid: Grid) -> bytes:
    """RGBA with filter 0 on every row."""
    rows = np.zeros((grid.height, grid.width * 4 + 1), np.uint8)
    rows[:, 1:] = grid.rgba.reshape(grid.height, -1)
    header = struct.pack(">IIBBBBB", grid.width, grid.height, 8, 6, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")
