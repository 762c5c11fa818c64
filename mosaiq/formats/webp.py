"""WebP: the container. The first frame of an animation is taken out as a picture of its own; its bit stream has no decoder
here unless one is registered for it."""

from __future__ import annotations

import struct

from mosaiq.codecs.base import DecodeError, Grid


def chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        yield name, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def first_frame(data: bytes) -> bytes:
    """A file of one picture: the file itself, or the first frame of an animation."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise DecodeError("Not a WebP file")
    for name, body in chunks(data, 12, len(data)):
        if name == b"ANMF":
            x, y = (int.from_bytes(body[k : k + 3], "little") + 1 for k in (6, 9))
            inner = list(chunks(body, 16, len(body)))
            head = struct.pack("<4sII", b"VP8X", 10, 0x10 if any(n == b"ALPH" for n, _ in inner) else 0) + (x - 1).to_bytes(3, "little") + (y - 1).to_bytes(3, "little")
            parts = b"".join(struct.pack("<4sI", n, len(b)) + b + b"\0" * (len(b) % 2) for n, b in inner if n in (b"ALPH", b"VP8 ", b"VP8L"))
            packed = head + parts if any(n == b"ALPH" for n, _ in inner) else parts
            return struct.pack("<4sI4s", b"RIFF", 4 + len(packed), b"WEBP") + packed
    return data


def size(data: bytes) -> tuple[int, int]:
    """Width and height from the first chunk that tells them."""
    for name, b in chunks(data, 12, len(data)):
        if name == b"VP8X" and len(b) >= 10:
            return int.from_bytes(b[4:7], "little") + 1, int.from_bytes(b[7:10], "little") + 1
        if name == b"VP8L" and len(b) >= 5:
            bits = int.from_bytes(b[1:5], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if name == b"VP8 " and len(b) >= 10:
            w, h = struct.unpack_from("<HH", b, 6)
            return w & 0x3FFF, h & 0x3FFF
    raise DecodeError("WebP without a picture")


def decode_webp(data: bytes) -> Grid:
    w, h = size(first_frame(data))
    raise DecodeError(f"No decoder for WebP bit streams ({w}x{h})")
