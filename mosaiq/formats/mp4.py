"""MP4: boxes and sample tables, and the bytes of the key frame nearest to a tenth of the duration.

The video's bit stream has no decoder yet; one that is registered for "h264" gets the frame and the stream's parameters.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

from mosaiq.codecs.base import DecodeError, Grid

SHARE = 0.1


def boxes(data: bytes, at: int = 0, end: int | None = None):
    """(type, begin, end) of the boxes' bodies; a size of 1 is 64 bits long, 0 reaches to the end."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        elif size == 0:
            size = end - at
        if size < head:
            return
        yield kind, at + head, min(end, at + size)
        at += size


def find(data: bytes, begin: int, end: int, *path: bytes) -> tuple[int, int] | None:
    for kind in path:
        found = next(((a, b) for k, a, b in boxes(data, begin, end) if k == kind), None)
        if found is None:
            return None
        begin, end = found
    return begin, end


@dataclass
class Track:
    """Sample tables of a video track."""

    width: int = 0
    height: int = 0
    codec: str = ""
    parameters: bytes = b""
    stts: list[tuple[int, int]] = field(default_factory=list)
    stss: list[int] | None = None
    stsc: list[tuple[int, int]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    chunks: list[int] = field(default_factory=list)


def video_track(data: bytes) -> Track:
    moov = find(data, 0, len(data), b"moov")
    if moov is None:
        raise DecodeError("MP4 without a moov box")
    for kind, a, b in boxes(data, *moov):
        handler = find(data, a, b, b"mdia", b"hdlr") if kind == b"trak" else None
        if handler is None or data[handler[0] + 8 : handler[0] + 12] != b"vide":
            continue
        table = find(data, a, b, b"mdia", b"minf", b"stbl")
        if table is None:
            continue
        t = Track()
        for name, x, y in boxes(data, *table):
            words = lambda at, n: struct.unpack_from(f">{max(0, min(n, (y - at) // 4))}I", data, at)  # noqa: B023, E731
            if y - x < 8:
                continue
            (count,) = struct.unpack_from(">I", data, x + 4)
            if name == b"stsd":
                entry = next(iter(boxes(data, x + 8, y)), None)
                if entry:
                    t.codec = entry[0].decode("latin-1")
                    t.width, t.height = struct.unpack_from(">HH", data, entry[1] + 24)
                    config = find(data, entry[1] + 78, entry[2], b"avcC")
                    t.parameters = data[slice(*config)] if config else b""
            elif name == b"stts":
                w = words(x + 8, 2 * count)
                t.stts = list(zip(w[::2], w[1::2], strict=False))
            elif name == b"stss":
                t.stss = list(words(x + 8, count))
            elif name == b"stsc":
                w = words(x + 8, 3 * count)
                t.stsc = list(zip(w[::3], w[1::3], strict=False))
            elif name == b"stsz":
                (n,) = struct.unpack_from(">I", data, x + 8)
                t.sizes = [count] * n if count else list(words(x + 12, n))
            elif name == b"stco":
                t.chunks = list(words(x + 8, count))
            elif name == b"co64":
                t.chunks = list(struct.unpack_from(f">{min(count, (y - x - 8) // 8)}Q", data, x + 8))
        return t
    raise DecodeError("MP4 without a video track")


def target_sample(t: Track, share: float = SHARE) -> int:
    """The sample, from 1, at a share of the duration."""
    goal, time, sample = math.floor(share * sum(n * d for n, d in t.stts)), 0, 1
    for n, d in t.stts:
        k = n if not d else max(0, min(n, (goal - time) // d))
        time, sample = time + k * d, sample + k
        if time >= goal:
            break
    return min(sample, sum(n for n, _ in t.stts) or 1)


def sync_sample(t: Track, target: int) -> int:
    if not t.stss:
        return target
    found = 1
    for s in t.stss:
        if s > target:
            break
        found = s
    return found


def sample_place(t: Track, sample: int) -> tuple[int, int]:
    """(offset, size) of a sample: its chunk by running sums, then the sizes before it in that chunk."""
    first, step = 0, 0
    for chunk, offset in enumerate(t.chunks, 1):
        while step + 1 < len(t.stsc) and t.stsc[step + 1][0] <= chunk:
            step += 1
        per = t.stsc[step][1] if t.stsc and t.stsc[step][0] <= chunk else 1
        if first + per > sample - 1:
            if sample > len(t.sizes):
                break
            return offset + sum(t.sizes[first : sample - 1]), t.sizes[sample - 1]
        first += per
    raise DecodeError("MP4 sample out of range")


def key_frame(data: bytes) -> tuple[Track, bytes]:
    t = video_track(data)
    if t.codec not in ("avc1", "avc3"):
        raise DecodeError(f"Unsupported video codec: {t.codec or 'none'}")
    offset, size = sample_place(t, sync_sample(t, target_sample(t)))
    return t, data[offset : offset + size]


def nal_units(frame: bytes, parameters: bytes) -> list[bytes]:
    """Units of a frame, by the length size that the parameters name; the parameter sets come first."""
    if len(parameters) < 7:
        return []
    width, at, out = (parameters[4] & 3) + 1, 5, []
    for mask in (31, 255):
        count = parameters[at] & mask if at < len(parameters) else 0
        at += 1
        for _ in range(count):
            n = int.from_bytes(parameters[at : at + 2], "big")
            out.append(parameters[at + 2 : at + 2 + n])
            at += 2 + n
    at = 0
    while at + width <= len(frame):
        n = int.from_bytes(frame[at : at + width], "big")
        out.append(frame[at + width : at + width + n])
        at += width + n
    return out


def decode_mp4(data: bytes) -> Grid:
    from mosaiq.codecs.registry import DECODERS

    t, frame = key_frame(data)
    if "h264" not in DECODERS:
        raise DecodeError(f"No decoder for H.264 bit streams ({t.width}x{t.height})")
    return DECODERS["h264"](b"".join(b"\0\0\0\1" + unit for unit in nal_units(frame, t.parameters)), None)
