"""GIF, ICO / CUR / ANI and TIFF."""

from __future__ import annotations

import zlib

import numpy as np

from mosaiq.codecs.base import DecodeError, Grid, bits_to_samples, check_size, gray, opaque, packbits, padded, unpack
from mosaiq.codecs.png import MAGIC, decode_png


def lzw(data: bytes, first_bits: int, lsb: bool, size: int, early: int = 0) -> bytes:
    """LZW codes to at most `size` bytes: GIF packs from the low bit, TIFF and PDF from the high one and widen `early`."""
    clear, end = 1 << first_bits, (1 << first_bits) + 1
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, have, bits, at = bytearray(), 0, 0, 0
    width, last = first_bits + 1, None
    while len(out) < size:
        while bits < width and at < len(data):
            have = have | data[at] << bits if lsb else have << 8 | data[at]
            bits, at = bits + 8, at + 1
        if bits < width:
            break
        if lsb:
            code, have = have & (1 << width) - 1, have >> width
        else:
            code = have >> bits - width
            have &= (1 << bits - width) - 1
        bits -= width
        if code == clear:
            table, width, last = table[: end + 1], first_bits + 1, None
            continue
        if code == end:
            break
        if code < len(table):
            entry = table[code]
        elif last is not None and code == len(table):
            entry = last + last[:1]
        else:
            break
        out += entry
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        if len(table) + early >= 1 << width and width < 12:
            width += 1
    return bytes(out[:size])


def interlaced_order(h: int) -> np.ndarray:
    """The row that each stored row of an interlaced GIF goes to."""
    return np.concatenate([np.arange(start, h, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes) -> Grid:
    """The first frame on the whole, transparent canvas; indices beyond the palette paint nothing."""
    if data[:4] != b"GIF8":
        raise DecodeError("Not a GIF file")
    w, h, flags = unpack("<HHB", data, 6)
    w, h = check_size(w, h)
    at, shared, clear = 13, None, None
    colours = lambda at, n: (padded(data[at:], 3 * n).reshape(n, 3), at + 3 * n)
    if flags & 128:
        shared, at = colours(at, 2 << (flags & 7))
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            at += 1
            if label == 0xF9 and at + 5 <= len(data):
                clear = data[at + 4] if data[at + 1] & 1 else None
            while at < len(data) and data[at]:
                at += data[at] + 1
            at += 1
        elif kind == 0x2C:
            x, y, fw, fh, own = unpack("<HHHHB", data, at)
            at += 9
            table = shared
            if own & 128:
                table, at = colours(at, 2 << (own & 7))
            if table is None:
                raise DecodeError("GIF without a colour table")
            least = data[at] if at < len(data) else 2
            at += 1
            parts = []
            while at < len(data) and data[at]:
                parts.append(data[at + 1 : at + 1 + data[at]])
                at += data[at] + 1
            check_size(fw, fh)
            index = padded(lzw(b"".join(parts), least, True, fw * fh), fw * fh).reshape(fh, fw)
            if own & 64:
                rows = np.empty_like(index)
                rows[interlaced_order(fh)] = index
                index = rows
            out = np.zeros((h, w, 4), np.uint8)
            index = index[: max(0, h - y), : max(0, w - x)]
            seen = index < len(table)
            if clear is not None:
                seen &= index != clear
            part = out[y : y + index.shape[0], x : x + index.shape[1]]
            part[seen, :3] = table[index[seen]]
            part[seen, 3] = 255
            return Grid(out)
        else:
            break
    raise DecodeError("GIF without a frame")


def _icon_bitmap(data: bytes) -> Grid:
    """A bitmap without file header: twice its height, colours over a mask of one bit."""
    size, w, h, _, bits, _, _, _, _, used = unpack("<IiiHHIIiiI", data)
    w, h = check_size(w, abs(h) // 2)
    at = size
    stride, mask_stride = (w * bits + 31) // 32 * 4, (w + 31) // 32 * 4
    if bits == 8:
        n = used or 256
        table = padded(data[at:], 4 * n).reshape(n, 4)[:, 2::-1]
        at += 4 * n
        rows = padded(data[at:], stride * h).reshape(h, stride)[::-1, :w]
        whole = np.zeros((256, 3), np.uint8)
        whole[: min(n, 256)] = table[:256]
        out = opaque(whole[rows])
    elif bits in (24, 32):
        rows = padded(data[at:], stride * h).reshape(h, stride)[::-1, : w * bits // 8].reshape(h, w, bits // 8)
        out = opaque(rows[..., 2::-1])
        if bits == 32 and rows[..., 3].any():
            out.rgba[..., 3] = rows[..., 3]
            return out
    else:
        raise DecodeError(f"Unsupported icon bit depth: {bits}")
    at += stride * h
    if at + mask_stride * h <= len(data):
        mask = bits_to_samples(padded(data[at:], mask_stride * h).reshape(h, mask_stride), 1, w)[::-1]
        out.rgba[..., 3] = np.where(mask, 0, 255)
    return out


def best_entry(data: bytes) -> tuple[int, int]:
    """(offset, size) of the icon of largest area, then most bits, then first."""
    (count,) = unpack("<H", data, 4)
    entries = [unpack("<BBBBHHII", data, 6 + 16 * i) for i in range(count) if 22 + 16 * i <= len(data)]
    if not entries:
        raise DecodeError("ICO contains no images")
    found = max(range(len(entries)), key=lambda i: ((entries[i][0] or 256) * (entries[i][1] or 256), entries[i][5], -i))
    return entries[found][7], entries[found][6]


def decode_ico(data: bytes) -> Grid:
    """ICO and CUR: the best entry, a PNG or a bitmap; ANI: its first frame."""
    if data[:4] == b"RIFF":
        at = 12
        while at + 8 <= len(data):
            name, size = unpack("<4sI", data, at)
            if name == b"LIST" and data[at + 8 : at + 12] == b"fram":
                inner = at + 12
                while inner + 8 <= min(len(data), at + 8 + size):
                    name, part = unpack("<4sI", data, inner)
                    if name == b"icon":
                        return decode_ico(data[inner + 8 : inner + 8 + part])
                    inner += 8 + part + part % 2
            at += 8 + size + size % 2
        raise DecodeError("ANI contains no frames")
    offset, size = best_entry(data)
    content = data[offset : offset + size]
    return decode_png(content) if content[:8] == MAGIC else _icon_bitmap(content)


_TYPE = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i"}


def decode_tiff(data: bytes) -> Grid:
    """The first directory: strips of 8-bit grey, RGB(A) or palette samples, plain, LZW, Deflate or PackBits."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise DecodeError("Not a TIFF file")
    (at,) = unpack(order + "I", data, 4)
    (count,) = unpack(order + "H", data, at)
    tags: dict[int, list[int]] = {}
    for i in range(count):
        tag, kind, n = unpack(order + "HHI", data, at + 2 + 12 * i)
        if kind in (1, 3, 4) and n <= len(data):
            size = {1: 1, 3: 2, 4: 4}[kind] * n
            place = at + 10 + 12 * i if size <= 4 else unpack(order + "I", data, at + 10 + 12 * i)[0]
            tags[tag] = list(unpack(f"{order}{n}{_TYPE[kind]}", data, place))
    one = lambda tag, default: tags.get(tag, [default])[0]
    w, h = check_size(one(256, 0), one(257, 0))
    packing, colour, samples = one(259, 1), one(262, 1), one(277, 1)
    if 322 in tags or 324 in tags:
        raise DecodeError("Tiled TIFF is not supported")
    if one(284, 1) != 1:
        raise DecodeError("Planar TIFF is not supported")
    if any(b != 8 for b in tags.get(258, [8])):
        raise DecodeError("Unsupported TIFF bit depth")
    rows_a_strip = min(one(278, h), h) or h
    row = w * samples
    parts, left = [], h
    for begin, size in zip(tags.get(273, []), tags.get(279, [len(data)] * len(tags.get(273, []))), strict=False):
        need = min(rows_a_strip, left) * row
        strip = data[begin : begin + size]
        if packing == 5:
            strip = lzw(strip, 8, False, need, early=1)
        elif packing in (8, 32946):
            try:
                strip = zlib.decompressobj().decompress(strip, need)
            except zlib.error as e:
                raise DecodeError(f"TIFF data: {e}") from None
        elif packing == 32773:
            strip, _ = packbits(strip, 0, need)
        elif packing != 1:
            raise DecodeError(f"Unsupported TIFF compression: {packing}")
        parts.append(strip[:need].ljust(need, b"\0"))
        left -= rows_a_strip
        if left <= 0:
            break
    pixels = padded(b"".join(parts), h * row).reshape(h, w, samples)
    if colour in (0, 1):
        out = gray(255 - pixels[..., 0] if colour == 0 else pixels[..., 0])
        extra = 1
    elif colour == 2 and samples >= 3:
        out, extra = opaque(pixels[..., :3]), 3
    elif colour == 3 and len(tags.get(320, [])) >= 768:
        table = (np.array(tags[320][:768]) >> 8).astype(np.uint8).reshape(3, 256).T
        return opaque(table[pixels[..., 0]])
    else:
        raise DecodeError(f"Unsupported TIFF colour: {colour}")
    if samples > extra:
        out.rgba[..., 3] = pixels[..., extra]
    return out
