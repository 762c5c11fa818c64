"""BMP, PNM, QOI, TGA, PCX, PSD and DDS."""

from __future__ import annotations

import numpy as np

from mosaiq.codecs.base import DecodeError, Grid, bits_to_samples, check_size, gray, half_up, opaque, packbits, padded, unpack


def decode_bmp(data: bytes) -> Grid:
    """24 and 32 bits, bottom-up or top-down; bit-field masks are taken to be the usual ones."""
    start, _, w, h, _, bits, packing = unpack("<IIiiHHI", data, 10)
    if bits not in (24, 32):
        raise DecodeError(f"Unsupported BMP bit depth: {bits}")
    if packing not in (0, 3):
        raise DecodeError(f"Unsupported BMP compression: {packing}")
    w, rows = check_size(w, abs(h))
    stride = (w * bits // 8 + 3) // 4 * 4
    body = padded(data[start:], stride * rows).reshape(rows, stride)[:, : w * bits // 8].reshape(rows, w, bits // 8)
    if h > 0:
        body = body[::-1]
    out = opaque(body[..., 2::-1])
    if bits == 32:
        out.rgba[..., 3] = body[..., 3]
    return out


def _pnm_header(data: bytes, n: int) -> tuple[list[int], int]:
    """n whole numbers after the magic, comments skipped; where the one white space after them ends."""
    at, found = 2, []
    while len(found) < n:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        begin = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if begin == at:
            raise DecodeError("Invalid PNM header")
        found.append(int(data[begin:at]))
    return found, at + 1


def decode_pnm(data: bytes) -> Grid:
    """P1 to P6; values are scaled from the file's maximum to 255."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456" or not kind:
        raise DecodeError("Not a PNM file")
    number = int(kind)
    bitmap, channels = number in (1, 4), 3 if number in (3, 6) else 1
    (w, h, *rest), at = _pnm_header(data, 2 if bitmap else 3)
    w, h = check_size(w, h)
    most = rest[0] if rest else 1
    if not 1 <= most <= 65535:
        raise DecodeError("Invalid PNM maximum")
    n = w * h * channels
    if number == 4:
        stride = (w + 7) // 8
        values = bits_to_samples(padded(data[at:], stride * h).reshape(h, stride), 1, w).ravel()
    elif number <= 3:
        body = b"\n".join(line.split(b"#")[0] for line in data[at - 1 :].split(b"\n"))
        words = list(body.translate(None, b" \t\r\n\v\f")) if number == 1 else body.split()
        try:
            values = np.array([x - 48 for x in words[:n]] if number == 1 else [int(x) for x in words[:n]], np.int64)
        except ValueError:
            raise DecodeError("Invalid PNM value") from None
        values = np.concatenate((values, np.zeros(n - len(values), np.int64)))
    else:
        values = padded(data[at:], n * (2 if most > 255 else 1))
        values = values.view(">u2").astype(np.int64) if most > 255 else values
    if bitmap:
        return gray((1 - values.reshape(h, w).astype(np.uint8)) * 255)
    scaled = (half_up(values * 255.0 / most).astype(np.int64) & 255).astype(np.uint8)
    return opaque(scaled.reshape(h, w, 3)) if channels == 3 else gray(scaled.reshape(h, w))


def encode_ppm(grid: Grid) -> bytes:
    return b"P6\n%d %d\n255\n" % (grid.width, grid.height) + grid.rgba[..., :3].tobytes()


def decode_qoi(data: bytes) -> Grid:
    """All six operations; a stream that ends early goes on with the colour at place 0 of the index."""
    if data[:4] != b"qoif":
        raise DecodeError("Not a QOI file")
    w, h = check_size(*unpack(">II", data, 4))
    out, total = [], w * h
    seen, pixel, at = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 14
    while len(out) < total:
        run = 1
        if at >= len(data):
            pixel, run = seen[0], 1
        else:
            op = data[at]
            at += 1
            if op == 0xFE:
                pixel = (*data[at : at + 3], pixel[3])
                at += 3
            elif op == 0xFF:
                pixel = tuple(data[at : at + 4])
                at += 4
            elif op < 64:
                pixel = seen[op]
            elif op < 128:
                pixel = ((pixel[0] + (op >> 4 & 3) - 2) & 255, (pixel[1] + (op >> 2 & 3) - 2) & 255, (pixel[2] + (op & 3) - 2) & 255, pixel[3])
            elif op < 192:
                green, both = (op & 63) - 32, data[at] if at < len(data) else 0
                at += 1
                pixel = ((pixel[0] + green - 8 + (both >> 4)) & 255, (pixel[1] + green) & 255, (pixel[2] + green - 8 + (both & 15)) & 255, pixel[3])
            else:
                run = (op & 63) + 1
            if len(pixel) < 4:
                pixel = (*pixel, *[0] * (4 - len(pixel)))
        seen[(pixel[0] * 3 + pixel[1] * 5 + pixel[2] * 7 + pixel[3] * 11) % 64] = pixel
        out += [pixel] * min(run, total - len(out))
    return Grid(np.array(out, np.uint8).reshape(h, w, 4))


def encode_qoi(grid: Grid) -> bytes:
    """A plain writer (runs, index and full colours) for tests and round trips."""
    out = bytearray(b"qoif" + grid.width.to_bytes(4, "big") + grid.height.to_bytes(4, "big") + bytes([4, 0]))
    seen, last, run = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    for pixel in map(tuple, grid.rgba.reshape(-1, 4).tolist()):
        if pixel == last:
            run += 1
            if run == 62:
                out.append(0xC0 | 61)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        place = (pixel[0] * 3 + pixel[1] * 5 + pixel[2] * 7 + pixel[3] * 11) % 64
        out += bytes([place]) if seen[place] == pixel else bytes([0xFF, *pixel])
        seen[place] = last = pixel
    if run:
        out.append(0xC0 | run - 1)
    return bytes(out + b"\0" * 7 + b"\1")


def _tga_colours(raw: np.ndarray, bits: int) -> np.ndarray:
    """RGBA of raw (n x bytes) entries of a map or picture."""
    out = np.full((len(raw), 4), 255, np.uint8)
    if bits == 16:
        v = raw[:, 0].astype(np.int64) | raw[:, 1].astype(np.int64) << 8
        for c, shift in enumerate((10, 5, 0)):
            out[:, c] = (v >> shift & 31) * 255 // 31
    else:
        out[:, :3] = raw[:, 2::-1]
        if bits == 32:
            out[:, 3] = raw[:, 3]
    return out


def decode_tga(data: bytes) -> Grid:
    """Types 1, 2, 3 and their run-length forms; rows from the bottom unless the header says otherwise."""
    if len(data) < 18:
        raise DecodeError("TGA file too small")
    id_size, has_map, kind, _, map_size, map_bits, _, _, w, h, bits, flags = unpack("<BBBHHBHHHHBB", data)
    if kind not in (1, 2, 3, 9, 10, 11):
        raise DecodeError(f"Unsupported TGA image type: {kind}")
    w, h = check_size(w, h)
    if kind % 8 == 2 and bits not in (24, 32) or kind % 8 != 2 and bits != 8:
        raise DecodeError(f"Unsupported TGA bit depth: {bits}")
    at, table = 18 + id_size, None
    if has_map:
        if map_bits not in (16, 24, 32):
            raise DecodeError(f"Unsupported TGA map depth: {map_bits}")
        size = map_size * map_bits // 8
        table = _tga_colours(padded(data[at:], size).reshape(map_size, -1), map_bits)
        at += size
    step, n = bits // 8, w * h
    if kind < 8:
        raw = padded(data[at:], n * step)
    else:
        parts, have = [], 0
        while have < n and at < len(data):
            count = (data[at] & 127) + 1
            if data[at] & 128:
                parts.append(data[at + 1 : at + 1 + step] * count)
                at += 1 + step
            else:
                parts.append(data[at + 1 : at + 1 + step * count])
                at += 1 + step * count
            have += count
        raw = padded(b"".join(parts), n * step)
    raw = raw.reshape(n, step)
    if kind % 8 == 1:
        if table is None:
            raise DecodeError("TGA without a colour map")
        index = raw[:, 0]
        out = np.zeros((n, 4), np.uint8)
        inside = index < len(table)
        out[inside] = table[index[inside]]
    elif kind % 8 == 3:
        out = gray(raw.reshape(h, w)).rgba.reshape(n, 4)
    else:
        out = _tga_colours(raw, bits)
    out = out.reshape(h, w, 4)
    return Grid(out if flags & 32 else np.ascontiguousarray(out[::-1]))


#: The 16 colours of the EGA.
EGA = [(0, 0, 0), (0, 0, 170), (0, 170, 0), (0, 170, 170), (170, 0, 0), (170, 0, 170), (170, 85, 0), (170, 170, 170), (85, 85, 85), (85, 85, 255), (85, 255, 85), (85, 255, 255), (255, 85, 85), (255, 85, 255), (255, 255, 85), (255, 255, 255)]


def decode_pcx(data: bytes) -> Grid:
    """8 bits in 3 or 4 planes, 8 bits with the palette at the end, 1 bit, and 4-bit EGA packed or in planes."""
    if len(data) < 128:
        raise DecodeError("PCX file too small")
    bits, x0, y0, x1, y1 = unpack("<BHHHH", data, 3)
    planes, stride = unpack("<BH", data, 65)
    w, h = check_size(x1 - x0 + 1, y1 - y0 + 1)
    size = stride * planes * h
    if data[2] == 1:
        out, at = bytearray(), 128
        while len(out) < size and at < len(data):
            b = data[at]
            at += 1
            if b >= 192:
                out += data[at : at + 1] * (b & 63)
                at += 1
            else:
                out.append(b)
        body = padded(bytes(out), size)
    else:
        body = padded(data[128:], size)
    rows = body.reshape(h, planes, stride)
    if bits == 8 and planes in (3, 4):
        return opaque(rows[:, :3, :w].transpose(0, 2, 1))
    if (bits, planes) == (8, 1):
        table = padded(data[-768:], 768).reshape(256, 3) if len(data) >= 769 and data[-769] == 12 else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
        return opaque(table[rows[:, 0, :w]])
    ega = np.frombuffer(data[16:64], np.uint8).reshape(16, 3)
    ega = ega if ega.any() else np.array(EGA, np.uint8)
    if (bits, planes) == (1, 1):
        return gray(bits_to_samples(rows[:, 0], 1, w) * 255)
    if (bits, planes) == (4, 1):
        return opaque(ega[bits_to_samples(rows[:, 0], 4, w)])
    if (bits, planes) == (1, 4):
        return opaque(ega[sum(bits_to_samples(rows[:, p], 1, w) << p for p in range(4))])
    raise DecodeError(f"Unsupported PCX format: {bits} bits, {planes} planes")


def decode_psd(data: bytes) -> Grid:
    """The merged picture: grey, RGB or CMYK, 8 or 16 bits, raw or PackBits."""
    if data[:4] != b"8BPS":
        raise DecodeError("Not a PSD file")
    channels, h, w, depth, mode = unpack(">HIIHH", data, 12)
    w, h = check_size(w, h)
    if depth not in (8, 16):
        raise DecodeError(f"Unsupported PSD depth: {depth}")
    if mode not in (1, 3, 4):
        raise DecodeError(f"Unsupported PSD colour mode: {mode}")
    at = 26
    for _ in range(3):
        at += 4 + unpack(">I", data, at)[0]
    (packing,) = unpack(">H", data, at)
    at += 2
    width = w * depth // 8
    if packing == 0:
        body = padded(data[at:], channels * h * width)
    elif packing == 1:
        at += 2 * channels * h
        parts = []
        for _ in range(channels * h):
            row, at = packbits(data, at, width)
            parts.append(row.ljust(width, b"\0"))
        body = np.frombuffer(b"".join(parts), np.uint8)
    else:
        raise DecodeError(f"Unsupported PSD compression: {packing}")
    planes = body.reshape(channels, h, w, depth // 8)[..., 0]
    needed = {1: 1, 3: 3, 4: 4}[mode]
    if channels < needed:
        raise DecodeError("Too few PSD channels")
    if mode == 1:
        out = gray(planes[0])
    elif mode == 3:
        out = opaque(planes[:3].transpose(1, 2, 0))
    else:
        ink = planes[:4] / 255.0
        out = opaque(half_up(255 * (1 - ink[:3]) * (1 - ink[3])).astype(np.uint8).transpose(1, 2, 0))
    if channels > needed:
        out.rgba[..., 3] = planes[needed]
    return out


def _expand565(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    return np.stack([half_up((v >> s & m) * 255.0 / m) for s, m in ((11, 31), (5, 63), (0, 31))], -1)


def _dxt_colours(words: np.ndarray, may_be_clear: bool) -> np.ndarray:
    """(blocks, 16, 4) colours of 8-byte colour blocks."""
    pair = words[:, :4].copy().view("<u2")
    ends = _expand565(pair)
    a, b = ends[:, 0], ends[:, 1]
    table = np.full((len(words), 4, 4), 255.0)
    table[:, 0, :3], table[:, 1, :3] = a, b
    table[:, 2, :3], table[:, 3, :3] = (a * 2 + b) / 3, (a + b * 2) / 3
    if may_be_clear:
        short = pair[:, 0] <= pair[:, 1]
        table[short, 2, :3] = ((a + b) / 2)[short]
        table[short, 3] = 0
    bits = words[:, 4:8].copy().view("<u4").astype(np.int64)
    index = bits >> np.arange(0, 32, 2) & 3
    return np.trunc(np.take_along_axis(table, index[:, :, None].repeat(4, 2), 1)).astype(np.uint8)


def _dxt5_alpha(words: np.ndarray) -> np.ndarray:
    a, b = words[:, 0].astype(np.float64), words[:, 1].astype(np.float64)
    table = np.zeros((len(words), 8))
    table[:, 0], table[:, 1] = a, b
    for i in range(1, 7):
        table[:, i + 1] = ((7 - i) * a + i * b) / 7
    short = a <= b
    for i in range(1, 5):
        table[short, i + 1] = (((5 - i) * a + i * b) / 5)[short]
    table[short, 6], table[short, 7] = 0, 255
    bits = sum(words[:, 2 + i].astype(np.int64) << 8 * i for i in range(6))
    index = bits[:, None] >> np.arange(0, 48, 3) & 7
    return np.trunc(np.take_along_axis(table, index, 1)).astype(np.uint8)


def decode_dds(data: bytes) -> Grid:
    """DXT1, DXT3, DXT5 and masked RGB(A); the first level only."""
    if data[:4] != b"DDS ":
        raise DecodeError("Not a DDS file")
    h, w = unpack("<II", data, 12)
    w, h = check_size(w, h)
    flags, name, bits, *masks = unpack("<I4sIIIII", data, 80)
    if flags & 4:
        if name not in (b"DXT1", b"DXT3", b"DXT5"):
            raise DecodeError(f"Unsupported DDS format: {name.decode('latin-1')}")
        across, down = (w + 3) // 4, (h + 3) // 4
        size = 8 if name == b"DXT1" else 16
        words = padded(data[128:], across * down * size).reshape(-1, size)
        block = _dxt_colours(words[:, -8:], name == b"DXT1")
        if name == b"DXT3":
            nibbles = np.stack((words[:, :8] & 15, words[:, :8] >> 4), 2).reshape(-1, 16)
            block[..., 3] = nibbles * 17
        elif name == b"DXT5":
            block[..., 3] = _dxt5_alpha(words)
        picture = block.reshape(down, across, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(down * 4, across * 4, 4)
        return Grid(np.ascontiguousarray(picture[:h, :w]))
    if not flags & 0x41 or bits not in (8, 16, 24, 32):
        raise DecodeError("Unsupported DDS pixel format")
    raw = padded(data[128:], w * h * bits // 8).reshape(-1, bits // 8).astype(np.int64)
    value = (raw << 8 * np.arange(bits // 8)).sum(1)
    out = np.full((w * h, 4), 255, np.uint8)
    for c, mask in enumerate(masks):
        if mask and (c < 3 or flags & 1):
            low = (mask & -mask).bit_length() - 1
            out[:, c] = half_up((value & mask) / (1 << low) * 255.0 / ((1 << mask.bit_count()) - 1))
    return Grid(out.reshape(h, w, 4))
