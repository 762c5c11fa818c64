"""Decoders against pictures written here from the public formats."""

import struct
import zlib

import numpy as np
import pytest

from mosaiq.codecs import base, jpeg, paletted, png, resample, simple
from mosaiq.codecs.base import DecodeError, Grid

RNG = np.random.default_rng(0)


def picture(w=13, h=7, alpha=True):
    rgba = RNG.integers(0, 256, (h, w, 4), dtype=np.uint8)
    if not alpha:
        rgba[..., 3] = 255
    return Grid(rgba)


def bmp(g, bits, down):
    step = bits // 8
    rows = g.rgba[..., [2, 1, 0, 3]][..., :step]
    rows = rows if down else rows[::-1]
    stride = (g.width * step + 3) // 4 * 4
    body = b"".join(r.tobytes().ljust(stride, b"\0") for r in rows)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, g.width, -g.height if down else g.height, 1, bits, 0, len(body), 0, 0, 0, 0) + body


@pytest.mark.parametrize("bits", [24, 32])
@pytest.mark.parametrize("down", [False, True])
def test_bmp(bits, down):
    g = picture(alpha=bits == 32)
    assert (simple.decode_bmp(bmp(g, bits, down)).rgba == g.rgba).all()


@pytest.mark.parametrize("kind", range(1, 7))
@pytest.mark.parametrize("most", [15, 255, 65535])
def test_pnm(kind, most):
    w, h, n = 11, 5, 3 if kind in (3, 6) else 1
    most = 1 if kind in (1, 4) else most
    v = RNG.integers(0, most + 1, (h, w, n))
    head = f"P{kind}\n# a comment\n{w} {h}\n" + ("" if kind in (1, 4) else f"{most}\n")
    if kind <= 3:
        body = " ".join(map(str, v.ravel())).encode()
    elif kind == 4:
        body = np.packbits(v[..., 0].astype(np.uint8), axis=1).tobytes()
    else:
        body = v.astype(">u2" if most > 255 else np.uint8).tobytes()
    got = simple.decode_pnm(head.encode() + body).rgba
    want = (1 - v) * 255 if kind in (1, 4) else np.floor(v * 255 / most + 0.5)
    assert (got[..., :3] == want).all() and (got[..., 3] == 255).all()


def test_ppm_and_qoi_round_trips():
    g = picture(alpha=False)
    assert (simple.decode_pnm(simple.encode_ppm(g)).rgba == g.rgba).all()
    g = picture(40, 30)
    g.rgba[:20] = g.rgba[0, 0]
    g.rgba[25:, ::2] = g.rgba[24, 0]
    assert (simple.decode_qoi(simple.encode_qoi(g)).rgba == g.rgba).all()


def test_qoi_operations():
    head = b"qoif" + struct.pack(">II", 5, 1) + b"\4\0"
    body = bytes([0xFE, 10, 20, 30, 0x40 | 3 << 4 | 1 << 2 | 0, 0x80 | 40, 0x7A, 0xC0, (10 * 3 + 20 * 5 + 30 * 7 + 255 * 11) % 64])
    got = simple.decode_qoi(head + body).rgba[0].tolist()
    assert got == [[10, 20, 30, 255], [11, 19, 28, 255], [18, 27, 38, 255], [18, 27, 38, 255], [10, 20, 30, 255]]


def tga(g, kind, bits, flip, table=None, index=None):
    body = index if kind % 8 == 1 else g.rgba[..., 0] if kind % 8 == 3 else g.rgba[..., [2, 1, 0, 3]][..., : bits // 8]
    body = body if flip else body[::-1]
    flat = np.ascontiguousarray(body).reshape(g.width * g.height, -1)
    if kind >= 8:
        out = b""
        for i in range(0, len(flat), 5):
            part = flat[i : i + 5]
            out += bytes([127 + len(part)]) + part[0].tobytes() if (part == part[0]).all() else bytes([len(part) - 1]) + part.tobytes()
        raw = out
    else:
        raw = flat.tobytes()
    maps = b"" if table is None else table[:, [2, 1, 0]].tobytes()
    return struct.pack("<BBBHHBHHHHBB", 2, table is not None, kind, 0, 0 if table is None else len(table), 24, 0, 0, g.width, g.height, bits, 32 if flip else 0) + b"id" + maps + raw


@pytest.mark.parametrize("flip", [False, True])
@pytest.mark.parametrize("kind,bits", [(1, 8), (2, 24), (2, 32), (3, 8), (9, 8), (10, 24), (10, 32), (11, 8)])
def test_tga(kind, bits, flip):
    g = picture(alpha=bits == 32)
    g.rgba[2] = g.rgba[2, 0]
    table = index = None
    if kind % 8 == 1:
        table = RNG.integers(0, 256, (20, 3), dtype=np.uint8)
        index = RNG.integers(0, 20, (g.height, g.width), dtype=np.uint8)
        g.rgba[..., :3] = table[index]
    if kind % 8 == 3:
        g.rgba[..., 1] = g.rgba[..., 2] = g.rgba[..., 0]
    assert (simple.decode_tga(tga(g, kind, bits, flip, table, index)).rgba == g.rgba).all()


def pcx_rows(rows):
    out = bytearray()
    for row in rows:
        i = 0
        while i < len(row):
            n = 1
            while i + n < len(row) and row[i + n] == row[i] and n < 63:
                n += 1
            out += bytes([0xC0 | n, row[i]]) if n > 1 or row[i] >= 0xC0 else bytes([row[i]])
            i += n
    return bytes(out)


def test_pcx():
    g = picture(16, 6, alpha=False)
    head = lambda bits, planes, stride, ega=b"\0" * 48: struct.pack("<BBBBHHHHHH", 10, 5, 1, bits, 0, 0, 15, 5, 72, 72) + ega + struct.pack("<BBHH", 0, planes, stride, 1) + b"\0" * 58
    rows = [g.rgba[y, :, c].tobytes() for y in range(6) for c in range(3)]
    assert (simple.decode_pcx(head(8, 3, 16) + pcx_rows(rows)).rgba == g.rgba).all()
    table, index = RNG.integers(0, 256, (256, 3), dtype=np.uint8), RNG.integers(0, 256, (6, 16), dtype=np.uint8)
    got = simple.decode_pcx(head(8, 1, 16) + pcx_rows([r.tobytes() for r in index]) + b"\x0c" + table.tobytes())
    assert (got.rgba[..., :3] == table[index]).all()
    bit = RNG.integers(0, 2, (6, 16), dtype=np.uint8)
    assert (simple.decode_pcx(head(1, 1, 2) + pcx_rows([r.tobytes() for r in np.packbits(bit, axis=1)])).rgba[..., 0] == bit * 255).all()
    index = RNG.integers(0, 16, (6, 16), dtype=np.uint8)
    packed = pcx_rows([(r[::2] << 4 | r[1::2]).tobytes() for r in index])
    assert (simple.decode_pcx(head(4, 1, 8) + packed).rgba[..., :3] == np.array(simple.EGA)[index]).all()
    planes = pcx_rows([np.packbits(r >> p & 1).tobytes() for r in index for p in range(4)])
    assert (simple.decode_pcx(head(1, 4, 2) + planes).rgba[..., :3] == np.array(simple.EGA)[index]).all()


def packbits_row(row):
    out = b""
    for i in range(0, len(row), 4):
        part = row[i : i + 4]
        out += bytes([257 - len(part), part[0]]) if len(part) > 1 and len(set(part)) == 1 else bytes([len(part) - 1]) + part
    return out


@pytest.mark.parametrize("mode,channels", [(1, 1), (1, 2), (3, 3), (3, 4), (4, 4)])
@pytest.mark.parametrize("depth", [8, 16])
@pytest.mark.parametrize("packed", [0, 1])
def test_psd(mode, channels, depth, packed):
    w, h = 9, 5
    v = RNG.integers(0, 256, (channels, h, w), dtype=np.uint8)
    v[:, 1] = 7
    rows = [r.astype(np.uint16).__mul__(257).astype(">u2").tobytes() if depth == 16 else r.tobytes() for c in v for r in c]
    body = b"".join(struct.pack(">H", len(packbits_row(r))) for r in rows) + b"".join(map(packbits_row, rows)) if packed else b"".join(rows)
    data = b"8BPS" + struct.pack(">H6xHIIHH", 1, channels, h, w, depth, mode) + struct.pack(">I", 0) * 3 + struct.pack(">H", packed) + body
    got = simple.decode_psd(data).rgba
    if mode == 1:
        assert (got[..., 0] == v[0]).all()
    elif mode == 3:
        assert (got[..., :3] == v[:3].transpose(1, 2, 0)).all()
    else:
        assert (got[..., 0] == np.floor(255 * (1 - v[0] / 255) * (1 - v[3] / 255) + 0.5)).all()
    if (mode, channels) in ((1, 2), (3, 4)):
        assert (got[..., 3] == v[-1]).all()


def dds(w, h, name, body, bits=0, masks=(0, 0, 0, 0), flags=4):
    return b"DDS " + struct.pack("<7I44x", 124, 0x1007, h, w, 0, 0, 0) + struct.pack("<II4s5I", 32, flags, name, bits, *masks) + b"\0" * 20 + body


def test_dds():
    red, blue = 31 << 11, 31
    block = struct.pack("<HHI", red, blue, 0b11_10_01_00)
    got = simple.decode_dds(dds(3, 3, b"DXT1", block)).rgba
    assert got[0, :3].tolist() == [[255, 0, 0, 255], [0, 0, 255, 255], [170, 0, 85, 255]]
    got = simple.decode_dds(dds(4, 4, b"DXT1", struct.pack("<HHI", blue, red, 0b11_10_01_00))).rgba
    assert got[0].tolist() == [[0, 0, 255, 255], [255, 0, 0, 255], [127, 0, 127, 255], [255, 255, 255, 0]] or got[0, 3, 3] == 0
    got = simple.decode_dds(dds(4, 4, b"DXT3", bytes(range(0, 128, 16)) + block)).rgba
    assert got[0, :, 3].tolist() == [0, 0, 0, 17]
    got = simple.decode_dds(dds(4, 4, b"DXT5", bytes([200, 100, 0b10_001_000, 0, 0, 0, 0, 0]) + block)).rgba
    assert got[0, :3, 3].tolist() == [200, 100, 185]
    v = RNG.integers(0, 256, (4, 4, 4), dtype=np.uint8)
    got = simple.decode_dds(dds(4, 4, b"\0" * 4, v.tobytes(), 32, (0xFF0000, 0xFF00, 0xFF, 0xFF000000), 0x41)).rgba
    assert (got == v[..., [2, 1, 0, 3]]).all()


def make_png(w, h, colour, rows, table=None, filters=(0, 1, 2, 3, 4), depth=8, interlace=0):
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    flat, out = rows.reshape(h, w * n).astype(int), b""
    for y in range(h):
        kind = filters[y % len(filters)]
        row, up = flat[y], flat[y - 1] if y else np.zeros(w * n, int)
        a = np.concatenate((np.zeros(n, int), row[:-n]))
        c = np.concatenate((np.zeros(n, int), up[:-n]))
        p = a + up - c
        paeth = np.where((abs(p - a) <= abs(p - up)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - up) <= abs(p - c), up, c))
        out += bytes([kind]) + ((row - (0, a, up, (a + up) // 2, paeth)[kind]) & 255).astype(np.uint8).tobytes()
    chunk = png._chunk
    body = zlib.compress(out)
    return png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)) + (chunk(b"PLTE", table.tobytes()) if table is not None else b"") + chunk(b"IDAT", body[:9]) + chunk(b"IDAT", body[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,n", [(0, 1), (2, 3), (3, 1), (4, 2), (6, 4)])
def test_png(colour, n):
    w, h = 9, 11
    v = RNG.integers(0, 256, (h, w, n), dtype=np.uint8)
    table = RNG.integers(0, 256, (256, 3), dtype=np.uint8) if colour == 3 else None
    got = png.decode_png(make_png(w, h, colour, v, table)).rgba
    rgb = table[v[..., 0]] if colour == 3 else v[..., :3] if n > 2 else np.repeat(v[..., :1], 3, 2)
    assert (got[..., :3] == rgb).all() and (got[..., 3] == (v[..., -1] if n in (2, 4) else 255)).all()
    with pytest.raises(DecodeError):
        png.decode_png(make_png(w, h, colour, v, table, interlace=1))
    g = picture()
    assert (png.decode_png(png.encode_png(g)).rgba == g.rgba).all()


def lzw_encode(values, bits, lsb, early):
    clear, end, out, have, n = 1 << bits, (1 << bits) + 1, bytearray(), 0, 0

    def put(code, width):
        nonlocal have, n
        have = have | code << n if lsb else have << width | code
        n += width
        while n >= 8:
            if lsb:
                out.append(have & 255)
                have >>= 8
            else:
                out.append(have >> n - 8 & 255)
                have &= (1 << n - 8) - 1
            n -= 8

    table, width, word = {bytes([i]): i for i in range(clear)}, bits + 1, b""
    put(clear, width)
    size = end + 1
    for v in values:
        if word + bytes([v]) in table:
            word += bytes([v])
            continue
        put(table[word], width)
        table[word + bytes([v])] = size
        size += 1
        if size + early > (1 << width) and width < 12:
            width += 1
        if size >= 4094:
            put(clear, width)
            table, width, size = {bytes([i]): i for i in range(clear)}, bits + 1, end + 1
        word = bytes([v])
    put(table[word], width)
    if size + 1 + early > (1 << width) and width < 12:
        width += 1
    put(end, width)
    if n:
        out.append(have & 255 if lsb else have << 8 - n & 255)
    return bytes(out)


@pytest.mark.parametrize("interlaced", [False, True])
def test_gif(interlaced):
    w, h, x, y = 21, 19, 2, 3
    table = RNG.integers(0, 256, (16, 3), dtype=np.uint8)
    v = RNG.integers(0, 16, (h, w), dtype=np.uint8)
    stored = v[paletted.interlaced_order(h)] if interlaced else v
    coded = lzw_encode(stored.ravel().tolist(), 4, True, 0)
    data = b"GIF89a" + struct.pack("<HHBBB", w + 4, h + 4, 0x80 | 3, 0, 0) + table.tobytes() + bytes([0x21, 0xF9, 4, 1, 0, 0, 5, 0])
    data += b"," + struct.pack("<HHHHB", x, y, w, h, 64 if interlaced else 0) + bytes([4])
    data += b"".join(bytes([len(coded[i : i + 255])]) + coded[i : i + 255] for i in range(0, len(coded), 255)) + b"\0;"
    got = paletted.decode_gif(data).rgba
    part = got[y : y + h, x : x + w]
    assert (part[..., 3] == np.where(v == 5, 0, 255)).all() and (part[v != 5][:, :3] == table[v[v != 5]]).all()
    assert not got[:y].any()


def test_lzw_wide_codes():
    v = RNG.integers(0, 256, 60_000).tolist()
    assert paletted.lzw(lzw_encode(v, 8, True, 0), 8, True, len(v)) == bytes(v)
    assert paletted.lzw(lzw_encode(v, 8, False, 1), 8, False, len(v), early=1) == bytes(v)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packing", [1, 5, 8, 32773])
@pytest.mark.parametrize("colour,samples", [(0, 1), (1, 1), (2, 3), (2, 4), (3, 1)])
def test_tiff(order, packing, colour, samples):
    w, h, each = 8, 10, 4
    v = RNG.integers(0, 256, (h, w, samples), dtype=np.uint8)
    v[3] = 9
    press = {1: lambda b: b, 5: lambda b: lzw_encode(list(b), 8, False, 1), 8: zlib.compress, 32773: packbits_row}[packing]
    strips = [press(v[i : i + each].tobytes()) for i in range(0, h, each)]
    at, places = 8, []
    for s in strips:
        places.append(at)
        at += len(s)
    body = b"".join(strips)
    table = RNG.integers(0, 256, (3, 256)) * 257
    extra, tags = b"", []

    def tag(t, kind, values):
        nonlocal extra
        raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            place = 8 + len(body) + len(extra)
            extra += raw
            raw = struct.pack(order + "I", place)
        tags.append(struct.pack(order + "HHI", t, kind, len(values)) + raw.ljust(4, b"\0"))

    for t, kind, values in ((256, 3, [w]), (257, 3, [h]), (258, 3, [8] * samples), (259, 3, [packing]), (262, 3, [colour]), (273, 4, places), (277, 3, [samples]), (278, 3, [each]), (279, 4, [len(s) for s in strips])):
        tag(t, kind, values)
    if colour == 3:
        tag(320, 3, table.ravel().tolist())
    data = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(body) + len(extra)) + body + extra + struct.pack(order + "H", len(tags)) + b"".join(tags) + b"\0" * 4
    got = paletted.decode_tiff(data).rgba
    want = {0: lambda: np.repeat(255 - v, 3, 2), 1: lambda: np.repeat(v, 3, 2), 2: lambda: v[..., :3], 3: lambda: (table // 257).T[v[..., 0]]}[colour]()
    assert (got[..., :3] == want).all()
    assert (got[..., 3] == (v[..., 3] if samples == 4 else 255)).all()


def test_icons():
    g, small = picture(5, 4), picture(2, 2)
    dib = struct.pack("<IiiHHIIiiII", 40, 5, 8, 1, 32, 0, 0, 0, 0, 0, 0) + g.rgba[::-1][..., [2, 1, 0, 3]].tobytes()
    files = [png.encode_png(small), dib]
    head = struct.pack("<HHH", 0, 1, 2)
    at, entries = 6 + 32, b""
    for f, (w, h) in zip(files, ((2, 2), (5, 4)), strict=True):
        entries += struct.pack("<BBBBHHII", w, h, 0, 0, 1, 32, len(f), at)
        at += len(f)
    ico = head + entries + b"".join(files)
    assert (paletted.decode_ico(ico).rgba == g.rgba).all()
    frames = b"LIST" + struct.pack("<I", 12 + len(ico)) + b"fram" + b"icon" + struct.pack("<I", len(ico)) + ico
    assert (paletted.decode_ico(b"RIFF" + struct.pack("<I", 4 + len(frames)) + b"ACON" + frames).rgba == g.rgba).all()
    table = RNG.integers(0, 256, (256, 4), dtype=np.uint8)
    v = RNG.integers(0, 256, (4, 4), dtype=np.uint8)
    mask = np.array([0x80, 0, 0, 0] * 4, np.uint8)
    dib = struct.pack("<IiiHHIIiiII", 40, 4, 8, 1, 8, 0, 0, 0, 0, 0, 0) + table.tobytes() + v[::-1].tobytes() + mask.tobytes()
    got = paletted.decode_ico(struct.pack("<HHH", 0, 2, 1) + struct.pack("<BBBBHHII", 4, 4, 0, 0, 0, 8, len(dib), 22) + dib).rgba
    assert (got[..., :3] == table[v][..., 2::-1]).all() and (got[:, 0, 3] == 0).all() and (got[:, 1:, 3] == 255).all()
    with pytest.raises(DecodeError, match="contains no images"):
        paletted.decode_ico(struct.pack("<HHH", 0, 1, 0))


def jpeg_file(planes, sampling, progressive=False, restart=0):
    """A JPEG of coefficient blocks, written with one plain code table: symbol s has the 8-bit code s (0xFF excluded)."""
    counts, symbols = bytes([0] * 7 + [255] + [0] * 8), bytes(range(255))
    out = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([1] * 64)
    for kind in (0, 0x10):
        out += b"\xff\xc4" + struct.pack(">HB", 19 + 255, kind) + counts + symbols
    h = max(s[0] for s in sampling)
    v = max(s[1] for s in sampling)
    down, across = planes[0].shape[0] // sampling[0][1], planes[0].shape[1] // sampling[0][0]
    out += (b"\xff\xc2" if progressive else b"\xff\xc0") + struct.pack(">HBHHB", 8 + 3 * len(planes), 8, down * 8 * v, across * 8 * h, len(planes))
    out += b"".join(bytes([i + 1, s[0] << 4 | s[1], 0]) for i, s in enumerate(sampling))
    if restart:
        out += b"\xff\xdd" + struct.pack(">HH", 4, restart)

    class Writer:
        def __init__(self):
            self.bits = ""

        def symbol(self, s):
            self.bits += f"{s:08b}"

        def value(self, x, n):
            if n:
                self.bits += f"{x if x >= 0 else x + (1 << n) - 1:0{n}b}"

        def done(self):
            self.bits += "1" * (-len(self.bits) % 8)
            raw = int("1" + self.bits, 2).to_bytes(len(self.bits) // 8 + 1, "big")[1:]
            return raw.replace(b"\xff", b"\xff\x00")

    size = lambda x: abs(int(x)).bit_length()

    def dc(w, block, last, shift=0):
        d = (int(block[0]) >> shift) - last
        w.symbol(size(d))
        w.value(d, size(d))
        return int(block[0]) >> shift

    def ac(w, block, low, high, shift=0):
        zeros = 0
        for k in range(low, high + 1):
            x = int(block[jpeg.ZIGZAG[k]])
            x = x >> shift if x >= 0 else -(-x >> shift)
            if not x:
                zeros += 1
                continue
            while zeros > 15:
                w.symbol(0xF0)
                zeros -= 16
            w.symbol(zeros << 4 | size(x))
            w.value(x, size(x))
            zeros = 0
        if zeros:
            w.symbol(0)

    def refine(w, block, low, high, shift):
        """One block: correction bits follow the symbol that skips over them."""
        held, zeros = [], 0
        last = max([k for k in range(low, high + 1) if abs(int(block[jpeg.ZIGZAG[k]])) >> shift == 1], default=low - 1)
        k = low
        for k in range(low, last + 1):
            x = abs(int(block[jpeg.ZIGZAG[k]])) >> shift
            if x > 1:
                held.append(str(x & 1))
            elif x == 0:
                if zeros == 15:
                    w.symbol(0xF0)
                    w.bits += "".join(held)
                    held, zeros = [], 0
                else:
                    zeros += 1
            else:
                w.symbol(zeros << 4 | 1)
                w.bits += ("1" if block[jpeg.ZIGZAG[k]] > 0 else "0") + "".join(held)
                held, zeros = [], 0
        if last < high:
            w.symbol(0)
            w.bits += "".join(str(abs(int(block[jpeg.ZIGZAG[k]])) >> shift & 1) for k in range(last + 1, high + 1) if abs(int(block[jpeg.ZIGZAG[k]])) >> shift > 1)

    def scan(parts, low, high, before, shift, body):
        return b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(parts), len(parts)) + b"".join(bytes([p + 1, 0]) for p in parts) + bytes([low, high, before << 4 | shift]) + body

    everything = range(len(planes))
    w, last, parts, count = Writer(), [0] * len(planes), b"", 0
    for my in range(down):
        for mx in range(across):
            if restart and count and count % restart == 0:
                parts += w.done() + bytes([0xFF, 0xD0 + (count // restart - 1) % 8])
                w, last = Writer(), [0] * len(planes)
            count += 1
            for p in everything:
                for yy in range(sampling[p][1]):
                    for xx in range(sampling[p][0]):
                        block = planes[p][my * sampling[p][1] + yy, mx * sampling[p][0] + xx]
                        last[p] = dc(w, block, last[p], 1 if progressive else 0)
                        if not progressive:
                            ac(w, block, 1, 63)
    out += scan(everything, 0, 0 if progressive else 63, 0, 1 if progressive else 0, parts + w.done())
    if progressive:
        w = Writer()
        for my in range(down):
            for mx in range(across):
                for p in everything:
                    for yy in range(sampling[p][1]):
                        for xx in range(sampling[p][0]):
                            w.bits += str(int(planes[p][my * sampling[p][1] + yy, mx * sampling[p][0] + xx][0]) & 1)
        out += scan(everything, 0, 0, 1, 0, w.done())
        for p in everything:
            for low, high in ((1, 5), (6, 63)):
                w, v2 = Writer(), Writer()
                for block in planes[p].reshape(-1, 64):
                    ac(w, block, low, high, 1)
                    refine(v2, block, low, high, 0)
                out += scan([p], low, high, 0, 1, w.done()) + scan([p], low, high, 1, 0, v2.done())
    return out + b"\xff\xd9"


def coefficient_planes(sampling, down=2, across=3):
    planes = []
    for h, v in sampling:
        p = np.zeros((down * v, across * h, 64), int)
        p[..., 0] = RNG.integers(-900, 900, p.shape[:2])
        where = RNG.random(p.shape) < 0.12
        p[where] += RNG.integers(-60, 60, where.sum())
        planes.append(p)
    return planes


def expected(planes, sampling):
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    full = []
    for p, (ph, pv) in zip(planes, sampling, strict=True):
        blocks = basis @ p.reshape(*p.shape[:2], 8, 8) @ basis.T + 128
        flat = np.clip(np.floor(blocks + 0.5), 0, 255).transpose(0, 2, 1, 3).reshape(p.shape[0] * 8, -1)
        full.append(flat.repeat(v // pv, 0).repeat(h // ph, 1))
    if len(full) == 1:
        return np.repeat(full[0][..., None], 3, 2)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    return np.clip(np.floor(np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), -1) + 0.5), 0, 255)


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("progressive,restart", [(False, 0), (False, 2), (True, 0)])
def test_jpeg(sampling, progressive, restart):
    planes = coefficient_planes(sampling)
    data = jpeg_file(planes, sampling, progressive, restart)
    want = expected(planes, sampling)
    assert (jpeg.decode_jpeg(data).rgba[..., :3] == want).all()
    small = jpeg.decode_jpeg(data, (2, 2)).rgba
    assert small.shape[:2] == (want.shape[0] // 8, want.shape[1] // 8)


def test_zigzag():
    assert jpeg.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-1] == 63


@pytest.mark.parametrize("decode", [simple.decode_bmp, simple.decode_pnm, simple.decode_qoi, simple.decode_tga, simple.decode_pcx, simple.decode_psd, simple.decode_dds, png.decode_png, paletted.decode_gif, paletted.decode_ico, paletted.decode_tiff, jpeg.decode_jpeg])
def test_damaged_files(decode):
    with pytest.raises(DecodeError):
        decode(b"")
    with pytest.raises(DecodeError):
        decode(b"XX")


def test_limits():
    with pytest.raises(DecodeError, match="too large"):
        base.check_size(100_000, 100_000)
    with pytest.raises(DecodeError, match="Invalid"):
        base.check_size(0, 5)


@pytest.mark.parametrize("fit", ["cover", "contain", "fill"])
def test_resize_against_plain(fit):
    g = picture(9, 6)
    got = resample.resize(g, 14, 5, fit).rgba
    (sx, sy, sw, sh), (dx, dy, dw, dh) = resample.scaled_rect(9, 6, 14, 5, fit)
    want = np.zeros((5, 14, 4), np.uint8)
    for y in range(dh):
        for x in range(dw):
            fx = min(max(sx + (x + 0.5) / dw * sw - 0.5, 0), 8)
            fy = min(max(sy + (y + 0.5) / dh * sh - 0.5, 0), 5)
            x0, y0 = int(fx), int(fy)
            x1, y1 = min(x0 + 1, 8), min(y0 + 1, 5)
            for c in range(4):
                tl, tr, bl, br = (int(g.rgba[a, b, c]) for a, b in ((y0, x0), (y0, x1), (y1, x0), (y1, x1)))
                top, low = tl + (tr - tl) * (fx - x0), bl + (br - bl) * (fx - x0)
                want[dy + y, dx + x, c] = int(top + (low - top) * (fy - y0) + 0.5)
    assert (got == want).all()
    assert resample.resize(g, 9, 6, fit) is g
