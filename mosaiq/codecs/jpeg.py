"""JPEG: baseline and progressive, 8 bits, any sampling, restart intervals.

Entropy decoding is a serial walk over bits and fills an array of coefficients for each component; everything after it
(dequantisation, inverse transform, upsampling by repetition, BT.601) is done for all blocks at once. If the picture
of block averages is at least as large as what is asked for, only the DC coefficients are decoded.
"""

from __future__ import annotations

import numpy as np

from mosaiq.codecs.base import DecodeError, Grid, check_size, gray, half_up, opaque, unpack

#: Places of the coefficients in a block, along the diagonals.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _basis() -> np.ndarray:
    k = np.arange(8)
    m = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) / 2
    m[:, 0] /= np.sqrt(2)
    return m


class _Bits:
    """Bits of one restart interval, with stuffed bytes taken out; zeros past the end."""

    def __init__(self, data: bytes):
        raw = data.replace(b"\xff\x00", b"\xff")
        self.value, self.left, self.at, self.raw = 0, 0, 0, raw

    def need(self, n: int) -> None:
        while self.left < n:
            part = self.raw[self.at : self.at + 8]
            self.at += 8
            self.value = self.value << 64 | int.from_bytes(part.ljust(8, b"\0"), "big")
            self.left += 64

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.left -= n
        out = self.value >> self.left
        self.value &= (1 << self.left) - 1
        return out

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        self.need(16)
        size, value = table[0][self.value >> self.left - 16], table[1][self.value >> self.left - 16]
        if not size:
            raise DecodeError("Invalid JPEG code")
        self.left -= size
        self.value &= (1 << self.left) - 1
        return value


def _table(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """Length and symbol for each 16-bit prefix."""
    sizes, values, at = [], [], 0
    for n, count in enumerate(counts, 1):
        for s in symbols[at : at + count]:
            sizes += [n] * (1 << 16 - n)
            values += [s] * (1 << 16 - n)
        at += count
    rest = (1 << 16) - len(sizes)
    return (sizes + [0] * rest)[: 1 << 16], (values + [0] * rest)[: 1 << 16]


class _Component:
    def __init__(self, name: int, h: int, v: int, quant: int):
        self.name, self.h, self.v, self.quant = name, h, v, quant
        self.across = self.down = self.wide = self.high = 0
        self.blocks: np.ndarray | None = None
        self.last = 0


class _Decoder:
    def __init__(self, data: bytes, target: tuple[int, int] | None):
        self.data, self.target = data, target
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], tuple] = {}
        self.parts: list[_Component] = []
        self.interval, self.progressive, self.dc_only = 0, False, False
        self.w = self.h = 0

    def frame(self, body: bytes) -> None:
        depth, self.h, self.w, n = unpack(">BHHB", body)
        if depth != 8:
            raise DecodeError("Unsupported JPEG precision")
        check_size(self.w, self.h)
        for i in range(n):
            name, both, quant = unpack("BBB", body, 6 + 3 * i)
            self.parts.append(_Component(name, both >> 4 or 1, both & 15 or 1, quant))
        if not self.parts:
            raise DecodeError("JPEG without components")
        self.max_h, self.max_v = max(c.h for c in self.parts), max(c.v for c in self.parts)
        self.across, self.down = -(-self.w // (8 * self.max_h)), -(-self.h // (8 * self.max_v))
        if self.target:
            self.dc_only = self.across * self.max_h >= self.target[0] and self.down * self.max_v >= self.target[1]
        for c in self.parts:
            c.across, c.down = self.across * c.h, self.down * c.v
            c.wide, c.high = -(-(-(-self.w * c.h // self.max_h)) // 8), -(-(-(-self.h * c.v // self.max_v)) // 8)
            c.blocks = np.zeros((c.down * c.across, 64), np.int32)

    def scan(self, body: bytes, at: int) -> int:
        """Decode one scan whose data begin at `at`; where the next marker is."""
        n = body[0]
        chosen = []
        for i in range(n):
            part = next((c for c in self.parts if c.name == body[1 + 2 * i]), None)
            if part is None:
                raise DecodeError("JPEG scan of an unknown component")
            chosen.append((part, body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15))
        low, high, both = body[1 + 2 * n : 4 + 2 * n]
        before, shift = both >> 4, both & 15
        pieces, begin, end = [], at, at
        data = self.data
        while True:
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                end = len(data)
                break
            mark = data[end + 1]
            if mark == 0:
                end += 2
            elif 0xD0 <= mark <= 0xD7:
                pieces.append(data[begin:end])
                end += 2
                begin = end
            elif mark == 0xFF:
                end += 1
            else:
                break
        pieces.append(data[begin:end])
        if self.dc_only and low > 0:
            return end
        single = len(chosen) == 1
        part = chosen[0][0]
        units = part.wide * part.high if single else self.across * self.down
        step, unit = self.interval or units, 0
        for piece in pieces:
            bits, run = _Bits(piece), [0]
            for c, _, _ in chosen:
                c.last = 0
            try:
                for unit in range(unit, min(units, unit + step)):
                    if single:
                        self._block(bits, part, chosen[0][1], chosen[0][2], unit // part.wide * part.across + unit % part.wide, low, high, before, shift, run)
                        continue
                    y, x = divmod(unit, self.across)
                    for c, dc, ac in chosen:
                        for v in range(c.v):
                            for h in range(c.h):
                                self._block(bits, c, dc, ac, (y * c.v + v) * c.across + x * c.h + h, low, high, before, shift, run)
            except IndexError:
                raise DecodeError("Damaged JPEG data") from None
            unit += 1
            if unit >= units:
                break
        return end

    def _code(self, kind: int, place: int) -> tuple:
        if (kind, place) not in self.codes:
            raise DecodeError("JPEG without a code table")
        return self.codes[kind, place]

    def _block(self, bits, c, dc, ac, at, low, high, before, shift, run) -> None:
        row = c.blocks[at]
        if not self.progressive:
            c.last += bits.signed(bits.symbol(self._code(0, dc)))
            row[0] = c.last
            table, k = self._code(1, ac), 1
            while k < 64:
                both = bits.symbol(table)
                if not both & 15:
                    if both != 0xF0:
                        break
                    k += 16
                    continue
                k += both >> 4
                row[ZIGZAG[k]] = bits.signed(both & 15)
                k += 1
            return
        if low == 0:
            if before == 0:
                c.last += bits.signed(bits.symbol(self._code(0, dc)))
                row[0] = c.last << shift
            elif bits.take(1):
                row[0] |= 1 << shift
            return
        if before == 0:
            if run[0]:
                run[0] -= 1
                return
            table, k = self._code(1, ac), low
            while k <= high:
                both = bits.symbol(table)
                zeros, size = both >> 4, both & 15
                if size:
                    k += zeros
                    row[ZIGZAG[k]] = bits.signed(size) * (1 << shift)
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    run[0] = (1 << zeros) + bits.take(zeros) - 1
                    return
            return
        one, k = 1 << shift, low

        def refine(place: int) -> None:
            if bits.take(1) and not abs(int(row[place])) & one:
                row[place] += one if row[place] > 0 else -one

        if not run[0]:
            table = self._code(1, ac)
            while k <= high:
                both = bits.symbol(table)
                zeros, size = both >> 4, both & 15
                value = 0
                if size:
                    value = one if bits.take(1) else -one
                elif zeros < 15:
                    run[0] = (1 << zeros) + bits.take(zeros)
                    break
                while k <= high:
                    place = ZIGZAG[k]
                    k += 1
                    if row[place]:
                        refine(place)
                    elif zeros:
                        zeros -= 1
                    else:
                        row[place] = value
                        break
        if run[0]:
            for k in range(k, high + 1):
                if row[ZIGZAG[k]]:
                    refine(ZIGZAG[k])
            run[0] -= 1

    def picture(self) -> Grid:
        planes, basis = [], _basis()
        for c in self.parts:
            if c.quant not in self.quant:
                raise DecodeError("JPEG without a quantisation table")
            table = self.quant[c.quant]
            if self.dc_only:
                plane = (c.blocks[:, 0] * (table[0] * 0.125) + 128).reshape(c.down, c.across)
            else:
                block = (c.blocks * table).reshape(-1, 8, 8)
                block = basis @ block @ basis.T + 128
                plane = block.reshape(c.down, c.across, 8, 8).transpose(0, 2, 1, 3).reshape(c.down * 8, c.across * 8)
            plane = np.clip(half_up(plane), 0, 255)
            size = 1 if self.dc_only else 8
            h, w = self.down * self.max_v * size, self.across * self.max_h * size
            y, x = np.arange(h) * c.v // self.max_v, np.arange(w) * c.h // self.max_h
            planes.append(plane[np.ix_(y, x)])
        if not self.dc_only:
            planes = [p[: self.h, : self.w] for p in planes]
        if len(planes) < 3:
            return gray(planes[0].astype(np.uint8))
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), -1)
        return opaque(np.clip(half_up(rgb), 0, 255).astype(np.uint8))


def decode_jpeg(data: bytes, target: tuple[int, int] | None = None) -> Grid:
    """target: width and height that will do; then the picture may be one pixel a block."""
    if data[:2] != b"\xff\xd8":
        raise DecodeError("Not a JPEG file")
    d, at, seen = _Decoder(data, target), 2, False
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark in (0xFF, 0, 1) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if mark == 0xD9:
            break
        size = unpack(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                values = np.frombuffer(body[k + 1 : k + 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.float64)
                if len(values) < 64:
                    break
                table = np.zeros(64)
                table[ZIGZAG] = values
                d.quant[body[k] & 15] = table
                k += 1 + 64 * (1 + wide)
        elif mark == 0xC4:
            k = 0
            while k + 17 <= len(body):
                n = sum(body[k + 1 : k + 17])
                d.codes[body[k] >> 4, body[k] & 15] = _table(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif mark in (0xC0, 0xC2):
            d.progressive = mark == 0xC2
            d.frame(body)
        elif 0xC1 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise DecodeError("Unsupported JPEG kind")
        elif mark == 0xDD:
            d.interval = unpack(">H", body)[0]
        elif mark == 0xDA:
            if not d.parts:
                raise DecodeError("JPEG scan before its frame")
            at, seen = d.scan(body, at), True
    if not seen:
        raise DecodeError("JPEG without a scan")
    return d.picture()
