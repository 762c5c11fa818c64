"""Glyph metrics and outlines. No font comes with the library: give one as a TrueType file, or every character is a hollow
box of the width that a missing glyph has."""

from __future__ import annotations

import os
import struct
from functools import lru_cache

from mosaiq.operators.limits import MAX_CMAP_ENTRIES
from mosaiq.vector.paths import Path

MISSING_WIDTH = 500
FONT_VARIABLE = "MOSAIQ_FONT"


@lru_cache(1)
def missing_glyph() -> Path:
    path = Path()
    for inset in (0, 40):
        path.rect(100 + inset, inset, 360 - 2 * inset, 700 - 2 * inset)
    return path


class Font:
    """Widths in thousandths, outlines in thousandths with y upwards."""

    def width(self, cp: int) -> int:
        return MISSING_WIDTH

    def outline(self, cp: int) -> Path:
        return missing_glyph()


class TrueType(Font):
    def __init__(self, data: bytes):
        self.data = data
        count = struct.unpack_from(">H", data, 4)[0]
        self.tables = {tag: (at, size) for tag, _, at, size in (struct.unpack_from(">4sIII", data, 12 + 16 * i) for i in range(count))}
        head = self._at(b"head")
        self.scale = 1000 / (struct.unpack_from(">H", data, head + 18)[0] or 1000)
        self.long_places = struct.unpack_from(">h", data, head + 50)[0] == 1
        self.metrics = struct.unpack_from(">H", data, self._at(b"hhea") + 34)[0]
        self.glyphs = self._characters()
        self.kept: dict[int, Path] = {}

    def _at(self, tag: bytes) -> int:
        if tag not in self.tables:
            raise ValueError(f"Missing font table {tag.decode()}")
        return self.tables[tag][0]

    def _characters(self) -> dict[int, int]:
        base, best = self._at(b"cmap"), {}
        for i in range(struct.unpack_from(">H", self.data, base + 2)[0]):
            platform, kind, place = struct.unpack_from(">HHI", self.data, base + 4 + 8 * i)
            form = struct.unpack_from(">H", self.data, base + place)[0]
            if platform in (0, 3) and form in (4, 12):
                best.setdefault(form, base + place)
        out: dict[int, int] = {}
        if 12 in best:
            at = best[12]
            for i in range(struct.unpack_from(">I", self.data, at + 12)[0]):
                first, last, glyph = struct.unpack_from(">III", self.data, at + 16 + 12 * i)
                for cp in range(first, min(last, first + MAX_CMAP_ENTRIES - len(out)) + 1):
                    out[cp] = glyph + cp - first
        elif 4 in best:
            at = best[4]
            n = struct.unpack_from(">H", self.data, at + 6)[0] // 2
            read = lambda k: struct.unpack_from(f">{n}H", self.data, at + k)
            ends, starts, deltas, places = read(14), read(16 + 2 * n), read(16 + 4 * n), read(16 + 6 * n)
            for i in range(n):
                for cp in range(starts[i], ends[i] + 1):
                    if cp == 0xFFFF:
                        continue
                    if places[i]:
                        spot = at + 16 + 6 * n + 2 * i + places[i] + 2 * (cp - starts[i])
                        glyph = struct.unpack_from(">H", self.data, spot)[0] if spot + 2 <= len(self.data) else 0
                        glyph = (glyph + deltas[i]) & 0xFFFF if glyph else 0
                    else:
                        glyph = (cp + deltas[i]) & 0xFFFF
                    if glyph:
                        out[cp] = glyph
        return out

    def width(self, cp: int) -> int:
        glyph = self.glyphs.get(cp)
        if glyph is None:
            return MISSING_WIDTH
        at = self._at(b"hmtx") + 4 * min(glyph, self.metrics - 1)
        return int(struct.unpack_from(">H", self.data, at)[0] * self.scale + 0.5)

    def outline(self, cp: int) -> Path:
        glyph = self.glyphs.get(cp)
        if glyph is None:
            return missing_glyph()
        if glyph not in self.kept:
            path = Path()
            for contour in self._contours(glyph, 0):
                _trace(path, contour, self.scale)
            self.kept[glyph] = path
        return self.kept[glyph]

    def _contours(self, glyph: int, depth: int) -> list[list[tuple[float, float, bool]]]:
        """Points (x, y, on the curve) of a glyph; compound ones put their parts together."""
        d, loca = self.data, self._at(b"loca")
        begin, end = struct.unpack_from(">II", d, loca + 4 * glyph) if self.long_places else (2 * v for v in struct.unpack_from(">HH", d, loca + 2 * glyph))
        if begin == end or depth > 10:
            return []
        at = self._at(b"glyf") + begin
        n = struct.unpack_from(">h", d, at)[0]
        at += 10
        if n < 0:
            out, more = [], True
            while more:
                flags, part = struct.unpack_from(">HH", d, at)
                at += 4
                dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", d, at)
                at += 4 if flags & 1 else 2
                a, b, c, e = 1.0, 0.0, 0.0, 1.0
                fixed = lambda k: [v / 16384 for v in struct.unpack_from(f">{k}h", d, at)]  # noqa: B023, E731
                if flags & 8:
                    (a,), at = fixed(1), at + 2
                    e = a
                elif flags & 64:
                    (a, e), at = fixed(2), at + 4
                elif flags & 128:
                    (a, b, c, e), at = fixed(4), at + 8
                if not flags & 2:
                    dx = dy = 0
                out += [[(x * a + y * c + dx, x * b + y * e + dy, on) for x, y, on in contour] for contour in self._contours(part, depth + 1)]
                more = bool(flags & 32)
            return out
        ends = struct.unpack_from(f">{n}H", d, at)
        total = ends[-1] + 1 if n else 0
        at += 2 * n
        at += 2 + struct.unpack_from(">H", d, at)[0]
        flags: list[int] = []
        while len(flags) < total:
            flag = d[at]
            at += 1
            flags.append(flag)
            if flag & 8:
                flags += [flag] * d[at]
                at += 1
        axes = []
        for short, same in ((2, 16), (4, 32)):
            v, values = 0, []
            for flag in flags[:total]:
                if flag & short:
                    v += d[at] if flag & same else -d[at]
                    at += 1
                elif not flag & same:
                    v += struct.unpack_from(">h", d, at)[0]
                    at += 2
                values.append(v)
            axes.append(values)
        points = [(x, y, bool(f & 1)) for x, y, f in zip(*axes, flags, strict=False)]
        return [points[a:b] for a, b in zip((0, *(e + 1 for e in ends)), (e + 1 for e in ends), strict=False)]


def _trace(path: Path, contour: list[tuple[float, float, bool]], scale: float) -> None:
    """Quadratic contour: between two points off the curve there is one on it."""
    full = []
    for (x, y, on), (px, py, was) in zip(contour, contour[-1:] + contour[:-1], strict=True):
        if not on and not was:
            full.append(((x + px) / 2 * scale, (y + py) / 2 * scale, True))
        full.append((x * scale, y * scale, on))
    first = next((i for i, p in enumerate(full) if p[2]), None)
    if first is None:
        return
    full = full[first:] + full[: first + 1]
    path.move(*full[0][:2])
    held = None
    for x, y, on in full[1:]:
        if not on:
            held = (x, y)
        elif held:
            path.quad(*held, x, y)
            held = None
        else:
            path.line(x, y)
    path.close()


@lru_cache(4)
def load_font(path: str | None = None) -> Font:
    """The TrueType font at path (by default the environment's MOSAIQ_FONT), or boxes."""
    path = path or os.environ.get(FONT_VARIABLE)
    if not path:
        return Font()
    with open(path, "rb") as f:
        return TrueType(f.read())


def measure(text: str, size: float, bold: bool = False, font: Font | None = None) -> float:
    font = font or load_font()
    return sum(font.width(ord(c)) for c in text) * size / 1000 * (1.05 if bold else 1)
