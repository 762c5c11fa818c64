"""A canvas of RGBA bytes. Filling enumerates the lines that each edge crosses, sorts the crossings of all lines at once and
turns winding sums into spans; no edge is looked at for lines that it doesn't cross."""

from __future__ import annotations

import math

import numpy as np

from mosaiq.codecs.base import Grid, check_size, half_up
from mosaiq.vector.font import Font, load_font
from mosaiq.vector.paths import IDENTITY, Matrix, Path, mean_scale

Color = tuple[int, int, int, int]


class Canvas:
    def __init__(self, width: float, height: float, background: Color = (255, 255, 255, 255)):
        w, h = check_size(math.floor(width + 0.5), math.floor(height + 0.5))
        self.px = np.empty((h, w, 4), np.uint8)
        self.px[:] = background

    def grid(self) -> Grid:
        return Grid(self.px)

    def _blend(self, rows: np.ndarray, cols: np.ndarray, color) -> None:
        """Paint pixels with one colour, or with one each (n x 4)."""
        color = np.asarray(color, np.float64)
        if color.ndim == 1:
            if color[3] <= 0:
                return
            if color[3] >= 255:
                self.px[rows, cols] = color.astype(np.uint8)
                return
            color = np.broadcast_to(color, (len(rows), 4))
        under = self.px[rows, cols].astype(np.float64)
        a = color[:, 3:] / 255
        out = np.empty_like(under)
        out[:, :3] = half_up(color[:, :3] * a + under[:, :3] * (1 - a))
        out[:, 3] = np.minimum(255, half_up(color[:, 3] + under[:, 3] * (1 - a[:, 0])))
        self.px[rows, cols] = out.astype(np.uint8)

    def rect(self, x: float, y: float, w: float, h: float, color: Color) -> None:
        """Axis-aligned rectangle, its last row and column included; overwrites."""
        height, width = self.px.shape[:2]
        x0, y0, x1, y1 = max(0, math.floor(x)), max(0, math.floor(y)), min(width - 1, math.floor(x + w)), min(height - 1, math.floor(y + h))
        if x0 <= x1 and y0 <= y1:
            self.px[y0 : y1 + 1, x0 : x1 + 1] = color

    def polygons(self, lines: list[list[tuple[float, float]]], color: Color, even_odd: bool = False) -> None:
        """Fill closed polylines, sampling at line centres, without anti-aliasing."""
        if color[3] <= 0:
            return
        height, width = self.px.shape[:2]
        a = [p for line in lines if len(line) > 1 for p in line]
        b = [p for line in lines if len(line) > 1 for p in (*line[1:], line[0])]
        if not a:
            return
        a, b = np.array(a, np.float64), np.array(b, np.float64)
        ok = np.isfinite(a).all(1) & np.isfinite(b).all(1) & (np.abs(b[:, 1] - a[:, 1]) >= 0.001)
        a, b = a[ok], b[ok]
        if not len(a):
            return
        down = b[:, 1] > a[:, 1]
        top, low = np.where(down[:, None], a, b), np.where(down[:, None], b, a)
        slope = (low[:, 0] - top[:, 0]) / (low[:, 1] - top[:, 1])
        first = np.clip(np.ceil(top[:, 1] - 0.5), 0, height).astype(np.int64)
        count = np.maximum(0, np.clip(np.ceil(low[:, 1] - 0.5), 0, height).astype(np.int64) - first)
        edge = np.repeat(np.arange(len(a)), count)
        if not len(edge):
            return
        line = first[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count)
        x = top[edge, 0] + (line + 0.5 - top[edge, 1]) * slope[edge]
        order = np.lexsort((edge, x, line))
        line, x, turn = line[order], x[order], np.where(down[edge[order]], 1, -1)
        start = np.concatenate(([True], line[1:] != line[:-1]))
        base = np.maximum.accumulate(np.where(start, np.arange(len(line)), 0))
        if even_odd:
            opens = (np.arange(len(line)) - base) % 2 == 0
            shuts = ~opens
        else:
            total = np.cumsum(turn)
            total = total - (total - turn)[base]
            opens, shuts = (total - turn == 0) & (total != 0), total == 0
        i = np.flatnonzero(opens)
        j = np.flatnonzero(shuts)
        if len(i) != len(j):  # an odd number of crossings leaves its last span open
            keep = np.searchsorted(j, i)
            good = keep < len(j)
            good[good] &= line[j[keep[good]]] == line[i[good]]
            i, j = i[good], j[keep[good]]
        x0, x1 = np.maximum(0, np.floor(x[i])).astype(np.int64), np.minimum(width - 1, np.floor(x[j])).astype(np.int64)
        good = x0 <= x1
        x0, x1, rows = x0[good], x1[good], line[i][good]
        n = x1 - x0 + 1
        cols = np.repeat(x0, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows = np.repeat(rows, n)
        if color[3] < 255 and len(rows):  # spans that share a pixel paint it once each
            _, nth = np.unique(rows * width + cols, return_index=True)
            rest = np.setdiff1d(np.arange(len(rows)), nth, assume_unique=True)
            self._blend(rows[nth], cols[nth], color)
            rows, cols = rows[rest], cols[rest]
        self._blend(rows, cols, color)

    def fill(self, path: Path, color: Color, m: Matrix = IDENTITY, even_odd: bool = False) -> None:
        self.polygons([points for points, _ in path.flat(m)], color, even_odd)

    def stroke(self, path: Path, color: Color, width: float, m: Matrix = IDENTITY) -> None:
        """A rectangle for each segment; no caps, joins or dashes."""
        half = max(0.5, width * mean_scale(m) / 2)
        for points, closed in path.flat(m):
            for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1] if closed else points[1:], strict=False):
                length = math.hypot(x1 - x0, y1 - y0)
                if length >= 0.001 and math.isfinite(length):
                    nx, ny = -(y1 - y0) / length * half, (x1 - x0) / length * half
                    self.polygons([[(x0 + nx, y0 + ny), (x1 + nx, y1 + ny), (x1 - nx, y1 - ny), (x0 - nx, y0 - ny)]], color)

    def line(self, x0: float, y0: float, x1: float, y1: float, color: Color, width: float) -> None:
        path = Path()
        path.move(x0, y0)
        path.line(x1, y1)
        self.stroke(path, color, width)

    def text(self, text: str, x: float, baseline: float, size: float, color: Color, bold: bool = False, scale: float = 1.0, font: Font | None = None) -> float:
        """Glyphs from x on; returns where they end."""
        font = font or load_font()
        unit, wide = size * scale / 1000, 1.05 if bold else 1.0
        for c in text:
            cp = ord(c)
            if cp not in (9, 32):
                self.fill(font.outline(cp), color, (unit * wide, 0, 0, -unit, x, baseline))
            x += font.width(cp) * unit * wide
        return x

    def image(self, grid: Grid, x: float, y: float, w: float, h: float) -> None:
        """A picture on a rectangle, by the nearest pixel."""
        dx, dy, dw, dh = (math.floor(v + 0.5) for v in (x, y, w, h))
        height, width = self.px.shape[:2]
        xs, ys = np.arange(max(0, dx), min(width, dx + dw)), np.arange(max(0, dy), min(height, dy + dh))
        if not len(xs) or not len(ys):
            return
        sx, sy = ((xs - dx) * grid.width // dw).astype(np.int64), ((ys - dy) * grid.height // dh).astype(np.int64)
        part = grid.rgba[np.ix_(sy, sx)].reshape(-1, 4)
        rows, cols = np.repeat(ys, len(xs)), np.tile(xs, len(ys))
        seen = part[:, 3] > 0
        self._blend(rows[seen], cols[seen], part[seen])

    def image_in(self, grid: Grid, m: Matrix) -> None:
        """A picture on the image of the unit square, its lower edge at v = 0."""
        det = m[0] * m[3] - m[1] * m[2]
        if abs(det) < 1e-10:
            return
        height, width = self.px.shape[:2]
        xs, ys = [m[4] + a * m[0] + b * m[2] for a in (0, 1) for b in (0, 1)], [m[5] + a * m[1] + b * m[3] for a in (0, 1) for b in (0, 1)]
        if not all(map(math.isfinite, xs + ys)):
            return
        x0, y0, x1, y1 = max(0, math.floor(min(xs))), max(0, math.floor(min(ys))), min(width - 1, math.ceil(max(xs))), min(height - 1, math.ceil(max(ys)))
        if x0 > x1 or y0 > y1:
            return
        cols, rows = (v.ravel() for v in np.meshgrid(np.arange(x0, x1 + 1), np.arange(y0, y1 + 1)))
        px, py = cols + 0.5 - m[4], rows + 0.5 - m[5]
        u, v = (px * m[3] - py * m[2]) / det, (py * m[0] - px * m[1]) / det
        inside = (u >= 0) & (u < 1) & (v >= 0) & (v < 1)
        rows, cols, u, v = rows[inside], cols[inside], u[inside], v[inside]
        sx = np.floor(u * grid.width).astype(np.int64)
        sy = np.minimum(grid.height - 1, np.floor((1 - v) * grid.height).astype(np.int64))
        self._blend(rows, cols, grid.rgba[sy, sx])
