"""A sheet and its drawing: grid, fills, borders, texts, pictures, charts, in that order, on a landscape page."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

from mosaiq.codecs.base import Grid
from mosaiq.formats.csv import truncate
from mosaiq.vector.canvas import Canvas
from mosaiq.vector.font import load_font, measure
from mosaiq.vector.paths import Path, arc

PAGE, LONGEST, PAD = (842.0, 595.0), 1024.0, 2.0
DEFAULT_CHARS, DEFAULT_HEIGHT = 8.43, 15.0
#: Indexed colours of spreadsheets.
INDEXED = (
    "000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF 000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF "
    "800000 008000 000080 808000 800080 008080 C0C0C0 808080 9999FF 993366 FFFFCC CCFFFF 660066 FF8080 0066CC CCCCFF "
    "000080 FF00FF FFFF00 00FFFF 800080 800000 008080 0000FF 00CCFF CCFFFF CCFFCC FFFF99 99CCFF FF99CC CC99FF FFCC99 "
    "3366FF 33CCCC 99CC00 FFCC00 FF9900 FF6600 666699 969696 003366 339966 003300 333300 993300 993366 333399 333333"
).split()
#: Slice and series colours where a chart names none.
SERIES = ("4472C4", "ED7D31", "A5A5A5", "FFC000", "5B9BD5", "70AD47")


@dataclass
class CellStyle:
    size: float = 11.0
    bold: bool = False
    color: str | None = None
    fill: str | None = None
    borders: dict[str, tuple[str, str | None]] = field(default_factory=dict)  # side to (style, colour)
    align: str = "general"
    number_format: int = 0
    code: str = ""


@dataclass
class Cell:
    row: int
    col: int
    value: str
    numeric: bool = False
    style: int = 0


@dataclass
class Chart:
    kind: str
    series: list[list[float]]
    colors: list[str]
    box: tuple[float, float, float, float] = (0, 0, 0, 0)


@dataclass
class Sheet:
    cells: list[Cell] = field(default_factory=list)
    styles: list[CellStyle] = field(default_factory=list)
    widths: list[tuple[int, int, float, bool]] = field(default_factory=list)  # first, last, points, hidden
    heights: dict[int, tuple[float | None, bool]] = field(default_factory=dict)
    merges: list[tuple[int, int, int, int]] = field(default_factory=list)  # first row, first column, last row, last column
    default_width: float = DEFAULT_CHARS * 7 + 5
    default_height: float = DEFAULT_HEIGHT
    images: list[tuple[tuple, Grid]] = field(default_factory=list)  # anchor (col, dx, row, dy, col2, dx2, row2, dy2 or None)
    charts: list[tuple[tuple, Chart]] = field(default_factory=list)


def rgb(text: str | None, default=(0, 0, 0)) -> tuple[int, int, int, int]:
    if not text or not re.match(r"[0-9A-Fa-f]{6}", text):
        return (*default, 255)
    return (*(int(text[i : i + 2], 16) for i in (0, 2, 4)), 255)


def tint(text: str, by: float | None) -> str:
    if not by:
        return text
    out = []
    for c in rgb(text)[:3]:
        v = math.floor(c + (255 - c) * by + 0.5) if by > 0 else math.floor(c * (1 + by) + 0.5)
        out.append(min(255, max(0, v)))
    return "{:02x}{:02x}{:02x}".format(*out)


def fixed(x: float, digits: int) -> str:
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def format_number(value: str, number_format: int, code: str = "") -> str:
    """Displayed text; what is no number stays."""
    m = re.match(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", value)
    if not m:
        return value
    x = float(m[0])
    plain = str(int(x)) if x == int(x) else fixed(x, 2)
    grouped = re.sub(r"\.?0+$", "", f"{Decimal(fixed(x, 2)):,}") if x != int(x) else f"{int(x):,}"
    if number_format <= 1 and not code:
        return str(int(x)) if x == int(x) and abs(x) < 1e21 else re.sub(r"\.?0+$", "", f"{x:.10g}") if "e" not in f"{x:.10g}" and "." in f"{x:.10g}" else f"{x:.10g}"
    if 2 <= number_format <= 4:
        return fixed(x, number_format)
    if 5 <= number_format <= 8:
        return "$" + fixed(x, 2)
    if number_format == 9:
        return f"{math.floor(x * 100 + 0.5)}%"
    if number_format == 10:
        return fixed(x * 100, 2) + "%"
    if 14 <= number_format <= 22:
        return value
    if 37 <= number_format <= 40:
        return grouped
    if "$" in code:
        return "$" + fixed(x, 2)
    if "%" in code:
        return f"{math.floor(x * 100 + 0.5)}%"
    if "," in code:
        return grouped
    return fixed(x, 2) if "0.00" in code else plain


def _sizes(count: int, get, page: float) -> list[float]:
    """Positions of the visible rows or columns, one more than there are."""
    out = [0.0]
    for i in range(count):
        out.append(out[-1] + get(i))
        if out[-1] > page:
            break
    return out


def draw_sheet(sheet: Sheet) -> Grid:
    scale = LONGEST / max(PAGE)
    canvas, font = Canvas(PAGE[0] * scale, PAGE[1] * scale), load_font()

    def width(c: int) -> float:
        for first, last, points, hidden in sheet.widths:
            if first <= c <= last:
                return 0.0 if hidden else points
        return sheet.default_width

    def height(r: int) -> float:
        own, hidden = sheet.heights.get(r, (None, False))
        return 0.0 if hidden else sheet.default_height if own is None else own

    last_row = max([9, *(c.row for c in sheet.cells), *sheet.heights, *(m[2] for m in sheet.merges)])
    last_col = max([4, *(c.col for c in sheet.cells), *(m[3] for m in sheet.merges)])
    xs, ys = _sizes(last_col + 1, width, PAGE[0]), _sizes(last_row + 1, height, PAGE[1])
    cols, rows = len(xs) - 1, len(ys) - 1
    cells = {(c.row, c.col): c for c in sheet.cells if c.row < rows and c.col < cols}
    owner: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for m in sheet.merges:
        for r in range(m[0], min(m[2], rows - 1) + 1):
            for c in range(m[1], min(m[3], cols - 1) + 1):
                owner[r, c] = m
    style = lambda cell: sheet.styles[cell.style] if 0 <= cell.style < len(sheet.styles) else CellStyle()

    def box(r: int, c: int) -> tuple[float, float, float, float]:
        m = owner.get((r, c), (r, c, r, c))
        return xs[c], ys[r], xs[min(m[3] + 1, cols)], ys[min(m[2] + 1, rows)]

    line = (217, 217, 217, 255)
    for x in xs:
        canvas.line(x * scale, 0, x * scale, ys[-1] * scale, line, 0.5 * scale)
    for y in ys:
        canvas.line(0, y * scale, xs[-1] * scale, y * scale, line, 0.5 * scale)
    drawn = [(k, c) for k, c in sorted(cells.items()) if k not in owner or owner[k][:2] == k]
    for (r, c), cell in drawn:
        if style(cell).fill:
            x0, y0, x1, y1 = box(r, c)
            canvas.rect(x0 * scale, y0 * scale, (x1 - x0) * scale, (y1 - y0) * scale, rgb(style(cell).fill))
    for (r, c), cell in drawn:
        x0, y0, x1, y1 = (v * scale for v in box(r, c))
        ends = {"top": (x0, y0, x1, y0), "bottom": (x0, y1, x1, y1), "left": (x0, y0, x0, y1), "right": (x1, y0, x1, y1)}
        for side, (kind, color) in style(cell).borders.items():
            wide = 1.5 if kind in ("medium", "mediumDashed") else 2.5 if kind == "thick" else 0.5
            canvas.line(*ends[side], rgb(color), wide * scale)
    for (r, c), cell in drawn:
        s = style(cell)
        shown = format_number(cell.value, s.number_format, s.code) if cell.numeric else cell.value
        if not shown:
            continue
        x0, y0, x1, y1 = box(r, c)
        if (r, c) not in owner and measure(shown, s.size, s.bold, font) > x1 - x0 - 2 * PAD:
            k = c + 1
            while k < cols and (r, k) not in owner and not ((r, k) in cells and cells[r, k].value) and measure(shown, s.size, s.bold, font) > x1 - x0 - 2 * PAD:
                x1 = xs[k + 1]
                k += 1
        room = x1 - x0 - 2 * PAD
        shown = truncate(shown, s.size, s.bold, room)
        wide = measure(shown, s.size, s.bold, font)
        align = s.align if s.align != "general" else "right" if cell.numeric else "left"
        x = x0 + PAD + (room - wide) / 2 if align == "center" else x1 - PAD - wide if align == "right" else x0 + PAD
        canvas.text(shown, x * scale, (y1 - PAD - s.size * 0.2) * scale, s.size, rgb(s.color), s.bold, scale, font)

    def place(anchor) -> tuple[float, float, float, float]:
        at = lambda v, k, d: (v[min(k, len(v) - 1)] + d) * scale
        c0, dx0, r0, dy0, c1, dx1, r1, dy1 = anchor
        x, y = at(xs, c0, dx0), at(ys, r0, dy0)
        if c1 is None:
            return x, y, dx1 * scale, dy1 * scale
        return x, y, at(xs, c1, dx1) - x, at(ys, r1, dy1) - y

    for anchor, grid in sheet.images:
        canvas.image(grid, *place(anchor))
    for anchor, chart in sheet.charts:
        draw_chart(canvas, chart, place(anchor), scale)
    return canvas.grid()


def nice(value: float, up: bool) -> float:
    power = 10 ** math.floor(math.log10(value))
    part = value / power
    for most, n in ((1, 1), (2, 2), (5, 5)) if up else ((1.5, 1), (3, 2), (7, 5)):
        if part <= most if up else part < most:
            return n * power
    return 10 * power


def axis(values: list[float]) -> tuple[float, float]:
    low, high = min([0.0, *values]), max([*values, 0.0] if not values else values)
    if high == low:
        high = low + 1
    step = nice(nice(high - low, True) / 5, False)
    return math.floor(low / step) * step, math.ceil(high / step) * step


def draw_chart(canvas: Canvas, chart: Chart, box: tuple[float, float, float, float], scale: float) -> None:
    x, y, w, h = box
    if w <= 0 or h <= 0 or not any(chart.series):
        return
    canvas.rect(x, y, w, h, (255, 255, 255, 255))
    color = lambda i: rgb(chart.colors[i % len(chart.colors)] if chart.colors else SERIES[i % len(SERIES)], (128, 128, 128))
    if chart.kind in ("pie", "doughnut"):
        values = chart.series[0]
        total, cx, cy, r = sum(values), x + w / 2, y + h / 2, min(w, h) / 2 * 0.85
        if not total:
            return
        inner, angle = (r / 2 if chart.kind == "doughnut" else 0.0), -math.pi / 2
        for i, v in enumerate(values):
            sweep = v / total * 2 * math.pi
            if sweep >= 0.001:
                path = Path()
                at = lambda a, q: (cx + math.cos(a) * q, cy + math.sin(a) * q)
                path.move(*at(angle, inner))
                path.line(*at(angle, r))
                steps = max(1, math.ceil(sweep / (math.pi / 2)))
                for k in range(1, steps + 1):
                    arc(path, r, r, 0, False, True, *at(angle + sweep * k / steps, r))
                path.line(*at(angle + sweep, inner))
                if inner:
                    for k in range(steps - 1, -1, -1):
                        arc(path, inner, inner, 0, False, False, *at(angle + sweep * k / steps, inner))
                path.close()
                canvas.fill(path, color(i))
            angle += sweep
        return
    low, high = axis([v for s in chart.series for v in s])
    left, top, wide, tall = x + w * 0.1, y + h * 0.08, w * 0.85, h * 0.8
    to_y = lambda v: top + tall * (1 - (v - low) / (high - low))
    for k in range(6):
        canvas.line(left, top + tall * k / 5, left + wide, top + tall * k / 5, (217, 217, 217, 255), 0.5 * scale)
    n = max(map(len, chart.series))
    if chart.kind == "bar":
        group = wide / n
        one = group * 0.7 / len(chart.series)
        for i, s in enumerate(chart.series):
            for k, v in enumerate(s):
                a, b = sorted((to_y(v), to_y(max(low, 0.0))))
                canvas.rect(left + group * k + group * 0.15 + one * i, a, one, b - a, color(i))
        return
    for i, s in enumerate(chart.series):
        points = [(left + wide * (k / max(1, n - 1)), to_y(v)) for k, v in enumerate(s)]
        if chart.kind == "area" and len(points) > 1:
            canvas.polygons([[(points[0][0], to_y(max(low, 0.0))), *points, (points[-1][0], to_y(max(low, 0.0)))]], (*color(i)[:3], 128))
        path = Path()
        for k, p in enumerate(points):
            (path.line if k else path.move)(*p)
        canvas.stroke(path, color(i), 1.5 * scale)
