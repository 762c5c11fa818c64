"""SVG: shapes, paths, text, pictures and reuse, painted in document order."""

from __future__ import annotations

import base64
import math
import re
import urllib.parse
from dataclasses import dataclass, replace

from mosaiq.codecs.base import DecodeError, Grid
from mosaiq.formats.containers import Node, parse_xml
from mosaiq.formats.embedded import picture
from mosaiq.operators.limits import MAX_DEPTH
from mosaiq.vector.canvas import Canvas, Color
from mosaiq.vector.font import load_font, measure
from mosaiq.vector.paths import IDENTITY, Matrix, Path, apply, arc, multiply

LONGEST = 1024.0
#: Colour names.
NAMED = {
    "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0), "cyan": (0, 255, 255), "aqua": (0, 255, 255),
    "magenta": (255, 0, 255), "fuchsia": (255, 0, 255), "gray": (128, 128, 128), "grey": (128, 128, 128), "silver": (192, 192, 192), "maroon": (128, 0, 0), "olive": (128, 128, 0),
    "lime": (0, 255, 0), "teal": (0, 128, 128), "navy": (0, 0, 128), "purple": (128, 0, 128), "orange": (255, 165, 0), "pink": (255, 192, 203), "brown": (165, 42, 42), "gold": (255, 215, 0),
    "coral": (255, 127, 80), "salmon": (250, 128, 114), "tomato": (255, 99, 71), "crimson": (220, 20, 60), "indigo": (75, 0, 130), "violet": (238, 130, 238), "khaki": (240, 230, 140),
    "tan": (210, 180, 140), "beige": (245, 245, 220), "ivory": (255, 255, 240), "lavender": (230, 230, 250), "skyblue": (135, 206, 235), "steelblue": (70, 130, 180),
    "darkblue": (0, 0, 139), "darkgreen": (0, 100, 0), "darkred": (139, 0, 0), "darkgray": (169, 169, 169), "lightgray": (211, 211, 211), "lightblue": (173, 216, 230),
}
#: Pixels in a unit.
UNITS = {"px": 1.0, "pt": 4 / 3, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "em": 16.0, "": 1.0}
HIDDEN = {"defs", "clipPath", "symbol", "metadata", "title", "desc", "linearGradient", "radialGradient", "mask", "pattern", "filter", "style", "marker"}
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_LENGTH = re.compile(r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*([a-z%]*)")


def length(text: str | None, default: float = 0.0, whole: float = 100.0) -> float:
    m = _LENGTH.match(text or "")
    if not m:
        return default
    return float(m[1]) * (whole / 100 if m[2] == "%" else UNITS.get(m[2], 1.0))


def color(text: str | None) -> tuple[int, int, int] | None:
    """None where nothing is to be painted or the text is no colour."""
    text = (text or "").strip().lower()
    if m := re.fullmatch(r"#([0-9a-f]{3,8})", text):
        d = m[1]
        if len(d) in (3, 4):
            d = "".join(c * 2 for c in d)
        return tuple(int(d[i : i + 2], 16) for i in (0, 2, 4)) if len(d) >= 6 else None
    if m := re.match(r"rgba?\(([^)]*)\)", text):
        parts = [float(p.rstrip("%")) * (2.55 if p.endswith("%") else 1) for p in re.split(r"[\s,/]+", m[1].strip())[:3]]
        return tuple(min(255, max(0, int(p + 0.5))) for p in parts) if len(parts) == 3 else None
    return NAMED.get(text)


def transform(text: str | None) -> Matrix:
    """The list of transforms, the last applied first."""
    out = IDENTITY
    for name, args in re.findall(r"(\w+)\s*\(([^)]*)\)", text or ""):
        v = [float(x) for x in _NUMBER.findall(args)]
        m = IDENTITY
        if name == "matrix" and len(v) == 6:
            m = tuple(v)
        elif name == "translate" and v:
            m = (1, 0, 0, 1, v[0], v[1] if len(v) > 1 else 0)
        elif name == "scale" and v:
            m = (v[0], 0, 0, v[1] if len(v) > 1 else v[0], 0, 0)
        elif name == "rotate" and v:
            a = math.radians(v[0])
            m = (math.cos(a), math.sin(a), -math.sin(a), math.cos(a), 0, 0)
            if len(v) == 3:
                m = multiply(multiply((1, 0, 0, 1, -v[1], -v[2]), m), (1, 0, 0, 1, v[1], v[2]))
        elif name == "skewX" and v:
            m = (1, 0, math.tan(math.radians(v[0])), 1, 0, 0)
        elif name == "skewY" and v:
            m = (1, math.tan(math.radians(v[0])), 0, 1, 0, 0)
        out = multiply(m, out)
    return out


def parse_path(text: str) -> Path:
    """All path commands, absolute and relative; flags of arcs may touch what follows."""
    path, at, command = Path(), 0, ""
    x = y = hx = hy = 0.0
    before = ""
    sep = re.compile(r"[\s,]*")

    def number(flag: bool = False) -> float | None:
        nonlocal at
        at = sep.match(text, at).end()
        if flag and at < len(text) and text[at] in "01":
            at += 1
            return float(text[at - 1])
        m = _NUMBER.match(text, at)
        if not m:
            return None
        at = m.end()
        return float(m[0])

    size = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
    while True:
        at = sep.match(text, at).end()
        if at >= len(text):
            break
        if text[at].upper() in size:
            command = text[at]
            at += 1
        elif not command or command in "Zz":
            break
        kind, relative = command.upper(), command.islower()
        v = []
        for k in range(size[kind]):
            n = number(kind == "A" and k in (3, 4))
            if n is None:
                return path
            v.append(n)
        ox, oy = (x, y) if relative else (0.0, 0.0)
        if kind == "Z":
            path.close()
            x, y = path.parts[-1][0] if path.parts else (0.0, 0.0)
        elif kind == "M":
            x, y = v[0] + ox, v[1] + oy
            path.move(x, y)
            command = "l" if relative else "L"
        elif kind == "H":
            x = v[0] + ox
            path.line(x, y)
        elif kind == "V":
            y = v[0] + oy
            path.line(x, y)
        elif kind == "L":
            x, y = v[0] + ox, v[1] + oy
            path.line(x, y)
        elif kind in "CS":
            first = (v[0] + ox, v[1] + oy) if kind == "C" else (2 * x - hx, 2 * y - hy) if before in "CS" else (x, y)
            hx, hy, ex, ey = v[-4] + ox, v[-3] + oy, v[-2] + ox, v[-1] + oy
            path.curve(*first, hx, hy, ex, ey)
            x, y = ex, ey
        elif kind in "QT":
            hx, hy = (v[0] + ox, v[1] + oy) if kind == "Q" else (2 * x - hx, 2 * y - hy) if before in "QT" else (x, y)
            x, y = v[-2] + ox, v[-1] + oy
            path.quad(hx, hy, x, y)
        elif kind == "A":
            x, y = v[5] + ox, v[6] + oy
            arc(path, v[0], v[1], v[2], bool(v[3]), bool(v[4]), x, y)
        before = kind
    return path


@dataclass(frozen=True)
class Style:
    fill: str = "black"
    stroke: str = "none"
    stroke_width: float = 1.0
    opacity: float = 1.0
    fill_opacity: float = 1.0
    stroke_opacity: float = 1.0
    even_odd: bool = False
    size: float = 16.0
    bold: bool = False
    anchor: str = "start"
    color: str = "black"
    visible: bool = True


def _fraction(text: str, default: float) -> float:
    m = _LENGTH.match(text)
    return default if not m else min(1.0, max(0.0, float(m[1]) / (100 if m[2] == "%" else 1)))


class _Drawing:
    def __init__(self, root: Node, canvas: Canvas):
        self.canvas, self.ids = canvas, {}
        todo = [root]
        while todo:
            node = todo.pop()
            if node.get("id"):
                self.ids.setdefault(node.get("id"), node)
            todo += reversed(node.children)

    def style(self, node: Node, s: Style) -> Style | None:
        """None for a subtree that isn't displayed."""
        own = {k: v.strip() for k, v in node.attrs.items()}
        own |= {k.strip(): v.strip() for k, _, v in (part.partition(":") for part in node.get("style", "").split(";")) if v}
        if own.get("display") == "none":
            return None
        changes: dict = {}
        for name in ("fill", "stroke", "color"):
            if own.get(name, "inherit") != "inherit":
                changes[name] = own[name]
        for name in ("fill-opacity", "stroke-opacity"):
            if name in own:
                changes[name.replace("-", "_")] = _fraction(own[name], 1.0)
        if "opacity" in own:
            changes["opacity"] = s.opacity * _fraction(own["opacity"], 1.0)
        if "stroke-width" in own:
            changes["stroke_width"] = length(own["stroke-width"], s.stroke_width)
        if "fill-rule" in own:
            changes["even_odd"] = own["fill-rule"] == "evenodd"
        if "font-size" in own:
            changes["size"] = length(own["font-size"], s.size, s.size)
        if "font-weight" in own:
            changes["bold"] = own["font-weight"] in ("bold", "bolder", "600", "700", "800", "900")
        if "text-anchor" in own:
            changes["anchor"] = own["text-anchor"]
        if "visibility" in own:
            changes["visible"] = own["visibility"] not in ("hidden", "collapse")
        return replace(s, **changes)

    def paint(self, text: str, s: Style, share: float) -> Color | None:
        if m := re.match(r"url\(\s*['\"]?#([^)'\"]+)", text):
            return self.gradient(m[1], s.opacity * share, set())
        rgb = color(s.color if text.lower() == "currentcolor" else text)
        return None if rgb is None else (*rgb, int(255 * s.opacity * share + 0.5))

    def gradient(self, name: str, share: float, seen: set) -> Color | None:
        """The mean of the stops, which a thumbnail shows well enough; stops may be another gradient's."""
        node = self.ids.get(name)
        if node is None or name in seen:
            return None
        stops = node.all("stop")
        if not stops:
            return self.gradient((node.get("href") or "").lstrip("#"), share, seen | {name})
        total = [0.0] * 4
        for stop in stops:
            own = dict(stop.attrs) | {k.strip(): v.strip() for k, _, v in (p.partition(":") for p in stop.get("style", "").split(";")) if v}
            rgb = color(own.get("stop-color", "black")) or (0, 0, 0)
            for i, v in enumerate((*rgb, 255 * _fraction(own.get("stop-opacity", "1"), 1.0))):
                total[i] += v
        r, g, b, a = (v / len(stops) for v in total)
        return tuple(int(v + 0.5) for v in (r, g, b, a * share))

    def shape(self, path: Path, s: Style, m: Matrix, filled: bool = True) -> None:
        if not s.visible:
            return
        if filled and (c := self.paint(s.fill, s, s.fill_opacity)):
            self.canvas.fill(path, c, m, s.even_odd)
        if s.stroke_width > 0 and (c := self.paint(s.stroke, s, s.stroke_opacity)):
            self.canvas.stroke(path, c, s.stroke_width, m)

    def draw(self, node: Node, s: Style, m: Matrix, depth: int = 0) -> None:
        if node.tag in HIDDEN or depth > MAX_DEPTH:
            return
        style = self.style(node, s)
        if style is None:
            return
        m = multiply(transform(node.get("transform")), m)
        get = lambda *names: [length(node.get(n)) for n in names]
        path, filled = Path(), True
        if node.tag in ("svg", "g", "a", "switch"):
            if node.tag == "svg" and depth:
                m = multiply((1, 0, 0, 1, *get("x", "y")), m)
            for c in node.children:
                self.draw(c, style, m, depth + 1)
            return
        if node.tag == "use":
            target = self.ids.get((node.get("href") or "").lstrip("#"))
            if target is not None:
                m = multiply((1, 0, 0, 1, *get("x", "y")), m)
                if target.tag == "symbol":
                    for c in target.children:
                        self.draw(c, style, m, depth + 1)
                else:
                    self.draw(target, style, m, depth + 1)
            return
        if node.tag == "text":
            self.text(node, style, m)
            return
        if node.tag == "image":
            self.image(node, m)
            return
        if node.tag == "path":
            path = parse_path(node.get("d") or "")
        elif node.tag == "rect":
            x, y, w, h, rx, ry = get("x", "y", "width", "height", "rx", "ry")
            if w <= 0 or h <= 0:
                return
            rx, ry = rx if node.get("rx") else ry, ry if node.get("ry") else rx
            rx, ry = min(rx, w / 2), min(ry, h / 2)
            if rx > 0 and ry > 0:
                path.move(x + rx, y)
                for ex, ey, lx, ly in ((x + w, y + ry, x + w - rx, y), (x + w - rx, y + h, x + w, y + h - ry), (x, y + h - ry, x + rx, y + h), (x + rx, y, x, y + ry)):
                    path.line(lx, ly)
                    arc(path, rx, ry, 0, False, True, ex, ey)
                path.close()
            else:
                path.rect(x, y, w, h)
        elif node.tag in ("circle", "ellipse"):
            cx, cy, r, rx, ry = get("cx", "cy", "r", "rx", "ry")
            rx, ry = (r, r) if node.tag == "circle" else (rx, ry)
            if rx <= 0 or ry <= 0:
                return
            path.ellipse(cx, cy, rx, ry)
        elif node.tag == "line":
            x1, y1, x2, y2 = get("x1", "y1", "x2", "y2")
            path.move(x1, y1)
            path.line(x2, y2)
            filled = False
        elif node.tag in ("polyline", "polygon"):
            v = [float(n) for n in _NUMBER.findall(node.get("points") or "")]
            for i in range(0, len(v) - 1, 2):
                (path.line if i else path.move)(v[i], v[i + 1])
            if node.tag == "polygon":
                path.close()
        else:
            return
        self.shape(path, style, m, filled)

    def text(self, node: Node, s: Style, m: Matrix) -> None:
        """The element's own text, then its spans; each begins where it says, or where the one before ended."""
        font = load_font()
        x, y = length(node.get("x")), length(node.get("y"))
        parts = [(node, s, node.text)]
        for c in node.all("tspan"):
            if (style := self.style(c, s)) is not None:
                parts.append((c, style, c.text))
        for own, style, words in parts:
            words = re.sub(r"\s+", " ", words).strip() if own is node else re.sub(r"\s+", " ", words)
            x = length(own.get("x"), x) + length(own.get("dx"))
            y = length(own.get("y"), y) + length(own.get("dy"))
            if not words:
                continue
            wide = measure(words, style.size, style.bold, font)
            begin = x - (wide / 2 if style.anchor == "middle" else wide if style.anchor == "end" else 0)
            c = self.paint(style.fill, style, style.fill_opacity)
            if c and style.visible:
                unit, at = style.size / 1000, begin
                for ch in words:
                    if ch != " ":
                        self.canvas.fill(font.outline(ord(ch)), c, multiply((unit * (1.05 if style.bold else 1), 0, 0, -unit, at, y), m))
                    at += measure(ch, style.size, style.bold, font)
            x = begin + wide

    def image(self, node: Node, m: Matrix) -> None:
        href = node.get("href") or ""
        if not href.startswith("data:"):
            return
        head, _, body = href.partition(",")
        try:
            data = base64.b64decode(re.sub(r"\s", "", body)) if head.endswith("base64") else urllib.parse.unquote_to_bytes(body)
        except ValueError:
            return
        grid = picture(data)
        if grid is not None:
            x, y = length(node.get("x")), length(node.get("y"))
            w, h = length(node.get("width"), grid.width), length(node.get("height"), grid.height)
            (x0, y0), (x1, y1) = apply(m, x, y), apply(m, x + w, y + h)
            self.canvas.image(grid, min(x0, x1), min(y0, y1), abs(x1 - x0), abs(y1 - y0))


def decode_svg(data: bytes) -> Grid:
    root = parse_xml(data)
    if root.tag != "svg":
        raise DecodeError("SVG without a root")
    box = [float(v) for v in _NUMBER.findall(root.get("viewBox") or "")]
    has_box = len(box) == 4 and box[2] > 0 and box[3] > 0
    w = length(root.get("width"), box[2] if has_box else 300.0, box[2] if has_box else 300.0)
    h = length(root.get("height"), box[3] if has_box else 150.0, box[3] if has_box else 150.0)
    if w <= 0 or h <= 0:
        raise DecodeError("Invalid image dimensions")
    scale = LONGEST / max(w, h)
    canvas = Canvas(max(1.0, w * scale), max(1.0, h * scale))
    m: Matrix = (scale, 0, 0, scale, 0, 0)
    if has_box:
        fit = min(w / box[2], h / box[3])
        m = multiply((fit, 0, 0, fit, (w - box[2] * fit) / 2 - box[0] * fit, (h - box[3] * fit) / 2 - box[1] * fit), m)
    _Drawing(root, canvas).draw(root, Style(), m)
    return canvas.grid()
