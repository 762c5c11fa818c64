"""PDF: the first page, painted by an interpreter of its content."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np

from mosaiq.codecs.base import DecodeError, Grid, bits_to_samples, half_up, padded
from mosaiq.formats.embedded import picture
from mosaiq.formats.pdf_file import END, Document, Operator, Reader, Stream
from mosaiq.vector.canvas import Canvas, Color
from mosaiq.vector.font import Font, load_font
from mosaiq.vector.paths import IDENTITY, Matrix, Path, multiply

LONGEST, MAX_FORMS = 1024.0, 24


@dataclass(frozen=True)
class State:
    m: Matrix = IDENTITY
    fill: Color = (0, 0, 0, 255)
    stroke: Color = (0, 0, 0, 255)
    width: float = 1.0
    font: "PdfFont | None" = None
    size: float = 0.0
    gap: float = 0.0
    word_gap: float = 0.0
    leading: float = 0.0
    rise: float = 0.0


@dataclass
class PdfFont:
    wide: bool = False
    widths: dict[int, float] = field(default_factory=dict)
    default: float | None = None
    unicode: dict[int, int] = field(default_factory=dict)

    def codes(self, data: bytes):
        return [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data) - 1, 2)] if self.wide else list(data)

    def character(self, code: int) -> int:
        if code in self.unicode:
            return self.unicode[code]
        if self.wide or code < 128:
            return code
        return ord(bytes([code]).decode("cp1252", "replace"))

    def advance(self, code: int, font: Font) -> float:
        if code in self.widths:
            return self.widths[code]
        return self.default if self.default is not None else font.width(self.character(code))


def to_unicode(data: bytes) -> dict[int, int]:
    """Codes to characters from bfchar and bfrange sections."""
    out: dict[int, int] = {}
    one = lambda h: int((h[:4] or b"0"), 16)
    for section in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.DOTALL):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", section):
            out[int(a, 16)] = one(b)
    for section in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.DOTALL):
        for a, b, c, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", section, re.DOTALL):
            low, high = int(a, 16), min(int(b, 16), int(a, 16) + 65535)
            listed = re.findall(rb"<([0-9A-Fa-f]+)>", many)
            for code in range(low, high + 1):
                if c:
                    out[code] = one(c) + code - low
                elif code - low < len(listed):
                    out[code] = one(listed[code - low])
    return out


def cid_widths(items: list) -> dict[int, float]:
    """Widths of `first [w ...]` and `first last w` entries."""
    out, i = {}, 0
    while i + 1 < len(items):
        if isinstance(items[i + 1], list):
            out |= {items[i] + k: w for k, w in enumerate(items[i + 1])}
            i += 2
        elif i + 2 < len(items):
            out |= dict.fromkeys(range(items[i], min(items[i + 1], items[i] + 65535) + 1), items[i + 2])
            i += 3
        else:
            break
    return out


class _Interpreter:
    def __init__(self, doc: Document, canvas: Canvas):
        self.doc, self.canvas, self.font = doc, canvas, load_font()
        self.fonts: dict[int, PdfFont] = {}

    # resources

    def look(self, resources: dict, kind: str, name: str) -> Any:
        group = self.doc.get(resources.get(kind))
        return self.doc.get(group.get(name)) if isinstance(group, dict) else None

    def pdf_font(self, info: Any) -> PdfFont | None:
        get = self.doc.get
        if not isinstance(info, dict):
            return None
        if id(info) in self.fonts:
            return self.fonts[id(info)]
        out = PdfFont(wide=info.get("Subtype") == "Type0")
        if out.wide:
            below = get((get(info.get("DescendantFonts")) or [None])[0])
            if isinstance(below, dict):
                out.default = float(get(below.get("DW", 1000)) or 0)
                items = [[get(x) for x in v] if isinstance(v, list) else v for v in map(get, get(below.get("W")) or [])]
                out.widths = {k: float(v) for k, v in cid_widths(items).items() if isinstance(v, int | float)}
        else:
            first = get(info.get("FirstChar")) or 0
            out.widths = {first + i: float(w) for i, w in enumerate(map(get, get(info.get("Widths")) or [])) if isinstance(w, int | float)}
            encoding = get(info.get("Encoding"))
            if isinstance(encoding, dict):
                code = 0
                for v in map(get, get(encoding.get("Differences")) or []):
                    if isinstance(v, int):
                        code = v
                    else:
                        if len(v) == 1:
                            out.unicode[code] = ord(v)
                        elif m := re.fullmatch(r"u(?:ni)?([0-9A-Fa-f]{4,6})", v):
                            out.unicode[code] = int(m[1], 16)
                        code += 1
        table = get(info.get("ToUnicode"))
        if isinstance(table, Stream):
            out.unicode |= to_unicode(self.doc.filtered(table))
        self.fonts[id(info)] = out
        return out

    # painting

    def color(self, values: list, alpha: int) -> Color | None:
        v = [min(1.0, max(0.0, x)) for x in values if isinstance(x, int | float)]
        if len(v) == 1:
            v = v * 3
        elif len(v) == 4:
            v = [(1 - x) * (1 - v[3]) for x in v[:3]]
        return (*(int(x * 255 + 0.5) for x in v), alpha) if len(v) == 3 else None

    def image(self, stream: Stream, inline: dict | None = None) -> Grid | None:
        doc, info = self.doc, {k: self.doc.get(v) for k, v in stream.info.items()}
        pick = lambda long, short, default=None: info.get(long, info.get(short, default))
        names = [n for n, _ in doc.filters(stream)]
        if names and names[-1] in ("DCTDecode", "DCT"):
            out = picture(doc.filtered(stream))
        elif names and names[-1] == "JPXDecode":
            return None
        else:
            w, h, bits = int(pick("Width", "W", 0)), int(pick("Height", "H", 0)), int(pick("BitsPerComponent", "BPC", 8) or 8)
            mask = bool(pick("ImageMask", "IM", False))
            if w < 1 or h < 1 or w * h > 100_000_000:
                return None
            space, table, n = pick("ColorSpace", "CS", "DeviceGray"), None, 1
            if isinstance(space, list) and space:
                kind = doc.get(space[0])
                if kind in ("Indexed", "I") and len(space) > 3:
                    base, body = doc.get(space[1]), doc.get(space[3])
                    body = doc.filtered(body) if isinstance(body, Stream) else body
                    width = 4 if base in ("DeviceCMYK", "CMYK") else 1 if base in ("DeviceGray", "G") else 3
                    table = np.frombuffer(body[: len(body) // width * width], np.uint8).reshape(-1, width)
                elif kind == "ICCBased" and isinstance(found := doc.get(space[1]), Stream):
                    n = int(doc.get(found.info.get("N")) or 3)
                else:
                    n = {"CalRGB": 3, "Lab": 3}.get(kind, 1)
            else:
                n = {"DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "DeviceCMYK": 4, "CMYK": 4}.get(space, 1)
            if mask:
                n, bits, table = 1, 1, None
            if bits not in (1, 2, 4, 8):
                return None
            stride = (w * n * bits + 7) // 8
            raw = bits_to_samples(padded(doc.filtered(stream), stride * h).reshape(h, stride), bits, w * n).reshape(h, w, n)
            if mask:
                return None
            if table is not None:
                whole = np.zeros((256, table.shape[1]), np.uint8)
                whole[: len(table)] = table[:256]
                raw, n = whole[raw[..., 0]], table.shape[1]
            elif bits < 8:
                raw = (raw.astype(np.int64) * 255 // ((1 << bits) - 1)).astype(np.uint8)
            rgb = raw if n == 3 else np.repeat(raw[..., :1], 3, 2) if n == 1 else half_up(255 * (1 - raw[..., :3] / 255.0) * (1 - raw[..., 3:4] / 255.0)).astype(np.uint8)
            out = Grid(np.dstack((rgb, np.full((h, w), 255, np.uint8))))
        soft = doc.get(stream.info.get("SMask"))
        if out is not None and isinstance(soft, Stream):
            alpha = self.image(soft)
            if alpha is not None:
                y, x = np.arange(out.height) * alpha.height // out.height, np.arange(out.width) * alpha.width // out.width
                out.rgba[..., 3] = alpha.rgba[np.ix_(y, x)][..., 0]
        return out

    def run(self, data: bytes, resources: dict, s: State, depth: int = 0) -> None:
        r, stack, v = Reader(data, content=True), [], []
        path, text, line = Path(), IDENTITY, IDENTITY
        canvas, doc = self.canvas, self.doc
        number = lambda i: v[i] if len(v) > i and isinstance(v[i], int | float) else 0

        def show(body: bytes) -> None:
            nonlocal text
            font = s.font or PdfFont()
            for code in font.codes(body):
                cp, wide = font.character(code), font.advance(code, self.font)
                unit = s.size / 1000
                if cp not in (32, 160) and s.size:
                    canvas.fill(self.font.outline(cp), s.fill, multiply(multiply((unit, 0, 0, unit, 0, s.rise), text), s.m))
                step = wide * unit + s.gap + (s.word_gap if code == 32 and not font.wide else 0)
                text = multiply((1, 0, 0, 1, step, 0), text)

        def move(x: float, y: float) -> None:
            nonlocal text, line
            line = text = multiply((1, 0, 0, 1, x, y), line)

        while (token := r.next()) is not END:
            if not isinstance(token, Operator):
                v.append(token)
                continue
            op = str(token)
            if op == "q":
                stack.append(s)
            elif op == "Q":
                s = stack.pop() if stack else s
            elif op == "cm" and len(v) >= 6:
                s = replace(s, m=multiply(tuple(number(i) for i in range(6)), s.m))
            elif op == "w":
                s = replace(s, width=number(0))
            elif op == "gs" and v:
                state = self.look(resources, "ExtGState", v[0])
                if isinstance(state, dict):
                    for key, name in (("ca", "fill"), ("CA", "stroke")):
                        if isinstance(alpha := doc.get(state.get(key)), int | float):
                            s = replace(s, **{name: (*getattr(s, name)[:3], int(255 * min(1, max(0, alpha)) + 0.5))})
                    if isinstance(wide := doc.get(state.get("LW")), int | float):
                        s = replace(s, width=wide)
            elif op == "m":
                path.move(number(0), number(1))
            elif op == "l":
                path.line(number(0), number(1))
            elif op == "c":
                path.curve(*(number(i) for i in range(6)))
            elif op == "v":
                path.curve(*path.at(), *(number(i) for i in range(4)))
            elif op == "y":
                path.curve(number(0), number(1), number(2), number(3), number(2), number(3))
            elif op == "re":
                path.rect(*(number(i) for i in range(4)))
            elif op == "h":
                path.close()
            elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
                if op in ("s", "b", "b*"):
                    path.close()
                if op[0] in "fFBb":
                    canvas.fill(path, s.fill, s.m, op.endswith("*"))
                if op[0] in "SsBb":
                    canvas.stroke(path, s.stroke, s.width, s.m)
                path = Path()
            elif op in ("g", "rg", "k", "sc", "scn"):
                if c := self.color(v, s.fill[3]):
                    s = replace(s, fill=c)
            elif op in ("G", "RG", "K", "SC", "SCN"):
                if c := self.color(v, s.stroke[3]):
                    s = replace(s, stroke=c)
            elif op == "BT":
                text = line = IDENTITY
            elif op in ("Tc", "Tw", "TL", "Ts"):
                s = replace(s, **{{"Tc": "gap", "Tw": "word_gap", "TL": "leading", "Ts": "rise"}[op]: number(0)})
            elif op == "Tf" and v:
                s = replace(s, font=self.pdf_font(self.look(resources, "Font", v[0])), size=number(1))
            elif op in ("Td", "TD"):
                if op == "TD":
                    s = replace(s, leading=-number(1))
                move(number(0), number(1))
            elif op == "Tm" and len(v) >= 6:
                text = line = tuple(number(i) for i in range(6))
            elif op == "T*":
                move(0, -s.leading)
            elif op in ("Tj", "'", '"'):
                if op == '"':
                    s = replace(s, word_gap=number(0), gap=number(1))
                if op != "Tj":
                    move(0, -s.leading)
                if v and isinstance(v[-1], bytes):
                    show(v[-1])
            elif op == "TJ" and v and isinstance(v[0], list):
                for part in v[0]:
                    if isinstance(part, bytes):
                        show(part)
                    elif isinstance(part, int | float):
                        text = multiply((1, 0, 0, 1, -part * s.size / 1000, 0), text)
            elif op == "Do" and v:
                target = self.look(resources, "XObject", v[0])
                if isinstance(target, Stream) and target.info.get("Subtype") == "Image":
                    if (grid := self._safe_image(target)) is not None:
                        canvas.image_in(grid, s.m)
                elif isinstance(target, Stream) and depth < MAX_FORMS:
                    m = doc.get(target.info.get("Matrix"))
                    own = replace(s, m=multiply(tuple(map(float, m)), s.m)) if isinstance(m, list) and len(m) == 6 else s
                    self.run(doc.filtered(target), doc.get(target.info.get("Resources")) or resources, own, depth + 1)
            elif op == "BI":
                self._inline(r, resources, s)
            v = []

    def _safe_image(self, stream: Stream) -> Grid | None:
        try:
            return self.image(stream)
        except (DecodeError, ValueError, IndexError, TypeError):
            return None

    def _inline(self, r: Reader, resources: dict, s: State) -> None:
        info: dict = {}
        while (key := r.next()) is not END and not (isinstance(key, Operator) and key == "ID"):
            info[str(key)] = r.next()
        begin = r.at + 1
        m = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|$)").search(r.data, begin)
        end = m.start() if m else len(r.data)
        r.at = m.end() if m else len(r.data)
        space = info.get("CS", info.get("ColorSpace"))
        if isinstance(space, str) and (found := self.look(resources, "ColorSpace", space)) is not None:
            info["CS"] = found
        if (grid := self._safe_image(Stream(info, r.data[begin:end]))) is not None:
            self.canvas.image_in(grid, s.m)


def decode_pdf(data: bytes) -> Grid:
    doc = Document(data)
    page = {k: doc.get(v) for k, v in doc.first_page().items()}
    box = [doc.get(v) for v in page.get("MediaBox") or [0, 0, 612, 792]]
    if len(box) != 4 or not all(isinstance(v, int | float) for v in box):
        box = [0, 0, 612, 792]
    x0, y0, x1, y1 = min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])
    w, h = x1 - x0, y1 - y0
    if w <= 0 or h <= 0:
        raise DecodeError("Invalid image dimensions")
    turn = int(page.get("Rotate") or 0) % 360
    scale = LONGEST / max(w, h)
    m: Matrix = multiply((1, 0, 0, 1, -x0, -y0), {0: (1, 0, 0, -1, 0, h), 90: (0, 1, 1, 0, 0, 0), 180: (-1, 0, 0, 1, w, 0), 270: (0, -1, -1, 0, h, w)}.get(turn, (1, 0, 0, -1, 0, h)))
    across, down = (h, w) if turn in (90, 270) else (w, h)
    canvas = Canvas(max(1.0, across * scale), max(1.0, down * scale))
    contents = page.get("Contents")
    streams = [doc.get(c) for c in contents] if isinstance(contents, list) else [contents]
    body = b"\n".join(doc.filtered(c) for c in streams if isinstance(c, Stream))
    _Interpreter(doc, canvas).run(body, page.get("Resources") or {}, State(m=multiply(m, (scale, 0, 0, scale, 0, 0))))
    return canvas.grid()
