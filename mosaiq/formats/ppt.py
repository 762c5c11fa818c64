"""PPT: the first slide of a binary presentation: its drawing's shapes, with the outline's texts where shapes have none."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from mosaiq.codecs.base import DecodeError, Grid
from mosaiq.formats.containers import read_ole2
from mosaiq.formats.embedded import picture
from mosaiq.formats.slide import Shape, Slide, TextPara, TextRun, draw_slide
from mosaiq.operators.limits import MAX_DEPTH

UNIT = 8.0  # master units to a point
#: Record types.
DOCUMENT, DOCUMENT_ATOM, SLIDE, LIST, PERSIST, HEADER, CHARS, BYTES, STYLE = 1000, 1001, 1006, 4080, 1011, 3999, 4000, 4008, 4001
DRAWING_GROUP, BLIPS, DRAWING, GROUP, SHAPE, SP, OPTIONS, ANCHOR, CLIENT_ANCHOR, CHILD_ANCHOR, TEXTBOX = 0xF000, 0xF001, 0xF002, 0xF003, 0xF004, 0xF00A, 0xF00B, 0xF00F, 0xF010, 0xF00F, 0xF00D


@dataclass
class Record:
    kind: int
    instance: int
    body: bytes
    children: list["Record"] = field(default_factory=list)

    def all(self, kind: int) -> list["Record"]:
        return [c for c in self.children if c.kind == kind]

    def deep(self, kind: int):
        for c in self.children:
            if c.kind == kind:
                yield c
            yield from c.deep(kind)


def parse(data: bytes, depth: int = 0) -> list[Record]:
    """Records, those of version 15 with their children."""
    out, at = [], 0
    while at + 8 <= len(data):
        first, kind, size = struct.unpack_from("<HHI", data, at)
        body = data[at + 8 : at + 8 + size]
        out.append(Record(kind, first >> 4, body, parse(body, depth + 1) if first & 15 == 15 and depth < MAX_DEPTH else []))
        at += 8 + size
    return out


def options(body: bytes, count: int) -> dict[int, int]:
    return {op & 0x3FFF: v for op, v in (struct.unpack_from("<HI", body, 6 * i) for i in range(min(count, len(body) // 6)))}


def colour(value: int, scheme: list[str]) -> str | None:
    kind = value >> 24
    if kind == 8:
        return scheme[value & 255] if (value & 255) < len(scheme) else None
    return struct.pack("<I", value)[:3].hex() if kind in (0, 2) else None


def character_runs(body: bytes, length: int, scheme: list[str]) -> list[tuple[int, dict]]:
    """(characters, properties) of a style record: paragraph runs are passed over first."""
    at, done = 0, 0
    out: list[tuple[int, dict]] = []
    try:
        while done <= length and at + 10 <= len(body):
            n, _, mask = struct.unpack_from("<IHI", body, at)
            at += 10
            for bits, size in ((0xF, 2), (0x80, 2), (0x10, 2), (0x20, 4), (0x40, 2), (0x800, 2), (0x1000, 2), (0x2000, 2), (0x4000, 2), (0x100, 2), (0x400, 2), (0x8000, 2), (0x10000, 2), (0xE0000, 2), (0x200000, 2)):
                at += size if mask & bits else 0
            if mask & 0x100000:
                at += 2 + 4 * struct.unpack_from("<H", body, at)[0]
            done += n
        done = 0
        while done <= length and at + 8 <= len(body):
            n, mask = struct.unpack_from("<II", body, at)
            at += 8
            props: dict = {}
            if mask & 0xFFFF:
                props["bold"] = bool(struct.unpack_from("<H", body, at)[0] & 1)
                at += 2
            for bit in (0x10000, 0x200000, 0x400000, 0x800000):
                at += 2 if mask & bit else 0
            if mask & 0x20000:
                props["size"] = float(struct.unpack_from("<H", body, at)[0])
                at += 2
            if mask & 0x40000:
                r, g, b, index = body[at : at + 4]
                props["color"] = f"{r:02x}{g:02x}{b:02x}" if index == 254 else scheme[index] if index < len(scheme) else None
                at += 4
            at += 2 if mask & 0x80000 else 0
            out.append((n, props))
            done += n
    except (struct.error, ValueError):
        pass
    return out


def paragraphs(text: str, runs: list[tuple[int, dict]], kind: int) -> list[TextPara]:
    """Runs cut at the ends of paragraphs."""
    size = 44.0 if kind in (0, 6) else 28.0 if kind in (1, 5, 7, 8) else 18.0
    out, spans, at = [], [], 0
    for n, props in runs or [(len(text), {})]:
        spans.append((at, at + n, props))
        at += n
    begin = 0
    for line in text.replace("\n", "\r").split("\r"):
        end, para = begin + len(line), TextPara(align="center" if kind in (0, 6) else "left")
        for a, b, props in spans:
            low, high = max(a, begin), min(b, end)
            if low < high:
                para.runs.append(TextRun(text[low:high].replace("\x0b", "\n"), props.get("size") or size, props.get("bold", False), props.get("color")))
        if not para.runs:
            para.runs.append(TextRun(line.replace("\x0b", "\n"), size))
        out.append(para)
        begin = end + 1
    return out


def texts(records: list[Record], scheme: list[str]) -> list[tuple[int, list[TextPara]]]:
    """(kind, paragraphs) of each text: a header, then its characters, then their style."""
    out, kind, text, runs = [], 4, None, []

    def done():
        if text is not None:
            out.append((kind, paragraphs(text, runs, kind)))

    for r in records:
        if r.kind == HEADER:
            done()
            kind, text, runs = struct.unpack_from("<I", r.body.ljust(4, b"\0"))[0], None, []
        elif r.kind in (CHARS, BYTES):
            if text is not None:
                done()
                runs = []
            text = r.body.decode("utf-16-le" if r.kind == CHARS else "latin-1", "replace")
        elif r.kind == STYLE and text is not None:
            runs = character_runs(r.body, len(text), scheme)
    done()
    return out


def blips(group: list[Record], pictures: bytes) -> list[Grid | None]:
    """Pictures in the order that shapes number them."""
    out: list[Grid | None] = []
    for store in group:
        for entry in store.all(0xF007):
            at = struct.unpack_from("<I", entry.body, 28)[0] if len(entry.body) >= 32 else 0xFFFFFFFF
            body = pictures[at : at + 8 + struct.unpack_from("<I", pictures, at + 4)[0]] if at + 8 <= len(pictures) else entry.body[36:]
            found = None
            for mark in (b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n"):
                k = body.find(mark)
                if k >= 0:
                    found = picture(body[k:])
                    break
            out.append(found)
    return out


def parse_ppt(data: bytes) -> Slide:
    streams = read_ole2(data)
    main = streams.get("PowerPoint Document")
    if main is None:
        raise DecodeError("Invalid PPT: no PowerPoint Document stream")
    top = parse(main)
    document = next((r for r in top if r.kind == DOCUMENT), None)
    if document is None:
        raise DecodeError("Invalid PPT: no document")
    out = Slide()
    atom = next(iter(document.all(DOCUMENT_ATOM)), None)
    if atom is not None and len(atom.body) >= 8:
        w, h = struct.unpack_from("<II", atom.body)
        if w and h:
            out.size = (w / UNIT, h / UNIT)
    slide = next((r for r in top if r.kind == SLIDE), None)
    scheme: list[str] = []
    if slide is not None:
        atoms = slide.all(2032)
        if atoms:
            scheme = [atoms[-1].body[4 * i : 4 * i + 3].hex() for i in range(len(atoms[-1].body) // 4)]
        if scheme:
            out.background = scheme[0]
    outline: list[tuple[int, list[TextPara]]] = []
    lists = [r for r in document.all(LIST) if r.instance == 0]
    if lists:
        own: list[Record] = []
        seen = 0
        for r in lists[0].children:
            seen += r.kind == PERSIST
            if seen == 1 and r.kind != PERSIST:
                own.append(r)
        outline = texts(own, scheme)
    images = blips(list(document.deep(BLIPS)), streams.get("Pictures", b""))
    left = list(outline)
    if slide is not None:
        for sp in slide.deep(SHAPE):
            anchor, props, shape = None, {}, None
            for r in sp.children:
                if r.kind == CLIENT_ANCHOR and len(r.body) >= 8:
                    t, x, x2, b = struct.unpack_from("<hhhh", r.body) if len(r.body) < 16 else struct.unpack_from("<iiii", r.body)
                    anchor = (x / UNIT, t / UNIT, (x2 - x) / UNIT, (b - t) / UNIT)
                elif r.kind == CHILD_ANCHOR and len(r.body) >= 16:
                    x, t, x2, b = struct.unpack_from("<iiii", r.body)
                    anchor = (x / UNIT, t / UNIT, (x2 - x) / UNIT, (b - t) / UNIT)
                elif r.kind == OPTIONS:
                    props |= options(r.body, r.instance)
                elif r.kind == SP:
                    shape = r.instance
            if anchor is None:
                continue
            found = Shape(anchor, round=shape == 3)
            number = props.get(0x104, props.get(0x4104, 0))
            if number and number <= len(images) and images[number - 1] is not None:
                found.image = images[number - 1]
            if props.get(0x1BF, 0x10) & 0x10 and 0x181 in props:
                found.fill = colour(props[0x181], scheme)
            if props.get(0x1FF, 0) & 8 and 0x1C0 in props:
                found.line, found.line_width = colour(props[0x1C0], scheme), props.get(0x1CB, 9525) / 12700
            found.anchor = {1: "middle", 2: "bottom", 4: "middle", 5: "bottom"}.get(props.get(0x87, 0), "top")
            for box in sp.all(TEXTBOX):
                own = texts(box.children or parse(box.body), scheme)
                found.paras = [p for _, ps in own for p in ps]
                if not own and left and any(r.kind == 3998 for r in box.children or parse(box.body)):
                    found.paras = left.pop(0)[1]
            out.shapes.append(found)
    if not any(s.paras or s.image for s in out.shapes):
        w, h = out.size
        for i, (kind, paras) in enumerate(outline):
            out.shapes.append(Shape((w * 0.05, h * 0.05, w * 0.9, h * 0.2) if kind in (0, 6) else (w * 0.05, h * (0.27 + 0.2 * max(0, i - 1)), w * 0.9, h * 0.68), paras, "middle" if kind in (0, 6) else "top"))
    if slide is None and not out.shapes:
        raise DecodeError("Invalid PPT: no slides")
    return out


def decode_ppt(data: bytes) -> Grid:
    return draw_slide(parse_ppt(data))


