"""DOC: text, runs and pictures of a binary Word document, drawn on a Letter page."""

from __future__ import annotations

import bisect
import struct
from dataclasses import replace

from mosaiq.codecs.base import DecodeError, Grid
from mosaiq.formats.containers import read_ole2
from mosaiq.formats.document import Paragraph, ParaStyle, Run, RunStyle, TextDocument, draw_document
from mosaiq.formats.embedded import picture

#: Colours by index.
COLORS = (None, "000000", "0000FF", "00FFFF", "00FF00", "FF00FF", "FF0000", "FFFF00", "FFFFFF", "00008B", "008B8B", "006400", "8B008B", "8B0000", "808000", "A9A9A9", "D3D3D3")
#: Operand sizes by the top three bits of an opcode; 6 has its own length byte.
SIZES = (1, 1, 2, 4, 2, 2, -1, 3)


def sprms(data: bytes):
    """(opcode, operand) of a property list."""
    at = 0
    while at + 2 <= len(data):
        (op,) = struct.unpack_from("<H", data, at)
        at += 2
        n = SIZES[op >> 13]
        if n < 0:
            if at >= len(data):
                return
            n = data[at] if op != 0xD608 else struct.unpack_from("<H", data, at)[0] - 1 if at + 2 <= len(data) else 0
            at += 1 if op != 0xD608 else 2
        yield op, data[at : at + n]
        at += n


def run_style(data: bytes, base: RunStyle = RunStyle(size=10.0)) -> tuple[RunStyle, int | None]:
    """The style of a list, and where its picture is."""
    image, special = None, False
    for op, v in sprms(data):
        try:
            if op == 0x0835:
                base = replace(base, bold=v[0] in (1, 129))
            elif op == 0x0836:
                base = replace(base, italic=v[0] in (1, 129))
            elif op == 0x4A43:
                base = replace(base, size=struct.unpack("<H", v)[0] / 2)
            elif op == 0x2A42:
                base = replace(base, color=COLORS[v[0]] if v[0] < len(COLORS) else None)
            elif op == 0x6870:
                base = replace(base, color=None if v[3] else v[:3].hex())
            elif op == 0x2A3E:
                base = replace(base, underline=v[0] != 0)
            elif op == 0x6A03:
                image = struct.unpack("<I", v)[0]
            elif op == 0x0855:
                special = v[0] == 1
        except (IndexError, struct.error):
            continue
    return base, image if special else None


def para_style(data: bytes) -> ParaStyle:
    out = ParaStyle(spacing=1.15)
    for op, v in sprms(data):
        try:
            if op in (0x2403, 0x2461):
                out = replace(out, align={1: "center", 2: "right"}.get(v[0], "left"))
            elif op in (0x840F, 0x845E):
                out = replace(out, left=struct.unpack("<h", v)[0] / 20)
            elif op in (0x840E, 0x845D):
                out = replace(out, right=struct.unpack("<h", v)[0] / 20)
            elif op in (0x8411, 0x8460):
                out = replace(out, first=struct.unpack("<h", v)[0] / 20)
            elif op == 0xA413:
                out = replace(out, before=struct.unpack("<H", v)[0] / 20)
            elif op == 0xA414:
                out = replace(out, after=struct.unpack("<H", v)[0] / 20)
            elif op == 0x6412:
                line, many = struct.unpack("<hh", v)
                out = replace(out, spacing=line / 240) if many and line > 0 else out
            elif op == 0x2407:
                out = replace(out, new_page=v[0] == 1)
        except (IndexError, struct.error):
            continue
    return out


class _Intervals:
    """The first interval, in order of reading, that holds a position; found by bisection over disjoint pieces."""

    def __init__(self, rows: list[tuple[float, float, object]]):
        self.starts: list[float] = []
        self.rows = sorted(rows, key=lambda r: r[0])
        self.starts = [r[0] for r in self.rows]

    def at(self, cp: int):
        k = bisect.bisect_right(self.starts, cp) - 1
        return self.rows[k][2] if k >= 0 and cp < self.rows[k][1] else None


def parse_doc(data: bytes) -> TextDocument:
    streams = read_ole2(data)
    main = streams.get("WordDocument")
    if main is None or len(main) < 0x200:
        raise DecodeError("Invalid DOC: no WordDocument stream")
    version, flags = struct.unpack_from("<H", main, 2)[0], struct.unpack_from("<H", main, 10)[0]
    if version < 0xC1:
        raise DecodeError("Unsupported DOC version")
    if flags & 0x100:
        raise DecodeError("Encrypted DOC is not supported")
    table = streams.get("1Table" if flags & 0x200 else "0Table")
    if table is None:
        raise DecodeError("Invalid DOC: no table stream")
    (total,) = struct.unpack_from("<I", main, 0x4C)
    entry = lambda k: struct.unpack_from("<II", main, 0x9A + 8 * k)
    clx_at, clx_size = entry(33)
    clx, at = table[clx_at : clx_at + clx_size], 0
    while at < len(clx) and clx[at] == 1:
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    if at >= len(clx) or clx[at] != 2:
        raise DecodeError("Invalid DOC: no piece table")
    (size,) = struct.unpack_from("<I", clx, at + 1)
    plc = clx[at + 5 : at + 5 + size]
    n = (len(plc) - 4) // 12
    cps = struct.unpack_from(f"<{n + 1}I", plc)
    pieces, text = [], []
    for i in range(n):
        (fc,) = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * i + 2)
        narrow = bool(fc & 0x40000000)
        fc = (fc & 0x3FFFFFFF) // (2 if narrow else 1)
        length = cps[i + 1] - cps[i]
        pieces.append((fc, fc + length * (1 if narrow else 2), cps[i], 1 if narrow else 2))
        text.append(main[fc : fc + length * (1 if narrow else 2)].decode("cp1252" if narrow else "utf-16-le", "replace"))
    whole = "".join(text)[:total]

    def position(fc: int) -> float:
        return next((cp + (fc - a) / w for a, b, cp, w in pieces if a <= fc < b), -1)

    def pages(k: int):
        """(first fc, end fc, property list) of the formatted pages that a bin table names."""
        begin, size = entry(k)
        plc = table[begin : begin + size]
        n = (len(plc) - 4) // 8
        for i in range(n):
            (number,) = struct.unpack_from("<I", plc, 4 * (n + 1) + 4 * i)
            page = main[512 * (number & 0x3FFFFF) : 512 * (number & 0x3FFFFF) + 512]
            if len(page) < 512:
                continue
            runs = page[511]
            fcs = struct.unpack_from(f"<{runs + 1}I", page)
            for j in range(runs):
                if k == 12:
                    o = page[4 * (runs + 1) + j] * 2
                    yield fcs[j], fcs[j + 1], page[o + 1 : o + 1 + page[o]] if o else b""
                else:
                    o = page[4 * (runs + 1) + 13 * j] * 2
                    if not o:
                        yield fcs[j], fcs[j + 1], b""
                        continue
                    words = page[o]
                    body = page[o + 2 : o + 2 + 2 * page[o + 1]] if words == 0 else page[o + 1 : o + 2 * words]
                    yield fcs[j], fcs[j + 1], body[2:]

    def intervals(k: int, read):
        rows = []
        for a, b, body in pages(k):
            begin, end = position(a), position(b)
            if begin < 0:
                continue
            if end < 0:
                end = next((cp + (q - p) / w for p, q, cp, w in pieces if p <= a < q), begin)
            rows.append((begin, max(end, begin + 1), read(body)))
        return _Intervals(rows)

    characters, paragraphs = intervals(12, run_style), intervals(13, para_style)
    store, plain = streams.get("Data", b""), (RunStyle(size=10.0), None)

    def image(at: int) -> Grid | None:
        """The first picture in the block at a place of the Data stream."""
        if at + 68 > len(store):
            return None
        size, = struct.unpack_from("<I", store, at)
        block = store[at : at + size]
        for mark in (b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n"):
            k = block.find(mark)
            if k >= 0:
                return picture(block[k:])
        return None

    blocks, runs, begin = [], [], 0
    for cp, c in enumerate(whole + "\r"):
        if c in "\r\x0c\x07":
            style = paragraphs.at(begin) or ParaStyle()
            blocks.append(Paragraph(runs, style))
            if c == "\x0c":
                blocks.append(Paragraph([Run("\f")]))
            runs, begin = [], cp + 1
            continue
        style, place = characters.at(cp) or plain
        if c == "\x01" and place is not None:
            grid = image(place)
            if grid is not None:
                runs.append(Run(image=grid, size=(100.0, 100.0)))
            continue
        c = {"\x0b": "\n", "\t": "\t", "\x1e": "-", "\xa0": "\xa0"}.get(c, c)
        if c < " " and c not in "\n\t":
            continue
        if runs and runs[-1].image is None and runs[-1].style == style:
            runs[-1].text += c
        else:
            runs.append(Run(c, style))
    return TextDocument(blocks)


def decode_doc(data: bytes) -> Grid:
    return draw_document(parse_doc(data))
