"""XLS: BIFF8 records of an OLE2 workbook, drawn as an XLSX sheet is."""

from __future__ import annotations

import struct

from mosaiq.codecs.base import DecodeError, Grid
from mosaiq.formats.containers import read_ole2
from mosaiq.formats.sheet import INDEXED, Cell, CellStyle, Sheet, draw_sheet
from mosaiq.operators.limits import MAX_CONTINUE_RECORDS

#: Record types.
BOF, CONTINUE, SST, XF, FONT, FORMAT, PALETTE, LABELSST, NUMBER, RK, MULRK = 0x809, 0x3C, 0xFC, 0xE0, 0x31, 0x41E, 0x92, 0xFD, 0x203, 0x27E, 0xBD
BOOLERR, FORMULA, MERGED, DEFAULT_WIDTH, DEFAULT_HEIGHT, COLUMN, ROW, LABEL = 0x205, 0x06, 0xE5, 0x55, 0x225, 0x7D, 0x208, 0x204
BORDERS = ("", "thin", "medium", "dashed", "dotted", "thick", "double", "hair", "mediumDashed")


def records(data: bytes):
    """(type, body, where its continuations begin) of each record."""
    at = 0
    kind, body, cuts = None, b"", []
    while at + 4 <= len(data):
        k, n = struct.unpack_from("<HH", data, at)
        part = data[at + 4 : at + 4 + n]
        at += 4 + n
        if k == CONTINUE and kind is not None:
            if len(cuts) >= MAX_CONTINUE_RECORDS:
                raise DecodeError("Too many continuations")
            cuts.append(len(body))
            body += part
            continue
        if kind is not None:
            yield kind, body, cuts
        kind, body, cuts = k, part, []
    if kind is not None:
        yield kind, body, cuts


def decode_rk(raw: int) -> float:
    """A 30-bit whole number or the high half of a double, in hundredths if the first bit says so."""
    if raw & 2:
        v = float((raw - (1 << 32) if raw & 0x80000000 else raw) >> 2)
    else:
        v = struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return v / 100 if raw & 1 else v


def read_string(body: bytes, at: int, cuts: list[int]) -> tuple[str, int]:
    """A string with rich and phonetic parts; after a cut the first byte says anew how wide characters are."""
    n, flags = struct.unpack_from("<HB", body, at)
    at += 3
    runs = extra = 0
    if flags & 8:
        (runs,) = struct.unpack_from("<H", body, at)
        at += 2
    if flags & 4:
        (extra,) = struct.unpack_from("<I", body, at)
        at += 4
    wide, out = flags & 1, ""
    marks = set(cuts)
    while n > 0 and at < len(body):
        if at in marks:
            wide = body[at] & 1
            at += 1
        stop = min([c for c in cuts if c > at], default=len(body))
        take = min(n, (stop - at) // (2 if wide else 1))
        if take <= 0:
            at = stop if stop > at else at + 1
            continue
        size = take * (2 if wide else 1)
        out += body[at : at + size].decode("utf-16-le" if wide else "latin-1", "replace")
        at += size
        n -= take
    return out, at + 4 * runs + extra


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def parse_xls(data: bytes) -> Sheet:
    streams = read_ole2(data)
    book = streams.get("Workbook") or streams.get("Book")
    if book is None:
        raise DecodeError("Invalid XLS: no workbook")
    palette, fonts, codes, strings, formats = list(INDEXED[8:]), [], {}, [], []
    out, section = Sheet(), 0

    def color(i: int) -> str | None:
        return INDEXED[i] if i < 8 else palette[i - 8] if i < 64 and i - 8 < len(palette) else "000000" if i in (64, 0x7FFF) else "FFFFFF" if i == 65 else None

    def add(row: int, col: int, style: int, value: str, numeric: bool) -> None:
        out.cells.append(Cell(row, col, value, numeric, style))

    for kind, b, cuts in records(book):
        try:
            if kind == BOF:
                section += 1
                if section > 2:
                    break
            elif section < 2:
                if kind == FONT:
                    height, _, c, weight = struct.unpack_from("<HHHH", b)
                    fonts.append((height / 20, weight >= 700, c))
                elif kind == FORMAT:
                    codes[struct.unpack_from("<H", b)[0]] = read_string(b, 2, [])[0]
                elif kind == PALETTE:
                    palette = [b[2 + 4 * i : 5 + 4 * i].hex() for i in range(struct.unpack_from("<H", b)[0])]
                elif kind == XF:
                    formats.append(b)
                elif kind == SST:
                    at = 8
                    for _ in range(struct.unpack_from("<I", b, 4)[0]):
                        if at >= len(b):
                            break
                        text, at = read_string(b, at, cuts)
                        strings.append(text)
            elif kind == LABELSST:
                r, c, s, i = struct.unpack_from("<HHHI", b)
                add(r, c, s, strings[i] if i < len(strings) else "", False)
            elif kind == LABEL:
                r, c, s = struct.unpack_from("<HHH", b)
                add(r, c, s, read_string(b, 6, [])[0], False)
            elif kind == NUMBER:
                r, c, s, v = struct.unpack_from("<HHHd", b)
                add(r, c, s, _number(v), True)
            elif kind == RK:
                r, c, s, v = struct.unpack_from("<HHHI", b)
                add(r, c, s, _number(decode_rk(v)), True)
            elif kind == MULRK:
                r, c = struct.unpack_from("<HH", b)
                for k in range((len(b) - 6) // 6):
                    s, v = struct.unpack_from("<HI", b, 4 + 6 * k)
                    add(r, c + k, s, _number(decode_rk(v)), True)
            elif kind == BOOLERR:
                r, c, s, v, error = struct.unpack_from("<HHHBB", b)
                if not error:
                    add(r, c, s, "TRUE" if v else "FALSE", False)
            elif kind == FORMULA:
                r, c, s = struct.unpack_from("<HHH", b)
                if b[12:14] != b"\xff\xff":
                    add(r, c, s, _number(struct.unpack_from("<d", b, 6)[0]), True)
                elif b[6] == 1:
                    add(r, c, s, "TRUE" if b[8] else "FALSE", False)
            elif kind == MERGED:
                for k in range(struct.unpack_from("<H", b)[0]):
                    r0, r1, c0, c1 = struct.unpack_from("<HHHH", b, 2 + 8 * k)
                    out.merges.append((r0, c0, r1, c1))
            elif kind == DEFAULT_WIDTH:
                out.default_width = struct.unpack_from("<H", b)[0] * 7.0 + 5
            elif kind == DEFAULT_HEIGHT:
                out.default_height = struct.unpack_from("<HH", b)[1] / 20
            elif kind == COLUMN:
                first, last, wide, _, flags = struct.unpack_from("<HHHHH", b)
                out.widths.append((first, last, wide / 256 * 7 + 5, bool(flags & 1)))
            elif kind == ROW:
                r, _, _, height, _, _, flags = struct.unpack_from("<HHHHHHI", b)
                was = out.heights.get(r, (None, False))
                out.heights[r] = ((height & 0x7FFF) / 20 if not height & 0x8000 else None, was[1] or bool(flags & 0x20))
        except struct.error:
            continue
    if section < 2:
        raise DecodeError("Invalid spreadsheet: no sheets")
    for b in formats:
        if len(b) < 20:
            out.styles.append(CellStyle())
            continue
        font, code = struct.unpack_from("<HH", b)
        font -= font > 4  # there is no font 4
        size, bold, c = fonts[font] if font < len(fonts) else (11.0, False, 64)
        lines, side_colors, more, fills = struct.unpack_from("<HHIH", b, 10)
        s = CellStyle(size, bold, color(c), None, {}, {1: "left", 2: "center", 3: "right"}.get(b[6] & 7, "general"), code, codes.get(code, ""))
        tints = (side_colors & 127, side_colors >> 7 & 127, more & 127, more >> 7 & 127)
        for k, side in enumerate(("left", "right", "top", "bottom")):
            style = lines >> 4 * k & 15
            if 0 < style < len(BORDERS):
                s.borders[side] = (BORDERS[style], color(tints[k]))
        if more >> 26 & 63:
            s.fill = color(fills & 127)
        out.styles.append(s)
    return out


def decode_xls(data: bytes) -> Grid:
    return draw_sheet(parse_xls(data))
