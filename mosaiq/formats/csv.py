"""Delimited text: exact parsing, layout and drawing of its first page."""

from __future__ import annotations

import math
import re

from mosaiq.codecs.base import DecodeError, Grid
from mosaiq.vector.canvas import Canvas
from mosaiq.vector.font import load_font, measure

PAGE, MARGIN, LONGEST = (842.0, 595.0), 20.0, 1024.0
SIZE, PAD_X, PAD_Y, LINE, LEAST = 9.0, 6.0, 4.0, 1.4, 40.0
#: The table's colours.
HEADER, HEADER_TEXT, TEXT, PLAIN, BANDED, GRID_LINE = (68, 114, 196, 255), (255, 255, 255, 255), (51, 51, 51, 255), (255, 255, 255, 255), (242, 246, 250, 255), (217, 222, 228, 255)


def delimiter(text: str) -> str:
    end = text.find("\n")
    first = text[:end] if end > 0 else text
    return max((",", "\t", ";", "|"), key=lambda d: first.count(d)) if any(d in first for d in ",\t;|") else ","


def parse(text: str) -> list[list[str]]:
    """Rows of fields, ragged. A quoted field ends at its closing quote; text right after that begins another field."""
    d = delimiter(text)
    plain, end = re.compile(f"[^{re.escape(d)}\r\n]*"), len(text)
    rows, row, at = [], [], 0
    while at < end:
        if text[at] == '"':
            close = at + 1
            while (close := text.find('"', close)) >= 0 and text[close + 1 : close + 2] == '"':
                close += 2
            close = end if close < 0 else close
            row.append(text[at + 1 : close].replace('""', '"'))
            at, quoted = close + 1, True
        else:
            m = plain.match(text, at)
            row.append(m[0])
            at, quoted = m.end(), False
        if text[at : at + 1] == d:
            at += 1
            continue
        mark = text[at : at + 2]
        if mark[:1] in ("\r", "\n"):
            at += 2 if mark == "\r\n" else 1
        elif quoted and at < end:
            continue
        rows.append(row)
        row = []
    if row:
        rows.append(row)
    if rows and rows[-1] == [""]:
        rows.pop()
    return rows


def column_widths(rows: list[list[str]], total: float) -> list[float]:
    n = max(map(len, rows))
    own = [max([LEAST, *(measure(r[c] if c < len(r) else "", SIZE, i == 0) + 2 * PAD_X for i, r in enumerate(rows))]) for c in range(n)]
    ratio = total / sum(own)
    return [w * ratio if ratio >= 1 else max(LEAST, w * ratio) for w in own]


def truncate(text: str, size: float, bold: bool, most: float) -> str:
    if measure(text, size, bold) <= most:
        return text
    room, used, n = most - measure("…", size, bold), 0.0, 0
    for c in text:
        used += measure(c, size, bold)
        if used > room:
            break
        n += 1
    return text[:n] + "…"


def decode_csv(data: bytes) -> Grid:
    rows = parse(data.decode("utf-8", "replace").removeprefix("﻿"))
    if not rows:
        raise DecodeError("Empty CSV file")
    high = SIZE * LINE + 2 * PAD_Y
    rows = rows[: 1 + math.floor((PAGE[1] - 2 * MARGIN - high) / high)]
    widths = column_widths(rows, PAGE[0] - 2 * MARGIN)
    scale = LONGEST / max(PAGE)
    canvas, font = Canvas(PAGE[0] * scale, PAGE[1] * scale), load_font()
    for i in range(len(rows)):
        canvas.rect(MARGIN * scale, (MARGIN + i * high) * scale, (PAGE[0] - 2 * MARGIN) * scale, high * scale, HEADER if i == 0 else PLAIN if i % 2 else BANDED)
    right, low = (MARGIN + sum(widths)) * scale, (MARGIN + len(rows) * high) * scale
    for i in range(len(rows) + 1):
        y = (MARGIN + i * high) * scale
        canvas.line(MARGIN * scale, y, right, y, GRID_LINE, 0.5 * scale)
    x = MARGIN
    for w in [*widths, 0.0]:
        canvas.line(x * scale, MARGIN * scale, x * scale, low, GRID_LINE, 0.5 * scale)
        x += w
    for i, row in enumerate(rows):
        x = MARGIN
        for c, w in enumerate(widths):
            shown = truncate(row[c] if c < len(row) else "", SIZE, i == 0, w - 2 * PAD_X)
            canvas.text(shown, (x + PAD_X) * scale, (MARGIN + i * high + PAD_Y + SIZE) * scale, SIZE, HEADER_TEXT if i == 0 else TEXT, i == 0, scale, font)
            x += w
    return canvas.grid()
