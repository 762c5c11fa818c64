"""A slide: shapes in order, drawn from the lowest up."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from mosaiq.codecs.base import Grid
from mosaiq.formats.sheet import rgb
from mosaiq.vector.canvas import Canvas
from mosaiq.vector.font import load_font
from mosaiq.vector.paths import Path

LONGEST, MARGIN, LINE = 1024.0, 4.0, 1.2


@dataclass
class TextRun:
    text: str
    size: float = 18.0
    bold: bool = False
    color: str | None = None


@dataclass
class TextPara:
    runs: list[TextRun] = field(default_factory=list)
    align: str = "left"
    bullet: str | None = None
    indent: float = 0.0


@dataclass
class Shape:
    box: tuple[float, float, float, float]
    paras: list[TextPara] = field(default_factory=list)
    anchor: str = "top"  # top, middle, bottom
    fill: str | None = None
    line: str | None = None
    line_width: float = 0.75
    image: Grid | None = None
    round: bool = False
    shadow: bool = False


@dataclass
class Slide:
    size: tuple[float, float] = (720.0, 540.0)
    background: str | None = None
    picture: Grid | None = None
    shapes: list[Shape] = field(default_factory=list)


def wrapped(para: TextPara, room: float, font) -> list[tuple[float, float, list[tuple[float, str, TextRun]]]]:
    """(width, tallest, pieces) of each line; a word too long for a line has one of its own."""
    lines, line, used, tall = [], [], 0.0, 0.0
    wide = lambda t, r: sum(font.width(ord(c)) for c in t) * r.size / 1000 * (1.05 if r.bold else 1)
    runs = para.runs
    if para.bullet and runs:
        runs = [TextRun(para.bullet + " ", runs[0].size, runs[0].bold, runs[0].color), *runs]
    for run in runs:
        for piece in re.findall(r"\n| |[^\s]+|\s", run.text):
            w = wide(piece, run)
            if piece == "\n" or line and used + w > room and not piece.isspace():
                lines.append((used, tall or run.size, line))
                line, used, tall = [], 0.0, 0.0
                if piece == "\n":
                    continue
            if not line and piece.isspace():
                continue
            line.append((used, piece, run))
            used, tall = used + w, max(tall, run.size)
    if line or not lines:
        lines.append((used, tall or (para.runs[0].size if para.runs else 18.0), line))
    return lines


def draw_slide(slide: Slide) -> Grid:
    scale = LONGEST / max(slide.size)
    canvas, font = Canvas(slide.size[0] * scale, slide.size[1] * scale, rgb(slide.background, (255, 255, 255))), load_font()
    if slide.picture is not None:
        canvas.image(slide.picture, 0, 0, slide.size[0] * scale, slide.size[1] * scale)
    for s in slide.shapes:
        x, y, w, h = s.box
        at = [v * scale for v in s.box]
        if s.image is not None:
            canvas.image(s.image, *at)
            continue
        if s.fill or s.line:
            path = Path()
            if s.round:
                path.ellipse(at[0] + at[2] / 2, at[1] + at[3] / 2, at[2] / 2, at[3] / 2)
            else:
                path.rect(*at)
            if s.fill:
                canvas.fill(path, rgb(s.fill))
            if s.line:
                canvas.stroke(path, rgb(s.line), s.line_width * scale)
        lines = [(para, *line) for para in s.paras for line in wrapped(para, w - 2 * MARGIN - para.indent, font)]
        total = sum(tall * LINE for _, _, tall, _ in lines)
        top = y + MARGIN if s.anchor == "top" else y + (h - total) / 2 if s.anchor == "middle" else y + h - MARGIN - total
        for para, used, tall, pieces in lines:
            room = w - 2 * MARGIN - para.indent
            left = x + MARGIN + para.indent + ((room - used) / 2 if para.align == "center" else room - used if para.align == "right" else 0)
            for off, text, run in pieces:
                if s.shadow:
                    canvas.text(text, (left + off + 1) * scale, (top + tall + 1) * scale, run.size, (0, 0, 0, 100), run.bold, scale, font)
                canvas.text(text, (left + off) * scale, (top + tall) * scale, run.size, rgb(run.color), run.bold, scale, font)
            top += tall * LINE
    return canvas.grid()
