"""ODT: the first page of an OpenDocument text. Tables without column widths share the line."""

from __future__ import annotations

import re

from mosaiq.codecs.base import DecodeError, Grid
from mosaiq.formats.containers import Node, parse_xml, read_zip
from mosaiq.formats.document import Float, Paragraph, ParaStyle, Run, RunStyle, Table, TableCell, TextDocument, draw_document, merged
from mosaiq.formats.embedded import picture

UNITS = {"cm": 72 / 2.54, "mm": 72 / 25.4, "in": 72.0, "pt": 1.0, "pc": 12.0, "px": 0.75}


def points(text: str | None) -> float | None:
    m = re.match(r"\s*(-?\d*\.?\d+)\s*(cm|mm|in|pt|pc|px)?", text or "")
    return float(m[1]) * UNITS.get(m[2] or "pt", 1.0) if m else None


def _color(text: str | None) -> str | None:
    return text[1:] if text and re.fullmatch("#[0-9A-Fa-f]{6}", text) else None


class _Reader:
    def __init__(self, files: dict[str, bytes]):
        self.files, self.floats = files, []
        self.styles: dict[str, Node] = {}
        self.roots = [parse_xml(files[n]) for n in ("styles.xml", "content.xml") if n in files]
        for root in self.roots:  # later ones win: named, automatic, the content's own
            for group in ("styles", "automatic-styles"):
                for s in (root.child(group) or Node("")).children:
                    if s.tag in ("style", "list-style"):
                        self.styles[s.get("style:name") or s.get("name", "")] = s
        self.base = RunStyle(size=12.0)

    def chain(self, name: str | None) -> list[Node]:
        out: list[Node] = []
        while name in self.styles and len(out) < 10:
            out.append(self.styles[name])
            name = out[-1].get("parent-style-name")
        return out[::-1]

    def run_style(self, name: str | None, base: RunStyle) -> RunStyle:
        for s in self.chain(name):
            p = s.child("text-properties")
            if p is None:
                continue
            size = p.get("font-size", "")
            base = merged(base, {
                "size": base.size * float(size[:-1]) / 100 if size.endswith("%") else points(size), "bold": None if p.get("font-weight") is None else p.get("font-weight") in ("bold", "700", "800", "900"),
                "italic": None if p.get("font-style") is None else p.get("font-style") == "italic", "color": _color(p.get("color")),
                "underline": None if p.get("text-underline-style") is None else p.get("text-underline-style") != "none",
            })
        return base

    def para_style(self, name: str | None) -> ParaStyle:
        out = ParaStyle()
        for s in self.chain(name):
            p = s.child("paragraph-properties")
            if p is None:
                continue
            align, line = p.get("text-align"), p.get("line-height", "")
            out = merged(out, {
                "before": points(p.get("margin-top")), "after": points(p.get("margin-bottom")), "left": points(p.get("margin-left")), "right": points(p.get("margin-right")), "first": points(p.get("text-indent")),
                "align": None if align is None else {"center": "center", "end": "right", "right": "right"}.get(align, "left"), "shading": _color(p.get("background-color")),
                "spacing": float(line[:-1]) / 100 * 1.15 if re.fullmatch(r"\d+(\.\d+)?%", line) else None, "new_page": True if p.get("break-before") == "page" else None,
            })
        return out

    def frame(self, node: Node, out: list[Run]) -> None:
        image = node.child("image")
        grid = picture(self.files.get((image.get("href") or "").removeprefix("./"))) if image else None
        if grid is None:
            return
        w, h = points(node.get("width")) or grid.width * 0.75, points(node.get("height")) or grid.height * 0.75
        if node.get("anchor-type") in ("as-char", None):
            out.append(Run(image=grid, size=(w, h)))
        else:
            self.floats.append(Float(grid, ((points(node.get("x")) or 0) + self.margins[0], (points(node.get("y")) or 0) + self.margins[1], w, h)))

    def runs(self, node: Node, style: RunStyle) -> list[Run]:
        out = [Run(re.sub(r"\s+", " ", node.text), style)] if node.text.strip() or node.text == " " else []
        for c in node.children:
            if c.tag in ("span", "a"):
                out += self.runs(c, self.run_style(c.get("style-name"), style))
            elif c.tag == "s":
                out.append(Run(" " * int(c.number("c", 1)), style))
            elif c.tag == "tab":
                out.append(Run("\t", style))
            elif c.tag == "line-break":
                out.append(Run("\n", style))
            elif c.tag == "frame":
                self.frame(c, out)
        return out

    def paragraph(self, p: Node, level: int = 0) -> Paragraph:
        name = p.get("style-name")
        style = self.para_style(name)
        if level:
            style = merged(style, {"bullet": "•", "left": style.left + 18.0 * level})
        return Paragraph(self.runs(p, self.run_style(name, self.base)), style)

    def table(self, t: Node) -> Table:
        widths: list[float] = []
        for c in t.all("table-column"):
            own = [points((s.child("table-column-properties") or Node("")).get("column-width")) for s in self.chain(c.get("style-name"))]
            widths += [next((w for w in reversed(own) if w), 0.0)] * int(c.number("number-columns-repeated", 1))
        out = Table(widths=widths if widths and all(widths) else [], border=(0.5, None))
        for row in [*t.all("table-row"), *(r for h in t.all("table-header-rows") for r in h.all("table-row"))]:
            out.rows.append([TableCell(self.blocks(c), int(c.number("number-columns-spanned", 1))) for c in row.all("table-cell")])
        return out

    def blocks(self, parent: Node, level: int = 0) -> list:
        out: list = []
        for c in parent.children:
            if c.tag in ("p", "h"):
                out.append(self.paragraph(c, level))
            elif c.tag == "table":
                out.append(self.table(c))
            elif c.tag == "list":
                for item in c.children:
                    out += self.blocks(item, level + 1)
            elif c.tag in ("section", "text-box"):
                out += self.blocks(c, level)
            elif c.tag == "frame":
                self.frame(c, [])
        return out

    def document(self) -> TextDocument:
        page, self.margins = (595.3, 841.9), (56.7, 56.7, 56.7, 56.7)
        for root in self.roots:
            p = (root.child("automatic-styles") or Node("")).deep("page-layout-properties")
            if p is not None:
                page = (points(p.get("page-width")) or page[0], points(p.get("page-height")) or page[1])
                every = points(p.get("margin"))
                self.margins = tuple(v if (v := points(p.get(f"margin-{side}"))) is not None else every if every is not None else 56.7 for side in ("left", "top", "right", "bottom"))
        body = self.roots[-1].at("body", "text")
        if body is None:
            raise DecodeError("Invalid ODT: no text")
        return TextDocument(self.blocks(body), page, self.margins, self.floats)


def parse_odt(data: bytes) -> TextDocument:
    files = read_zip(data)
    if "content.xml" not in files:
        raise DecodeError("Invalid ODT: no content")
    return _Reader(files).document()


def decode_odt(data: bytes) -> Grid:
    return draw_document(parse_odt(data))
