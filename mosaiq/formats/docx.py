"""DOCX: the first page of a document.

Styles are inherited along basedOn, at most ten steps; direct formatting comes last.
"""

from __future__ import annotations

import re

from mosaiq.codecs.base import DecodeError, Grid
from mosaiq.formats.containers import Node, parse_xml, read_zip, relations
from mosaiq.formats.document import Float, Paragraph, ParaStyle, Run, RunStyle, Table, TableCell, TextDocument, draw_document, merged
from mosaiq.formats.embedded import picture

TWIP, EMU, DEPTH = 20.0, 12700.0, 10
PART = "word/document.xml"


def _on(node: Node | None) -> bool | None:
    return None if node is None else node.get("val", "true") not in ("0", "false", "none", "off")


def _color(value: str | None) -> str | None:
    return value if value and re.fullmatch("[0-9A-Fa-f]{6}", value) else None


def _twips(node: Node | None, *names: str) -> float | None:
    for n in names:
        if node is not None and (v := node.number(n)) is not None:
            return v / TWIP
    return None


def run_changes(node: Node | None) -> dict:
    if node is None:
        return {}
    size, color, line = node.child("sz"), node.child("color"), node.child("u")
    return {"size": size.number("val", 22) / 2 if size else None, "bold": _on(node.child("b")), "italic": _on(node.child("i")), "underline": _on(line), "color": _color(color.get("val")) if color else None}


def para_changes(node: Node | None) -> dict:
    if node is None:
        return {}
    gap, indent, align, shade = node.child("spacing"), node.child("ind"), node.child("jc"), node.child("shd")
    out = {"before": _twips(gap, "before"), "after": _twips(gap, "after"), "left": _twips(indent, "left", "start"), "right": _twips(indent, "right", "end")}
    if (hanging := _twips(indent, "hanging")) is not None:
        out["first"] = -hanging
    elif (first := _twips(indent, "firstLine")) is not None:
        out["first"] = first
    if gap is not None and (v := gap.number("line")):
        out["spacing"] = v / 240 if gap.get("lineRule", "auto") == "auto" else None
    if align is not None:
        out["align"] = {"center": "center", "right": "right", "end": "right"}.get(align.get("val", ""), "left")
    out["shading"] = _color(shade.get("fill")) if shade else None
    if (edge := node.at("pBdr", "bottom")) is not None and edge.get("val", "none") not in ("none", "nil"):
        out["bottom"] = (edge.number("sz", 4) / 8, _color(edge.get("color")))
    out["new_page"] = _on(node.child("pageBreakBefore"))
    return out


class _Reader:
    def __init__(self, files: dict[str, bytes]):
        self.files, self.links = files, relations(files, PART)
        self.styles: dict[str, Node] = {}
        self.run_default, self.para_default, self.default_id = RunStyle(), ParaStyle(), None
        if "word/styles.xml" in files:
            root = parse_xml(files["word/styles.xml"])
            base = root.child("docDefaults")
            if base is not None:
                self.run_default = merged(self.run_default, run_changes(base.at("rPrDefault", "rPr")))
                self.para_default = merged(self.para_default, para_changes(base.at("pPrDefault", "pPr")))
            for s in root.all("style"):
                self.styles[s.get("styleId", "")] = s
                if s.get("type") == "paragraph" and s.get("default") in ("1", "true"):
                    self.default_id = s.get("styleId")
        self.levels: dict[tuple[str, str], str] = {}
        if "word/numbering.xml" in files:
            root = parse_xml(files["word/numbering.xml"])
            lists = {a.get("abstractNumId"): a for a in root.all("abstractNum")}
            for n in root.all("num"):
                own = lists.get((n.child("abstractNumId") or Node("")).get("val"))
                for level in own.all("lvl") if own else []:
                    kind = (level.child("numFmt") or Node("")).get("val", "bullet")
                    self.levels[n.get("numId", ""), level.get("ilvl", "0")] = "•" if kind == "bullet" else "1."
        self.floats: list[Float] = []

    def chain(self, name: str | None) -> list[Node]:
        """The style and its ancestors, the furthest first."""
        out: list[Node] = []
        while name in self.styles and len(out) < DEPTH:
            out.append(self.styles[name])
            name = (out[-1].child("basedOn") or Node("")).get("val")
        return out[::-1]

    def image(self, node: Node) -> tuple[Grid, float, float] | None:
        blip, size = node.deep("blip"), node.deep("extent") or node.deep("ext")
        grid = picture(self.files.get(self.links.get((blip.get("r:embed") or blip.get("embed", "")) if blip else "", "")))
        if grid is None:
            return None
        return grid, size.number("cx", 0) / EMU if size else grid.width * 0.75, size.number("cy", 0) / EMU if size else grid.height * 0.75

    def drawing(self, node: Node) -> Run | None:
        found = self.image(node)
        if found is None:
            return None
        grid, w, h = found
        anchor = node.child("anchor")
        if anchor is None:
            return Run(image=grid, size=(w, h))
        place = lambda tag: float((anchor.at(tag, "posOffset") or Node("", text="0")).text or 0) / EMU
        wrap = "topAndBottom" if anchor.child("wrapTopAndBottom") else "none" if anchor.child("wrapNone") else "square"
        base = lambda tag, margin: margin if (anchor.child(tag) or Node("")).get("relativeFrom", "") in ("column", "margin", "paragraph", "text") else 0.0
        self.floats.append(Float(grid, (place("positionH") + base("positionH", self.margins[0]), place("positionV") + base("positionV", self.margins[1]), w, h), wrap))
        return None

    def paragraph(self, p: Node) -> Paragraph:
        own = p.child("pPr")
        name = (own.child("pStyle").get("val") if own and own.child("pStyle") else None) or self.default_id
        para, base = self.para_default, self.run_default
        for s in self.chain(name):
            para, base = merged(para, para_changes(s.child("pPr"))), merged(base, run_changes(s.child("rPr")))
        para = merged(para, para_changes(own))
        number = own.child("numPr") if own else None
        if number is not None:
            read = lambda tag, default: (number.child(tag) or Node("")).get("val", default)
            bullet = self.levels.get((read("numId", ""), read("ilvl", "0")), "•" if read("numId", "0") != "0" else None)
            para = merged(para, {"bullet": bullet, "left": para.left or 18.0 * (1 + float(read("ilvl", "0")))})
        runs: list[Run] = []

        def walk(node: Node) -> None:
            for c in node.children:
                if c.tag == "r":
                    rpr = c.child("rPr")
                    style = base
                    for s in self.chain(rpr.child("rStyle").get("val") if rpr and rpr.child("rStyle") else None):
                        style = merged(style, run_changes(s.child("rPr")))
                    style = merged(style, run_changes(rpr))
                    for x in c.children:
                        if x.tag == "t":
                            runs.append(Run(x.text, style))
                        elif x.tag == "tab":
                            runs.append(Run("\t", style))
                        elif x.tag in ("br", "cr"):
                            runs.append(Run("\f" if x.get("type") == "page" else "\n", style))
                        elif x.tag in ("drawing", "pict", "AlternateContent") and (image := self.drawing(x.deep("drawing") or x)):
                            runs.append(image)
                elif c.tag in ("hyperlink", "ins", "smartTag", "sdt", "sdtContent", "fldSimple"):
                    walk(c)

        walk(p)
        return Paragraph(runs, para)

    def table(self, t: Node) -> Table:
        out = Table(widths=[c.number("w", 0) / TWIP for c in (t.child("tblGrid") or Node("")).all("gridCol")])
        borders = t.at("tblPr", "tblBorders")
        for s in self.chain((t.at("tblPr", "tblStyle") or Node("")).get("val")):
            borders = borders or s.at("tblPr", "tblBorders")
        edge = next((e for e in borders.children if e.get("val", "none") not in ("none", "nil")), None) if borders else None
        if edge is not None:
            out.border = (edge.number("sz", 4) / 8, _color(edge.get("color")))
        for row in t.all("tr"):
            cells = []
            for c in row.all("tc"):
                pr = c.child("tcPr") or Node("")
                shade = pr.child("shd")
                cells.append(TableCell(self.blocks(c), int((pr.child("gridSpan") or Node("")).number("val", 1)), _color(shade.get("fill")) if shade else None))
            out.rows.append(cells)
        return out

    def blocks(self, parent: Node) -> list:
        out: list = []
        for c in parent.children:
            if c.tag == "p":
                out.append(self.paragraph(c))
            elif c.tag == "tbl":
                out.append(self.table(c))
            elif c.tag in ("sdt", "sdtContent"):
                out += self.blocks(c)
        return out

    def document(self, body: Node) -> TextDocument:
        section = body.child("sectPr") or body.deep("sectPr") or Node("")
        size, margin = section.child("pgSz"), section.child("pgMar")
        page = (_twips(size, "w") or 612.0, _twips(size, "h") or 792.0)
        read = lambda n: 72.0 if (v := _twips(margin, n)) is None else v
        self.margins = (read("left"), read("top"), read("right"), read("bottom"))
        return TextDocument(self.blocks(body), page, self.margins, self.floats)


def parse_docx(data: bytes) -> TextDocument:
    files = read_zip(data)
    if PART not in files:
        raise DecodeError("Invalid DOCX: no document")
    body = parse_xml(files[PART]).child("body")
    if body is None:
        raise DecodeError("Invalid DOCX: no body")
    return _Reader(files).document(body)


def decode_docx(data: bytes) -> Grid:
    return draw_document(parse_docx(data))
