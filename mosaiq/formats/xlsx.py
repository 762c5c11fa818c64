"""XLSX: the first sheet of a workbook."""

from __future__ import annotations

import re

from mosaiq.codecs.base import DecodeError, Grid
from mosaiq.formats.containers import Node, parse_xml, read_zip, relations
from mosaiq.formats.embedded import picture
from mosaiq.formats.sheet import INDEXED, Cell, CellStyle, Chart, Sheet, draw_sheet, tint

EMU = 12700.0
#: Theme colours by index; the dark and light pairs are swapped against their order in the theme.
THEME = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6")


def column_of(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def row_of(ref: str) -> int:
    digits = re.sub("[^0-9]", "", ref)
    return int(digits) - 1 if digits else -1


def _xml(files: dict[str, bytes], name: str | None) -> Node | None:
    return parse_xml(files[name]) if name in files else None


def theme_colors(files: dict[str, bytes], name: str) -> dict[str, str]:
    root, out = _xml(files, name), {}
    scheme = root.deep("clrScheme") if root else None
    for c in scheme.children if scheme else []:
        for own in c.children:
            out[c.tag] = own.get("lastClr") or own.get("val") or "000000"
    return out


class _Styles:
    def __init__(self, root: Node | None, theme: dict[str, str]):
        self.theme, self.cells = theme, []
        if root is None:
            return
        some = lambda name: (root.child(name) or Node("")).children
        codes = {int(n.number("numFmtId", -1)): n.get("formatCode", "") for n in some("numFmts")}
        fonts, fills, borders = some("fonts"), some("fills"), some("borders")
        for xf in some("cellXfs"):
            s = CellStyle()
            pick = lambda items, name: items[int(xf.number(name, 0))] if int(xf.number(name, 0)) < len(items) else None  # noqa: B023, E731
            if font := pick(fonts, "fontId"):
                s.size = (font.child("sz") or Node("")).number("val", 11.0)
                bold = font.child("b")
                s.bold = bold is not None and bold.get("val", "1") not in ("0", "false")
                s.color = self.color(font.child("color"))
            if (fill := pick(fills, "fillId")) and (pattern := fill.child("patternFill")) and pattern.get("patternType", "none") not in ("none", "gray125"):
                s.fill = self.color(pattern.child("fgColor")) or self.color(pattern.child("bgColor"))
            if border := pick(borders, "borderId"):
                for side in border.children:
                    if side.tag in ("top", "bottom", "left", "right") and side.get("style", "none") != "none":
                        s.borders[side.tag] = (side.get("style"), self.color(side.child("color")))
            if align := xf.child("alignment"):
                s.align = align.get("horizontal", "general")
            s.number_format = int(xf.number("numFmtId", 0))
            s.code = codes.get(s.number_format, "")
            self.cells.append(s)

    def color(self, node: Node | None) -> str | None:
        """rgb before theme before index."""
        if node is None:
            return None
        if value := node.get("rgb"):
            return tint(value[-6:], node.number("tint"))
        if (k := node.number("theme")) is not None:
            name = THEME[int(k)] if int(k) < len(THEME) else ""
            return tint(self.theme[name], node.number("tint")) if name in self.theme else None
        if (k := node.number("indexed")) is not None:
            return INDEXED[int(k)] if int(k) < len(INDEXED) else "000000" if k == 64 else None
        return None


def shared_strings(root: Node | None) -> list[str]:
    out = []
    for item in root.all("si") if root else []:
        runs = [r.child("t") for r in item.all("r")]
        out.append("".join(t.text for t in runs if t) if runs else (item.child("t") or Node("")).text)
    return out


def parse_chart(root: Node, theme: dict[str, str]) -> Chart | None:
    """The first plot of a known kind, with its cached values."""
    plot = root.deep("plotArea")
    names = {"doughnutChart": "doughnut", "pieChart": "pie", "pie3DChart": "pie", "barChart": "bar", "bar3DChart": "bar", "lineChart": "line", "scatterChart": "line", "areaChart": "area"}
    own = next((c for c in plot.children if c.tag in names), None) if plot else None
    if own is None:
        return None
    series, colors = [], []
    pie = names[own.tag] in ("pie", "doughnut")

    def color(holder: Node | None) -> str | None:
        fill = holder.at("spPr", "solidFill") if holder else None
        if fill is None or not fill.children:
            return None
        first = fill.children[0]
        return first.get("val") if first.tag == "srgbClr" else theme.get(first.get("val", ""))

    for s in own.all("ser"):
        held = s.child("val") or s.child("yVal")
        cache = (held.deep("numCache") or held.deep("numLit")) if held else None
        values = []
        for pt in cache.all("pt") if cache else []:
            v = pt.child("v")
            try:
                values.append(float(v.text) if v else 0.0)
            except ValueError:
                values.append(0.0)
        series.append(values)
        if pie:
            points = {int(p.child("idx").number("val", 0)): color(p) for p in s.all("dPt") if p.child("idx")}
            from mosaiq.formats.sheet import SERIES

            colors = [points.get(i) or theme.get(f"accent{i % 6 + 1}") or SERIES[i % 6] for i in range(len(values))]
            break
        colors.append(color(s) or theme.get(f"accent{len(colors) % 6 + 1}") or "")
    return Chart(names[own.tag], series, colors if all(colors) else []) if any(series) else None


def _anchor(node: Node) -> tuple | None:
    begin, end, size = node.child("from"), node.child("to"), node.child("ext")
    read = lambda n, k: float((n.child(k) or Node("")).text.strip() or 0)
    spot = lambda n: (int(read(n, "col")), read(n, "colOff") / EMU, int(read(n, "row")), read(n, "rowOff") / EMU)
    if begin is None:
        return None
    if end is not None:
        return (*spot(begin), *spot(end))
    if size is not None:
        return (*spot(begin), None, size.number("cx", 0) / EMU, None, size.number("cy", 0) / EMU)
    return None


def parse_xlsx(data: bytes) -> Sheet:
    files = read_zip(data)
    book = _xml(files, "xl/workbook.xml")
    if book is None:
        raise DecodeError("Invalid XLSX: no workbook")
    rels = relations(files, "xl/workbook.xml")
    sheets = (book.child("sheets") or Node("")).all("sheet")
    part = rels.get(sheets[0].get("r:id") or sheets[0].get("id", "")) if sheets else None
    root = _xml(files, part) or _xml(files, "xl/worksheets/sheet1.xml")
    if root is None:
        raise DecodeError("Invalid spreadsheet: no sheets")
    theme = theme_colors(files, next((t for t in rels.values() if "/theme/" in t), "xl/theme/theme1.xml"))
    strings = shared_strings(_xml(files, "xl/sharedStrings.xml"))
    out = Sheet(styles=_Styles(_xml(files, "xl/styles.xml"), theme).cells)
    if form := root.child("sheetFormatPr"):
        out.default_height = form.number("defaultRowHeight", out.default_height)
        if (w := form.number("defaultColWidth")) is not None:
            out.default_width = w * 7 + 5
    hidden = lambda n: n.get("hidden", "0") in ("1", "true")
    for c in (root.child("cols") or Node("")).all("col"):
        out.widths.append((int(c.number("min", 1)) - 1, int(c.number("max", 1)) - 1, c.number("width", 8.43) * 7 + 5, hidden(c)))
    for r, row in enumerate((root.child("sheetData") or Node("")).all("row")):
        number = int(row.number("r", r + 1)) - 1
        was = out.heights.get(number, (None, False))
        out.heights[number] = (row.number("ht"), was[1] or hidden(row))
        for k, c in enumerate(row.all("c")):
            ref = c.get("r")
            kind, v = c.get("t", ""), c.child("v")
            value = v.text if v else ""
            if kind == "s":
                value = strings[int(value)] if value.strip().isdigit() and int(value) < len(strings) else ""
            elif kind == "b":
                value = "TRUE" if value == "1" else "FALSE"
            elif kind == "inlineStr":
                value = "".join(shared_strings(Node("", children=[Node("si", children=i.children)]))[0] for i in c.all("is"))
            out.cells.append(Cell(row_of(ref) if ref else number, column_of(ref) if ref else k, value, kind in ("", "n") and bool(value), int(c.number("s", 0))))
    for m in (root.child("mergeCells") or Node("")).all("mergeCell"):
        a, _, b = (m.get("ref") or "").partition(":")
        if b:
            out.merges.append((row_of(a), column_of(a), row_of(b), column_of(b)))
    drawing = root.child("drawing")
    name = relations(files, part or "").get(drawing.get("r:id") or drawing.get("id", "")) if drawing else None
    if name in files:
        links = relations(files, name)
        for a in parse_xml(files[name]).children:
            spot = _anchor(a)
            if spot is None:
                continue
            blip, graph = a.deep("blip"), a.deep("chart")
            try:
                if blip is not None and (grid := picture(files.get(links.get(blip.get("r:embed") or blip.get("embed", ""), "")))) is not None:
                    out.images.append((spot, grid))
                elif graph is not None and (root2 := _xml(files, links.get(graph.get("r:id") or graph.get("id", "")))) is not None and (chart := parse_chart(root2, theme)):
                    out.charts.append((spot, chart))
            except (DecodeError, ValueError, AttributeError):
                continue
    return out


def decode_xlsx(data: bytes) -> Grid:
    return draw_sheet(parse_xlsx(data))
