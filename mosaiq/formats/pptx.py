"""PPTX: the first slide of a presentation. Groups, tables and connectors are left out."""

from __future__ import annotations

from mosaiq.codecs.base import DecodeError, Grid
from mosaiq.formats.containers import Node, parse_xml, read_zip, relations
from mosaiq.formats.embedded import picture
from mosaiq.formats.sheet import tint
from mosaiq.formats.slide import Shape, Slide, TextPara, TextRun, draw_slide

EMU = 12700.0
#: How slides name theme colours.
ALIASES = {"tx1": "dk1", "bg1": "lt1", "tx2": "dk2", "bg2": "lt2"}


class _Reader:
    def __init__(self, files: dict[str, bytes]):
        self.files = files
        self.theme: dict[str, str] = {}

    def xml(self, name: str | None) -> Node | None:
        return parse_xml(self.files[name]) if name in self.files else None

    def color(self, holder: Node | None) -> str | None:
        """The colour within a solid fill."""
        if holder is None:
            return None
        for c in holder.children:
            value = c.get("val") if c.tag == "srgbClr" else self.theme.get(ALIASES.get(c.get("val", ""), c.get("val", ""))) if c.tag == "schemeClr" else c.get("lastClr") if c.tag == "sysClr" else None
            if value:
                mod, off = c.child("lumMod"), c.child("lumOff")
                if mod is not None:
                    m, o = mod.number("val", 1e5) / 1e5, off.number("val", 0) / 1e5 if off else 0.0
                    value = tint(value, o) if o else tint(value, m - 1)
                return value
        return None

    def places(self, root: Node | None) -> list[tuple[str | None, str | None, tuple]]:
        """(type, idx, box) of a layout's or master's placeholders."""
        out = []
        for sp in (root.at("cSld", "spTree") or Node("")).all("sp") if root else []:
            ph, box = sp.deep("ph"), self.box(sp)
            if ph is not None and box is not None:
                out.append((ph.get("type", "body" if ph.get("idx") else None), ph.get("idx"), box))
        return out

    def box(self, sp: Node) -> tuple[float, float, float, float] | None:
        form = (sp.child("spPr") or Node("")).child("xfrm")
        off, ext = (form.child("off"), form.child("ext")) if form else (None, None)
        if off is None or ext is None:
            return None
        return off.number("x", 0) / EMU, off.number("y", 0) / EMU, ext.number("cx", 0) / EMU, ext.number("cy", 0) / EMU

    def placed(self, ph: Node) -> tuple[float, float, float, float] | None:
        """Layout by type, layout by number, master by type, master by number."""
        kind, number = ph.get("type", "body" if ph.get("idx") else None), ph.get("idx")
        same = {"ctrTitle": "title", "subTitle": "body"}
        for places in (self.layout, self.master):
            for want, k in ((kind, 0), (number, 1)):
                found = next((p[2] for p in places if want is not None and p[k] == want), None)
                found = found or (next((p[2] for p in places if p[0] == same.get(want)), None) if k == 0 and want in same else None)
                if found:
                    return found
        return None

    def text(self, body: Node | None, size: float, bold: bool, color: str | None) -> list[TextPara]:
        out = []
        for p in body.all("p") if body else []:
            pr = p.child("pPr") or Node("")
            level = int(pr.number("lvl", 0))
            para = TextPara(align={"ctr": "center", "r": "right"}.get(pr.get("algn", ""), "left"), indent=(pr.number("marL", level * 342900) or 0) / EMU)
            char = pr.child("buChar")
            para.bullet = char.get("char") if char else "1." if pr.child("buAutoNum") else None
            for r in p.children:
                if r.tag in ("r", "fld"):
                    own = r.child("rPr") or Node("")
                    para.runs.append(TextRun((r.child("t") or Node("")).text, (own.number("sz") or size * 100) / 100, own.get("b", "1" if bold else "0") in ("1", "true"), self.color(own.child("solidFill")) or color))
                elif r.tag == "br":
                    para.runs.append(TextRun("\n", size))
            if not para.runs:
                para.runs.append(TextRun("", ((p.child("endParaRPr") or Node("")).number("sz") or size * 100) / 100))
            out.append(para)
        return out

    def shapes(self, tree: Node, links: dict[str, str], texts: bool = True) -> list[Shape]:
        out = []
        for sp in tree.children:
            if sp.tag == "pic":
                blip, box = sp.deep("blip"), self.box(sp)
                grid = picture(self.files.get(links.get((blip.get("r:embed") or blip.get("embed", "")) if blip else "", "")))
                if grid is not None and box is not None:
                    out.append(Shape(box, image=grid))
            elif sp.tag == "sp":
                ph = sp.deep("ph")
                if ph is not None and not texts:
                    continue
                box = self.box(sp) or (self.placed(ph) if ph is not None else None)
                if box is None:
                    continue
                pr, kind = sp.child("spPr") or Node(""), (ph.get("type", "body") if ph is not None else "")
                title = kind in ("title", "ctrTitle")
                body = sp.child("txBody")
                frame = (body.child("bodyPr") if body else None) or Node("")
                anchor = {"ctr": "middle", "b": "bottom", "t": "top"}.get(frame.get("anchor", "ctr" if title else "t"), "top")
                edge = pr.child("ln")
                out.append(Shape(
                    box, self.text(body, 44.0 if title else 28.0 if kind == "subTitle" or ph is not None else 18.0, False, self.theme.get("dk1")), anchor, self.color(pr.child("solidFill")), self.color(edge.child("solidFill")) if edge else None,
                    (edge.number("w", 9525) if edge else 9525) / EMU, round=(pr.child("prstGeom") or Node("")).get("prst") == "ellipse", shadow=(pr.deep("outerShdw") is not None),
                ))
        return out


def parse_pptx(data: bytes) -> Slide:
    files = read_zip(data)
    r = _Reader(files)
    show = r.xml("ppt/presentation.xml")
    if show is None:
        raise DecodeError("Invalid PPTX: no presentation")
    rels = relations(files, "ppt/presentation.xml")
    first = next(iter((show.child("sldIdLst") or Node("")).children), None)
    name = rels.get(first.get("r:id", "")) if first is not None else None
    slide = r.xml(name) or r.xml("ppt/slides/slide1.xml")
    if slide is None:
        raise DecodeError("Invalid PPTX: no slides")
    name = name or "ppt/slides/slide1.xml"
    links = relations(files, name)
    layout_name = next((t for t in links.values() if "/slideLayouts/" in t), None)
    layout, layout_links = r.xml(layout_name), relations(files, layout_name) if layout_name else {}
    master_name = next((t for t in layout_links.values() if "/slideMasters/" in t), None)
    master, master_links = r.xml(master_name), relations(files, master_name) if master_name else {}
    from mosaiq.formats.xlsx import theme_colors

    r.theme = theme_colors(files, next((t for t in master_links.values() if "/theme/" in t), "ppt/theme/theme1.xml"))
    r.layout, r.master = r.places(layout), r.places(master)
    size = show.child("sldSz")
    out = Slide((size.number("cx", 9144000) / EMU, size.number("cy", 6858000) / EMU) if size else (720.0, 540.0))
    for root, own in ((slide, links), (layout, layout_links), (master, master_links)):
        back = root.at("cSld", "bg", "bgPr") if root else None
        if back is not None:
            out.background = r.color(back.child("solidFill"))
            blip = back.deep("blip")
            if blip is not None:
                out.picture = picture(files.get(own.get(blip.get("r:embed") or blip.get("embed", ""), "")))
            if out.background or out.picture is not None:
                break
    tree = slide.at("cSld", "spTree")
    out.shapes = r.shapes(tree, links) if tree else []
    return out


def decode_pptx(data: bytes) -> Grid:
    return draw_slide(parse_pptx(data))
