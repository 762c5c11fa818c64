import io
import zipfile
import zlib

import numpy as np
import pytest

from mosaiq.codecs import png
from mosaiq.codecs.base import DecodeError
from mosaiq.formats import containers, pdf, pdf_file, svg
from tests import test_codecs as made


def zipped(files, **kw):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_zip_and_xml():
    assert containers.read_zip(zipped({"a/b.txt": "x" * 1000, "c": ""})) == {"a/b.txt": b"x" * 1000, "c": b""}
    with pytest.raises(DecodeError):
        containers.read_zip(b"PK")
    root = containers.parse_xml('<?xml version="1.0"?><!-- c --><w:a x:id="1 &amp; 2"><b>t&lt;<c/>u</b><b n=\'2\'/></w:a>')
    assert root.tag == "a" and root.get("id") == "1 & 2" and root.children[0].text == "t<u" and root.all("b")[1].number("n") == 2
    assert root.deep("c") is root.children[0].children[0]
    with pytest.raises(DecodeError):
        containers.parse_xml("<a>" * 300)
    assert containers.join_path("xl/worksheets", "../media/i.png") == "xl/media/i.png" and containers.join_path("ppt", "/x/y") == "x/y"


def rgb(grid, x, y):
    return tuple(int(v) for v in grid.rgba[y, x, :3])


def test_svg_shapes():
    g = svg.decode_svg(b"""<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 100 50"><defs><linearGradient id="g"><stop stop-color="#f00"/><stop stop-color="#00f"/></linearGradient><rect id="r" width="5" height="5"/></defs>
      <rect x="0" y="0" width="20" height="20" fill="red"/><g transform="translate(30,0) scale(2)"><circle cx="5" cy="5" r="4" style="fill:rgb(0,128,0)"/></g>
      <path d="M60 0h10v10h-10z" fill="url(#g)"/><use href="#r" x="80" y="0" fill="blue"/><rect width="5" height="5" y="30" display="none"/><polygon points="0,50 10,50 5,40" fill="#0ff"/>
      <text x="50" y="45" font-size="10" fill="#ff00ff">ab</text><line x1="20" y1="30" x2="40" y2="30" stroke="black" stroke-width="2"/></svg>""")
    k = 10.24
    at = lambda x, y: rgb(g, int(x * k), int(y * k))
    assert (g.width, g.height) == (1024, 512)
    assert at(10, 10) == (255, 0, 0) and at(40, 10) == (0, 128, 0) and at(65, 5) == (128, 0, 128) and at(82, 2) == (0, 0, 255)
    assert at(2, 32) == (255, 255, 255) and at(5, 48) == (0, 255, 255) and at(30, 30) == (0, 0, 0)
    assert (g.rgba[..., :3] == (255, 0, 255)).all(-1).any()


def test_svg_paths():
    p = svg.parse_path("M0 0L10,0 10 10H0V0zm5 5 l1 1c0 0 1 1 2 2s1 1 2 2q1 1 2 0t2 0a1 1 0 01.5.5")
    assert len(p.parts) == 2 and p.parts[0][2]
    assert svg.transform("translate(1,2) scale(3)") == (3, 0, 0, 3, 1, 2)
    assert svg.length("1in") == 96 and svg.length("2.54cm") == pytest.approx(96) and svg.color("#abc") == (170, 187, 204)
    with pytest.raises(DecodeError):
        svg.decode_svg(b"<html></html>")


def make_pdf(content, resources=b"", extra=(), box=b"[0 0 100 100]", page=b"", packed=False):
    body = zlib.compress(content) if packed else content
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox " + box + b" >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << " + resources + b" >> " + page + b" >>",
               b"<< /Length %d %s>>\nstream\n" % (len(body), b"/Filter /FlateDecode " if packed else b"") + body + b"\nendstream", *extra]
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, at)


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_page(packed):
    image = zlib.compress(bytes([255, 0, 0, 0, 255, 0]))
    extra = [b"<< /Type /XObject /Subtype /Image /Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter /FlateDecode /Length %d >>\nstream\n" % len(image) + image + b"\nendstream",
             b"<< /Type /XObject /Subtype /Form /BBox [0 0 9 9] /Matrix [1 0 0 1 60 0] /Length 27 >>\nstream\n0 0 1 rg 0 0 10 10 re f    \nendstream", b"<< /ca 0.5 >>"]
    content = b"q 1 0 0 rg 10 80 20 10 re f Q q 20 0 0 20 40 40 cm /I Do Q /F Do /G gs 0 g 80 80 10 10 re f BT /F1 20 Tf 5 5 Td (A\\050\\)) Tj ET 0 1 0 RG 4 w 0 60 m 30 60 l S"
    g = pdf.decode_pdf(make_pdf(content, b"/XObject << /I 5 0 R /F 6 0 R >> /ExtGState << /G 7 0 R >>", extra, packed=packed))
    k = 10.24
    at = lambda x, y: rgb(g, int(x * k), int((100 - y) * k))
    assert at(20, 85) == (255, 0, 0) and at(45, 50) == (255, 0, 0) and at(55, 50) == (0, 255, 0) and at(65, 5) == (0, 0, 255) and at(85, 85) == (127, 127, 127) and at(10, 60) == (0, 255, 0)
    assert (g.rgba[int(75 * k) :, : int(45 * k), 0] == 127).any()


@pytest.mark.parametrize("turn,x,y", [(0, 5, 95), (90, 5, 5), (180, 195, 5), (270, 95, 195)])
def test_pdf_rotation(turn, x, y):
    g = pdf.decode_pdf(make_pdf(b"1 0 0 rg 0 0 20 20 re f", box=b"[0 0 200 100]", page=b"/Rotate %d" % turn))
    k = 1024 / 200
    assert rgb(g, int(x * k), int(y * k)) == (255, 0, 0)
    assert (g.width, g.height) == ((512, 1024) if turn in (90, 270) else (1024, 512))


def test_pdf_syntax_and_filters():
    r = pdf_file.Reader(b"<< /A#20B [1 -2.5 (a\\)\\n(b)) <414> /N true null 3 0 R] >> % c\n")
    got = r.next()
    assert got == {"A B": [1, -2.5, b"a)\n(b)", b"A@", "N", True, None, pdf_file.Ref(3, 0)]}
    assert pdf_file._ascii85(b"87cURD]i,\"Ebo80~>")[:12] == b"Hello World!"
    doc = pdf_file.Document(make_pdf(b""))
    raw = made.lzw_encode(list(b"hello hello hello"), 8, False, 1)
    assert doc.filtered(pdf_file.Stream({"Filter": pdf_file.Name("LZWDecode")}, raw)) == b"hello hello hello"
    assert doc.filtered(pdf_file.Stream({"Filter": [pdf_file.Name("AHx")]}, b"68 65>")) == b"he"
    broken = make_pdf(b"1 0 0 rg 0 0 100 100 re f").replace(b"startxref", b"startxxxx")
    assert rgb(pdf.decode_pdf(broken), 500, 500) == (255, 0, 0)
    assert pdf.to_unicode(b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <04> <0061> <05> <06> [<0031> <0032>] endbfrange") == {1: 65, 2: 97, 3: 98, 4: 99, 5: 49, 6: 50}
    assert pdf.cid_widths([1, [500, 600], 5, 7, 250]) == {1: 500, 2: 600, 5: 250, 6: 250, 7: 250}
    with pytest.raises(DecodeError):
        pdf.decode_pdf(b"%PDF-1.4 nothing")


def test_pdf_object_streams():
    packed = zlib.compress(b"1 0 2 33 << /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 10 10] >>".replace(b"2 33", b"2 34"))
    objects = {3: b"<< /Type /Page /Contents 4 0 R >>", 4: b"<< /Length 24 >>\nstream\n0 1 0 rg 0 0 10 10 re f  \nendstream", 5: b"<< /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream"}
    out, places = b"%PDF-1.5\n", {}
    for n, o in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + o + b"\nendobj\n"
    at = len(out)
    rows = [(0, 0, 0), (2, 5, 0), (2, 5, 1), (1, places[3], 0), (1, places[4], 0), (1, places[5], 0), (1, at, 0)]
    table = zlib.compress(b"".join(bytes([a]) + b.to_bytes(3, "big") + bytes([c]) for a, b, c in rows))
    out += b"6 0 obj << /Type /XRef /Size 7 /W [1 3 1] /Root 1 0 R /Filter /FlateDecode /Length %d >>\nstream\n" % len(table) + table + b"\nendstream endobj\nstartxref\n%d\n%%%%EOF" % at
    assert rgb(pdf.decode_pdf(out), 500, 500) == (0, 255, 0)


def test_png_data_uri():
    import base64

    g = made.picture(4, 4, alpha=False)
    uri = base64.b64encode(png.encode_png(g)).decode()
    got = svg.decode_svg(f'<svg width="4" height="4"><image href="data:image/png;base64,{uri}" width="4" height="4"/></svg>'.encode())
    assert np.array_equal(got.rgba[128::256, 128::256], g.rgba)


def xlsx_file():
    image = png.encode_png(made.Grid(np.full((2, 2, 4), (0, 200, 0, 255), np.uint8)))
    return zipped({
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="A" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="t" Target="theme/theme1.xml"/></Relationships>',
        "xl/theme/theme1.xml": '<a:theme xmlns:a="a"><a:clrScheme><a:accent1><a:srgbClr val="102030"/></a:accent1></a:clrScheme></a:theme>',
        "xl/sharedStrings.xml": "<sst><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>",
        "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="$0.00"/></numFmts><fonts><font><sz val="11"/></font><font><b/><sz val="20"/><color rgb="FFFF0000"/></font></fonts>'
        '<fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor theme="4"/></patternFill></fill></fills><borders><border/></borders>'
        '<cellXfs><xf/><xf fontId="1" fillId="1" numFmtId="164"><alignment horizontal="center"/></xf></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": '<worksheet xmlns:r="r"><cols><col min="2" max="3" width="20"/><col min="3" max="3" hidden="1"/></cols><sheetData><row r="1" ht="30"><c r="A1" t="s"><v>1</v></c><c r="B1" s="1"><v>2.5</v></c></row>'
        '<row r="3"><c r="A3" t="b"><v>1</v></c><c r="B3" t="inlineStr"><is><t>in</t></is></c><c r="C3" t="s"><v>99</v></c></row></sheetData><mergeCells><mergeCell ref="A5:B6"/></mergeCells><drawing r:id="d"/></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": '<Relationships><Relationship Id="d" Target="../drawings/drawing1.xml"/></Relationships>',
        "xl/drawings/drawing1.xml": '<wsDr xmlns:r="r"><oneCellAnchor><from><col>3</col><colOff>0</colOff><row>10</row><rowOff>0</rowOff></from><ext cx="1270000" cy="1270000"/><pic><blipFill><blip r:embed="i"/></blipFill></pic></oneCellAnchor>'
        '<twoCellAnchor><from><col>0</col><colOff>0</colOff><row>10</row><rowOff>0</rowOff></from><to><col>2</col><colOff>0</colOff><row>20</row><rowOff>0</rowOff></to><graphicFrame><chart r:id="c"/></graphicFrame></twoCellAnchor></wsDr>',
        "xl/drawings/_rels/drawing1.xml.rels": '<Relationships><Relationship Id="i" Target="../media/i.png"/><Relationship Id="c" Target="../charts/chart1.xml"/></Relationships>',
        "xl/charts/chart1.xml": '<chartSpace><chart><plotArea><pieChart><ser><val><numRef><numCache><pt idx="0"><v>1</v></pt><pt idx="1"><v>3</v></pt></numCache></numRef></val></ser></pieChart></plotArea></chart></chartSpace>',
        "xl/media/i.png": image,
    })


def test_xlsx():
    from mosaiq.formats import sheet, xlsx

    s = xlsx.parse_xlsx(xlsx_file())
    assert [(c.row, c.col, c.value, c.numeric) for c in s.cells] == [(0, 0, "rich", False), (0, 1, "2.5", True), (2, 0, "TRUE", False), (2, 1, "in", False), (2, 2, "", False)]
    assert s.merges == [(4, 0, 5, 1)] and s.heights[0] == (30.0, False) and s.styles[1].fill == "102030" and s.styles[1].bold and s.widths[0] == (1, 2, 145.0, False)
    assert len(s.images) == 1 and s.charts[0][1].series == [[1.0, 3.0]]
    g = sheet.draw_sheet(s)
    k = 1024 / 842
    x = (s.default_width + 145 * 2 + 50) * k
    assert (g.width, g.height) == (1024, 724) and rgb(g, int(70 * k), int(4 * k)) == (16, 32, 48)
    assert rgb(g, int(x), int((30 + 9 * 15 + 50) * k)) == (0, 200, 0)
    with pytest.raises(DecodeError):
        xlsx.decode_xlsx(zipped({"a": ""}))


def test_number_formats_and_axis():
    from mosaiq.formats import sheet

    cases = {("5", 0, ""): "5", ("1.23456789012", 0, ""): "1.23456789", ("2.345", 2, ""): "2.35", ("2.5", 3, ""): "2.500", ("1234.5", 5, ""): "$1234.50", ("0.125", 9, ""): "13%", ("0.125", 10, ""): "12.50%", ("43000", 14, ""): "43000",
             ("1234567.891", 37, ""): "1,234,567.89", ("x", 2, ""): "x", ("3", 164, "0.00"): "3.00", ("3", 164, "#,##0"): "3", ("0.5", 164, "0%"): "50%"}
    for (value, number, code), want in cases.items():
        assert sheet.format_number(value, number, code) == want
    assert sheet.axis([3, 97]) == (0, 100) and sheet.axis([-5, 5]) == (-6, 6) and sheet.axis([0]) == (0, 1)
    assert sheet.tint("808080", 0.5) == "c0c0c0" and sheet.tint("808080", -0.5) == "404040"


def ole2(streams):
    """A compound file with 512-byte sectors; all streams of at least 4096 bytes."""
    import struct

    sectors, entries, table = [], [], []

    def put(body):
        first = len(sectors)
        n = max(1, -(-len(body) // 512))
        for i in range(n):
            sectors.append(body[512 * i : 512 * (i + 1)].ljust(512, b"\0"))
            table.append(first + i + 1 if i < n - 1 else 0xFFFFFFFE)
        return first

    for name, body in streams.items():
        entries.append((name, 2, put(body), len(body)))
    entry = lambda name, kind, start, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB3I", 2 * len(name) + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF) + b"\0" * 36 + struct.pack("<IQ", start, size)
    folder = b"".join([entry("Root Entry", 5, 0xFFFFFFFE, 0), *(entry(*e) for e in entries)])
    first_dir = put(folder.ljust(-(-len(folder) // 512) * 512, b"\0"))
    fat = len(sectors)
    table.append(0xFFFFFFFD)
    sectors.append(struct.pack(f"<{len(table)}I", *table).ljust(512, b"\xff"))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH6xIIIIIIIII", 62, 3, 0xFFFE, 9, 6, 0, 1, first_dir, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head.ljust(76, b"\0") + struct.pack("<109I", fat, *[0xFFFFFFFF] * 108) + b"".join(sectors)


def test_xls():
    import struct

    from mosaiq.formats import xls

    rec = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    text = lambda s: struct.pack("<HB", len(s), 0) + s.encode()
    long = "x" * 20
    sst = struct.pack("<II", 2, 2) + text("first") + struct.pack("<HB", 20, 0) + long[:8].encode()
    globals_ = rec(xls.BOF, b"\0\6\5\0") + rec(xls.FONT, struct.pack("<HHHH", 400, 0, 10, 700) + b"\0" * 6) + rec(xls.XF, struct.pack("<HH", 0, 2) + b"\0\0" + bytes([2]) + b"\0" * 13)
    globals_ += rec(xls.SST, sst) + rec(xls.CONTINUE, b"\1" + long[8:].encode("utf-16-le"))
    cells = rec(xls.BOF, b"\0\6\x10\0") + rec(xls.LABELSST, struct.pack("<HHHI", 0, 0, 0, 1)) + rec(xls.NUMBER, struct.pack("<HHHd", 1, 1, 0, 2.5)) + rec(xls.RK, struct.pack("<HHHI", 2, 0, 0, 7 << 2 | 2))
    cells += rec(xls.MULRK, struct.pack("<HHHIHIH", 3, 0, 0, 250 << 2 | 3, 0, 5 << 2 | 2, 1)) + rec(xls.BOOLERR, struct.pack("<HHHBB", 4, 0, 0, 1, 0)) + rec(xls.MERGED, struct.pack("<HHHHH", 1, 5, 6, 0, 1))
    cells += rec(xls.FORMULA, struct.pack("<HHHd", 5, 3, 0, 9.0) + b"\0" * 8) + rec(xls.COLUMN, struct.pack("<HHHHH", 0, 0, 2560, 0, 0)) + rec(0x0A, b"")
    data = ole2({"Workbook": (globals_ + cells).ljust(5000, b"\0")})
    s = xls.parse_xls(data)
    assert [(c.row, c.col, c.value) for c in s.cells] == [(0, 0, long), (1, 1, "2.5"), (2, 0, "7"), (3, 0, "2.5"), (3, 1, "5"), (4, 0, "TRUE"), (5, 3, "9")]
    assert s.merges == [(5, 0, 6, 1)] and s.widths == [(0, 0, 75.0, False)] and s.styles[0].size == 20 and s.styles[0].bold and s.styles[0].align == "center" and s.styles[0].color == "FF0000"
    assert xls.decode_xls(data).width == 1024
    assert xls.decode_rk(0x3FF00000) == 1.0 and xls.decode_rk((-5 << 2 | 2) & 0xFFFFFFFF) == -5
    with pytest.raises(DecodeError):
        xls.decode_xls(b"no")


def test_docx():
    from mosaiq.formats import docx, document

    image = png.encode_png(made.Grid(np.full((2, 2, 4), (0, 200, 0, 255), np.uint8)))
    body = """<w:document xmlns:w="w" xmlns:r="r"><w:body><w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>
      <w:p><w:pPr><w:jc w:val="right"/><w:shd w:fill="FFFF00"/></w:pPr><w:r><w:rPr><w:color w:val="FF0000"/><w:u w:val="single"/></w:rPr><w:t>red </w:t><w:br/><w:t>next</w:t></w:r></w:p>
      <w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p>
      <w:tbl><w:tblPr><w:tblBorders><w:top w:val="single" w:sz="8" w:color="0000FF"/></w:tblBorders></w:tblPr><w:tblGrid><w:gridCol w:w="2000"/><w:gridCol w:w="2000"/></w:tblGrid><w:tr><w:tc><w:tcPr><w:shd w:fill="00FFFF"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>
      <w:p><w:r><w:drawing><wp:inline xmlns:wp="wp"><wp:extent cx="635000" cy="635000"/><a:blip r:embed="i"/></wp:inline></w:drawing></w:r></w:p>
      <w:p><w:r><w:br w:type="page"/><w:t>never</w:t></w:r></w:p><w:sectPr><w:pgSz w:w="10000" w:h="12000"/><w:pgMar w:left="1000" w:right="1000" w:top="1000" w:bottom="1000"/></w:sectPr></w:body></w:document>"""
    styles = '<w:styles xmlns:w="w"><w:style w:styleId="B"><w:rPr><w:b/><w:sz w:val="30"/></w:rPr></w:style><w:style w:styleId="H"><w:basedOn w:val="B"/><w:rPr><w:sz w:val="40"/></w:rPr></w:style></w:styles>'
    data = zipped({"word/document.xml": body, "word/styles.xml": styles, "word/_rels/document.xml.rels": '<Relationships><Relationship Id="i" Target="media/i.png"/></Relationships>', "word/media/i.png": image})
    doc = docx.parse_docx(data)
    head = doc.blocks[0].runs[0].style
    assert (head.size, head.bold) == (20.0, True) and doc.page == (500.0, 600.0) and doc.blocks[2].style.bullet == "•"
    items = document.layout(doc)
    assert [v[4] for v in items if v[1] == "text"] == ["Head", "red", "next", "•", "item", "a"] and not any(v[4] == "never" for v in items if v[1] == "text")
    g = document.draw_document(doc)
    seen = {tuple(c) for c in g.rgba[..., :3].reshape(-1, 3)[::7].tolist()}
    assert {(255, 255, 0), (0, 255, 255), (0, 200, 0)} <= seen and (g.rgba[..., :3] == (0, 0, 255)).all(-1).any() and (g.width, g.height) == (853, 1024)
    with pytest.raises(DecodeError):
        docx.decode_docx(zipped({"a": ""}))


def test_wrapping_beside_floats():
    from mosaiq.formats import document as d

    grid = made.picture(2, 2)
    doc = d.TextDocument([d.Paragraph([d.Run("aaaa bbbb cccc dddd eeee ffff " * 3, d.RunStyle(size=10.0))])], (200.0, 200.0), (0.0, 0.0, 0.0, 0.0), [d.Float(grid, (0.0, 0.0, 100.0, 20.0))])
    text = [(v[2], v[4]) for v in d.layout(doc) if v[1] == "text"]
    assert text[0] == (100.0, "aaaa") and min(x for x, _ in text) == 0.0
    doc.floats = [d.Float(grid, (0.0, 0.0, 100.0, 20.0), "topAndBottom")]
    assert min(v[3] for v in d.layout(doc) if v[1] == "text") > 20


def test_odt():
    from mosaiq.formats import odt

    image = png.encode_png(made.picture(2, 2, alpha=False))
    content = """<office:document-content xmlns:office="o" xmlns:text="t" xmlns:style="s" xmlns:fo="f"><office:automatic-styles><style:style style:name="P1" style:parent-style-name="Base"><style:text-properties fo:font-weight="bold" fo:font-size="20pt"/><style:paragraph-properties fo:text-align="center"/></style:style>
      </office:automatic-styles><office:body><office:text><text:p text:style-name="P1">Title<text:s text:c="2"/><text:span text:style-name="P1">x</text:span></text:p><text:list><text:list-item><text:p>one</text:p><text:list><text:list-item><text:p>two</text:p></text:list-item></text:list></text:list-item></text:list>
      <table:table xmlns:table="b"><table:table-column table:number-columns-repeated="2"/><table:table-row><table:table-cell><text:p>c1</text:p></table:table-cell><table:table-cell><text:p>c2</text:p></table:table-cell></table:table-row></table:table>
      <text:p><draw:frame xmlns:draw="d" text:anchor-type="as-char" svg:width="2cm" svg:height="2cm"><draw:image xlink:href="Pictures/i.png"/></draw:frame></text:p></office:text></office:body></office:document-content>"""
    styles = '<s xmlns:style="s" xmlns:fo="f"><styles><style:style style:name="Base"><style:text-properties fo:color="#ff0000"/></style:style></styles><automatic-styles><style:page-layout><style:page-layout-properties fo:page-width="10cm" fo:page-height="10cm" fo:margin="1cm"/></style:page-layout></automatic-styles></s>'
    doc = odt.parse_odt(zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": content, "styles.xml": styles, "Pictures/i.png": image}))
    run = doc.blocks[0].runs[0]
    assert (run.text, run.style.size, run.style.bold, run.style.color, doc.blocks[0].style.align) == ("Title", 20.0, True, "ff0000", "center")
    assert [b.style.left for b in doc.blocks[1:3]] == [18.0, 36.0] and doc.blocks[1].style.bullet and len(doc.blocks[3].rows[0]) == 2
    assert doc.page[0] == pytest.approx(283.46, abs=0.1) and doc.blocks[4].runs[0].image is not None
    assert odt.decode_odt(zipped({"content.xml": content})).height == 1024


def test_doc():
    import struct

    from mosaiq.formats import doc as word

    text = "Plain bold\rsecond line\r"
    main = bytearray(0x1000)
    struct.pack_into("<HH", main, 0, 0xA5EC, 0xC1)
    struct.pack_into("<I", main, 0x4C, len(text))
    begin = 0x600
    main[begin : begin + len(text)] = text.encode()
    table = bytearray()

    def entry(k, body):
        struct.pack_into("<II", main, 0x9A + 8 * k, len(table), len(body))
        table.extend(body)

    plc = struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, begin * 2 | 0x40000000, 0)
    entry(33, b"\2" + struct.pack("<I", len(plc)) + plc)
    fcs = [begin, begin + 6, begin + 10, begin + len(text)]
    page = bytearray(512)
    struct.pack_into("<4I", page, 0, *fcs)
    props = struct.pack("<HB", 0x0835, 1) + struct.pack("<HH", 0x4A43, 48)
    page[16:19] = bytes([0, 100, 0])
    page[200] = len(props)
    page[201 : 201 + len(props)] = props
    page[511] = 3
    main[512 * 5 : 512 * 6] = page
    entry(12, struct.pack("<II", begin, begin + len(text)) + struct.pack("<I", 5))
    page = bytearray(512)
    struct.pack_into("<3I", page, 0, begin, begin + 11, begin + len(text))
    page[12], page[25], page[511] = 0, 100, 2
    props = struct.pack("<HHB", 0, 0x2403, 1)
    page[200], page[201 : 201 + len(props)] = 3, props
    main[512 * 6 : 512 * 7] = page
    entry(13, struct.pack("<II", begin, begin + len(text)) + struct.pack("<I", 6))
    data = ole2({"WordDocument": bytes(main), "0Table": bytes(table).ljust(4096, b"\0")})
    doc = word.parse_doc(data)
    assert [(r.text, r.style.bold, r.style.size) for r in doc.blocks[0].runs] == [("Plain ", False, 10.0), ("bold", True, 24.0)]
    assert doc.blocks[1].runs[0].text == "second line" and doc.blocks[1].style.align == "center" and doc.blocks[0].style.align == "left"
    assert (word.decode_doc(data).rgba[..., 0] == 0).any()
    with pytest.raises(DecodeError):
        word.decode_doc(ole2({"Other": b"x" * 5000}))


def test_pptx():
    from mosaiq.formats import pptx

    sp = lambda ph, text, spPr="<p:spPr/>": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr>{spPr}<p:txBody><a:bodyPr/><a:p><a:pPr algn="ctr"/><a:r><a:rPr sz="2000" b="1"><a:solidFill><a:schemeClr val="accent1"/></a:solidFill></a:rPr><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    box = lambda x, y, w, h, fill="": f'<p:spPr><a:xfrm><a:off x="{x * 12700}" y="{y * 12700}"/><a:ext cx="{w * 12700}" cy="{h * 12700}"/></a:xfrm>{fill}</p:spPr>'
    wrap = lambda body: f'<p:x xmlns:p="p" xmlns:a="a" xmlns:r="r"><p:cSld><p:bg><p:bgPr><a:solidFill><a:srgbClr val="FFFFE0"/></a:solidFill></p:bgPr></p:bg><p:spTree>{body}</p:spTree></p:cSld></p:x>'
    files = {
        "ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId r:id="s"/></p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="s" Target="slides/slide9.xml"/></Relationships>',
        "ppt/slides/slide9.xml": wrap(sp('<p:ph type="title"/>', "Title") + sp('<p:ph idx="7"/>', "Body") + sp('<p:ph type="dt"/>', "lost") + sp("", "", box(10, 400, 100, 100, '<a:solidFill><a:srgbClr val="00FF00"/></a:solidFill>')) + f'<p:pic><p:blipFill><a:blip r:embed="i"/></p:blipFill>{box(300, 400, 100, 100)}</p:pic>'),
        "ppt/slides/_rels/slide9.xml.rels": '<Relationships><Relationship Id="l" Target="../slideLayouts/l.xml"/><Relationship Id="i" Target="../media/i.png"/></Relationships>',
        "ppt/slideLayouts/l.xml": wrap(sp('<p:ph type="title"/>', "", box(50, 20, 600, 80))), "ppt/slideLayouts/_rels/l.xml.rels": '<Relationships><Relationship Id="m" Target="../slideMasters/m.xml"/></Relationships>',
        "ppt/slideMasters/m.xml": wrap(sp('<p:ph type="body" idx="7"/>', "", box(50, 120, 600, 200))), "ppt/slideMasters/_rels/m.xml.rels": '<Relationships><Relationship Id="t" Target="../theme/theme2.xml"/></Relationships>',
        "ppt/theme/theme2.xml": '<a:theme xmlns:a="a"><a:clrScheme><a:accent1><a:srgbClr val="FF0000"/></a:accent1></a:clrScheme></a:theme>', "ppt/media/i.png": png.encode_png(made.Grid(np.full((2, 2, 4), (0, 0, 255, 255), np.uint8))),
    }
    s = pptx.parse_pptx(zipped(files))
    assert [x.box for x in s.shapes] == [(50, 20, 600, 80), (50, 120, 600, 200), (10, 400, 100, 100), (300, 400, 100, 100)]
    assert s.shapes[0].paras[0].runs[0].color == "FF0000" and s.shapes[0].anchor == "middle" and s.size == (720.0, 540.0)
    g = pptx.decode_pptx(zipped(files))
    k = 1024 / 720
    assert rgb(g, 5, 5) == (255, 255, 224) and rgb(g, int(50 * k), int(450 * k)) == (0, 255, 0) and rgb(g, int(350 * k), int(450 * k)) == (0, 0, 255) and (g.rgba[..., :3] == (255, 0, 0)).all(-1).any()


def test_ppt():
    import struct

    from mosaiq.formats import ppt

    rec = lambda kind, body=b"", instance=0, version=0: struct.pack("<HHI", instance << 4 | version, kind, len(body)) + body
    box = lambda kind, *bodies, instance=0: rec(kind, b"".join(bodies), instance, 15)
    style = struct.pack("<IHI", 12, 0, 0) + struct.pack("<IIHH", 5, 0x20001, 1, 30) + struct.pack("<II", 7, 0)
    outline = box(ppt.LIST, rec(ppt.PERSIST, b"\0" * 20), rec(ppt.HEADER, struct.pack("<I", 0)), rec(ppt.BYTES, b"Hello\rworld"), rec(ppt.STYLE, style), rec(ppt.PERSIST, b"\0" * 20), rec(ppt.HEADER, struct.pack("<I", 0)), rec(ppt.BYTES, b"second"))
    document = box(ppt.DOCUMENT, rec(ppt.DOCUMENT_ATOM, struct.pack("<II", 5760, 4320) + b"\0" * 32), outline)
    shape = box(ppt.SHAPE, rec(ppt.SP, b"\0" * 8, 1), rec(ppt.OPTIONS, struct.pack("<HI", 0x181, 0x0000FF), 1), rec(ppt.CLIENT_ANCHOR, struct.pack("<hhhh", 80, 160, 960, 400)), box(ppt.TEXTBOX, rec(3998, b"\0\0\0\0")))
    slide = box(ppt.SLIDE, rec(1007, b"\0" * 24), box(1036, box(ppt.DRAWING, box(ppt.GROUP, shape))))
    data = ole2({"PowerPoint Document": (document + slide).ljust(5000, b"\0")})
    s = ppt.parse_ppt(data)
    assert s.size == (720.0, 540.0) and s.shapes[0].box == (20.0, 10.0, 100.0, 40.0) and s.shapes[0].fill == "ff0000"
    assert [[(r.text, r.size, r.bold) for r in p.runs] for p in s.shapes[0].paras] == [[("Hello", 30.0, True)], [("world", 44.0, False)]]
    only = ppt.parse_ppt(ole2({"PowerPoint Document": document.ljust(5000, b"\0")}))
    assert only.shapes[0].paras[0].runs[0].text == "Hello"
    assert ppt.decode_ppt(data).width == 1024


def test_webp_container():
    import struct

    from mosaiq.formats import webp

    frame = struct.pack("<4sI", b"VP8L", 5) + b"\x2f" + struct.pack("<I", 9 | 19 << 14) + b"\0"
    anmf = b"\0" * 6 + (9).to_bytes(3, "little") + (19).to_bytes(3, "little") + b"\0" * 4 + frame
    data = struct.pack("<4sI4s", b"RIFF", 0, b"WEBP") + struct.pack("<4sI", b"ANMF", len(anmf)) + anmf
    assert webp.size(webp.first_frame(data)) == (10, 20) and webp.first_frame(data)[12:16] == b"VP8L"
    with pytest.raises(DecodeError, match="10x20"):
        webp.decode_webp(data)


def mp4_file(sync=True):
    import struct

    box = lambda kind, *parts: struct.pack(">I", 8 + len(b"".join(parts))) + kind + b"".join(parts)
    words = lambda *v: struct.pack(f">{len(v)}I", *v)
    media = bytes(range(200))
    ftyp = box(b"ftyp", b"isom\0\0\0\0")
    base = len(ftyp) + 8
    avc = b"\1\x42\0\x1e\xff\xe1\0\2\x67\x01\1\0\2\x68\x02"
    entry = box(b"avc1", b"\0" * 24 + struct.pack(">HH", 64, 48) + b"\0" * 50, box(b"avcC", avc))
    tables = [box(b"stsd", words(0, 1), entry), box(b"stts", words(0, 2, 10, 100, 10, 50)), box(b"stsc", words(0, 2, 1, 3, 1, 3, 7, 1)), box(b"stsz", words(0, 0, 20, *range(5, 25))), box(b"stco", words(0, 4, *(base + 50 * i for i in range(4))))]
    if sync:
        tables.append(box(b"stss", words(0, 3, 1, 2, 9)))
    trak = box(b"trak", box(b"mdia", box(b"hdlr", words(0, 0), b"vide" + b"\0" * 12), box(b"minf", box(b"stbl", *tables))))
    return ftyp + box(b"mdat", media) + box(b"moov", box(b"trak", box(b"mdia", box(b"hdlr", words(0, 0), b"soun"))), trak)


def test_mp4_tables():
    from mosaiq.formats import mp4

    t = mp4.video_track(mp4_file())
    assert (t.width, t.height, t.codec) == (64, 48, "avc1") and t.stsc == [(1, 3), (3, 7)]
    assert mp4.target_sample(t) == 3 and mp4.sync_sample(t, 8) == 2 and mp4.sync_sample(t, 9) == 9
    base = t.chunks[0]
    assert mp4.sample_place(t, 2) == (base + 5, 6) and mp4.sample_place(t, 4) == (base + 50, 8) and mp4.sample_place(t, 8) == (base + 100 + 11, 12)
    track, frame = mp4.key_frame(mp4_file())
    assert frame == bytes(range(5, 11)) and mp4.sync_sample(mp4.video_track(mp4_file(False)), 2) == 2
    assert mp4.nal_units(b"\0\0\0\2ab", track.parameters) == [b"\x67\x01", b"\x68\x02", b"ab"]
    with pytest.raises(DecodeError, match="64x48"):
        mp4.decode_mp4(mp4_file())
    with pytest.raises(DecodeError):
        mp4.decode_mp4(b"\0\0\0\x08ftyp")
