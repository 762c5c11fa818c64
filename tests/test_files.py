import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq import api
from mosaiq.codecs import png, registry
from mosaiq.codecs.base import DecodeError, Grid
from mosaiq.formats import csv
from mosaiq.operators import thumbnails
from mosaiq.operators.detect import detect_type, ole_entry
from mosaiq.sources import files
from mosaiq.vector.canvas import Canvas
from mosaiq.vector.paths import Path, arc
from tests import test_codecs as made

SAMPLES = {
    "png": png.encode_png(made.picture()), "bmp": made.bmp(made.picture(), 24, False), "ppm": b"P6 1 1 255\nabc", "qoi": b"qoif" + b"\0" * 20, "pdf": b"%PDF-1.4 ....", "svg": b'<?xml version="1.0"?>\n<svg >',
    "csv": b"a,b\n1,2\n", "mp4": b"\0\0\0\x18ftypisom", "pcx": bytes([10, 5, 1, 8]) + b"\0" * 130, "tga": bytes([0, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 4, 0, 4, 0, 8, 0]), "cur": b"\0\0\2\0" + b"\0" * 20,
    "ani": b"RIFF....ACON", "webp": b"RIFF....WEBP", "tiff": b"MM\0*....", "psd": b"8BPS....", "dds": b"DDS ....", "gif": b"GIF89a....", "jpeg": b"\xff\xd8\xff\xe0", "ico": b"\0\0\1\0..",
    "pptx": b"PK\3\4" + b"\0" * 26 + b"ppt/slides", "xlsx": b"PK\3\4" + b"\0" * 26 + b"[Content]xl/workbook", "docx": b"PK\3\4" + b"\0" * 26 + b"word/document.xml",
    "odt": b"PK\3\4" + b"\0" * 26 + b"mimetypeapplication/vnd.oasis.opendocument.text" + b"\0" * 9, "xls": bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 99,
    "doc": bytes.fromhex("D0CF11E0A1B11AE1") + ole_entry("WordDocument"), "ppt": bytes.fromhex("D0CF11E0A1B11AE1") + ole_entry("PowerPoint Document"), "pbm": b"P4 ..", "pgm": b"P2 ..",
}


def test_detection_in_both_forms(spark):
    rows = [(k, bytearray(v)) for k, v in SAMPLES.items()] + [(None, bytearray(b"")), (None, bytearray(b"abc")), (None, bytearray(b"plain text\nmore"))]
    got = spark.createDataFrame(rows, "want string, content binary").select("want", detect_type(F.col("content")).alias("type"), detect_type(F.col("content"), True).alias("strict")).collect()
    for (want, data), r in zip(rows, got, strict=True):
        assert r["type"] == want == registry.sniff(bytes(data))
        assert r["strict"] == want or want in ("tga",)
    assert set(SAMPLES) == set(__import__("mosaiq.operators.detect", fromlist=["TYPES"]).TYPES)


def test_scan_and_thumbnails(spark, tmp_path):
    g = made.picture(20, 10, alpha=False)
    (tmp_path / "a.png").write_bytes(png.encode_png(g))
    (tmp_path / "b.bmp").write_bytes(made.bmp(g, 24, True))
    (tmp_path / "c.bin").write_bytes(b"nothing known")
    (tmp_path / "d.png").write_bytes(png.encode_png(g)[:30])
    found = files.scan(spark, f"file://{tmp_path}")
    out = {r["path"].rsplit("/", 1)[1]: r for r in thumbnails.thumbnails(found.withColumn("width", F.lit(8)).withColumn("height", F.lit(8))).collect()}
    assert bytes(out["a.png"]["png"]) == bytes(out["b.bmp"]["png"]) and out["a.png"]["source_width"] == 20
    assert out["c.bin"]["error"] == "Could not detect file type" and out["d.png"]["error"]
    assert png.decode_png(bytes(out["a.png"]["png"])).rgba.shape == (8, 8, 4)
    done = thumbnails.thumbnails(found.where("path like '%png'"))
    assert files.save_files(done, str(tmp_path / "out")) == 1
    assert files.write_pngs(done, f"file://{tmp_path}/table").count() == 2
    text = files.as_base64(done).where("png is not null").first()
    assert base64.b64decode(text["png_base64"]) == bytes(text["png"])


def test_api(tmp_path):
    g = made.picture(30, 20)
    data = png.encode_png(g)
    small = api.thumbnail(data, width=10, height=10, fit="contain")
    assert png.decode_png(small).rgba.shape == (10, 10, 4)
    assert base64.b64decode(api.thumbnail_as_base64(data, width=10, height=10, fit="contain")) == small
    (tmp_path / "in.png").write_bytes(data)
    api.thumbnail_to_file(str(tmp_path / "in.png"), tmp_path / "out.png", width=10, height=10, fit="contain")
    assert (tmp_path / "out.png").read_bytes() == small
    assert png.decode_png(api.thumbnail(data)).rgba.shape == (256, 256, 4)
    with pytest.raises(DecodeError):
        api.thumbnail(b"unknown")
    with pytest.raises(DecodeError):
        api.thumbnail(5)


def test_register():
    api.register_decoder("mine", lambda data: Grid(np.full((2, 2, 4), data[0], np.uint8)))
    assert png.decode_png(api.thumbnail(b"\7", type="mine", width=2, height=2)).rgba.max() == 7


def test_csv_rules():
    assert csv.parse('a,b\n"x ""y""",2\r\n3\n') == [["a", "b"], ['x "y"', "2"], ["3"]]
    assert csv.parse('"a"b,c\n') == [["a", "b", "c"]]
    assert csv.parse("a,") == [["a"]]
    assert csv.parse("a,\nb") == [["a", ""], ["b"]]
    assert csv.parse("a;b\n\n1;2\n\n") == [["a", "b"], [""], ["1", "2"]]
    assert csv.parse('"multi\nline",x') == [["multi\nline", "x"]]
    got = csv.decode_csv(b"name,n\nx,1\ny,2\n")
    assert (got.width, got.height) == (1024, 724)
    assert got.rgba[26, 30].tolist() == [68, 114, 196, 255]
    with pytest.raises(DecodeError):
        csv.decode_csv(b"")


def plain_fill(lines, w, h, even_odd):
    out = np.zeros((h, w), bool)
    for y in range(h):
        hits = []
        for line in lines:
            for k, ((x0, y0), (x1, y1)) in enumerate(zip(line, line[1:] + line[:1], strict=True)):
                if abs(y1 - y0) >= 0.001 and min(y0, y1) <= y + 0.5 < max(y0, y1):
                    ax, ay, bx, by, d = (x0, y0, x1, y1, 1) if y1 > y0 else (x1, y1, x0, y0, -1)
                    hits.append((ax + (y + 0.5 - ay) * (bx - ax) / (by - ay), k, d))
        hits.sort()
        turn, begin = 0, None
        for i, (x, _, d) in enumerate(hits):
            was, turn = turn, turn + d
            opens = i % 2 == 0 if even_odd else was == 0 and turn != 0
            shuts = i % 2 == 1 if even_odd else turn == 0
            if opens:
                begin = x
            if shuts and begin is not None:
                a, b = max(0, int(np.floor(begin))), min(w - 1, int(np.floor(x)))
                if a <= b:
                    out[y, a : b + 1] = True
    return out


@pytest.mark.parametrize("even_odd", [False, True])
def test_fill_against_plain(even_odd):
    rng = np.random.default_rng(2)
    for _ in range(20):
        lines = [[tuple(p) for p in rng.uniform(-10, 60, (rng.integers(3, 8), 2))] for _ in range(2)]
        c = Canvas(50, 40)
        c.polygons(lines, (0, 0, 0, 255), even_odd)
        assert ((c.px[..., 0] == 0) == plain_fill(lines, 50, 40, even_odd)).all()


def test_curves_and_images():
    p = Path()
    p.ellipse(20, 20, 15, 10)
    c = Canvas(40, 40)
    c.fill(p, (255, 0, 0, 128))
    assert c.px[20, 20].tolist() == [255, 127, 127, 255] and c.px[2, 2].tolist() == [255] * 4
    q = Path()
    q.move(5, 20)
    arc(q, 15, 10, 0, False, True, 35, 20)
    xs, ys = zip(*q.flat()[0][0], strict=True)
    assert min(ys) == pytest.approx(10, abs=0.3) and q.at() == (35, 20)
    g = Grid(np.arange(16, dtype=np.uint8).reshape(2, 2, 4) + 240)
    g.rgba[..., 3] = 255
    c = Canvas(10, 10)
    c.image(g, 2, 2, 4, 4)
    assert (c.px[2:4, 2:4] == g.rgba[0, 0]).all() and (c.px[4:6, 4:6] == g.rgba[1, 1]).all()
    c = Canvas(10, 10)
    c.image_in(g, (4, 0, 0, -4, 2, 6))
    assert (c.px[2, 2] == g.rgba[0, 0]).all() and (c.px[5, 5] == g.rgba[1, 1]).all()


def test_ole_text_is_no_directory_entry(spark):
    data = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 64 + "a cell that says WordDocument, or PowerPoint Document".encode("utf-16-le") + b"\0" * 80
    assert registry.sniff(data) == "xls"
    assert spark.createDataFrame([(bytearray(data),)], "content binary").select(detect_type(F.col("content")).alias("t")).first()["t"] == "xls"
