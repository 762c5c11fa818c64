"""Decoders by type, and the whole way from bytes to a thumbnail for one file."""

from __future__ import annotations

import re
from collections.abc import Callable

from mosaiq.codecs import jpeg, paletted, png, simple
from mosaiq.codecs.base import DecodeError, Grid, check_size
from mosaiq.codecs.resample import resize
from mosaiq.operators.detect import DELIMITERS, OLE2, SIGNATURES, ZIP, ole_entry
from mosaiq.operators.limits import DEFAULT_FIT, DEFAULT_HEIGHT, DEFAULT_WIDTH, MAX_INPUT_BYTES

Decoder = Callable[[bytes, tuple[int, int] | None], Grid]
DECODERS: dict[str, Decoder] = {}


def register_decoder(kind: str, decode: Callable[[bytes], Grid], takes_target: bool = False) -> None:
    """Make decode the decoder of a type; with takes_target it is also given the size that will do."""
    DECODERS[kind] = decode if takes_target else lambda data, target: decode(data)


def _later(module: str, name: str) -> Callable[[bytes], Grid]:
    """A decoder of mosaiq.formats, imported when first used."""

    def decode(data: bytes) -> Grid:
        import importlib

        return getattr(importlib.import_module(f"mosaiq.formats.{module}"), name)(data)

    return decode


register_decoder("jpeg", jpeg.decode_jpeg, takes_target=True)
for _kind, _decode in {
    "png": png.decode_png, "bmp": simple.decode_bmp, "gif": paletted.decode_gif, "ico": paletted.decode_ico, "cur": paletted.decode_ico, "ani": paletted.decode_ico,
    "tiff": paletted.decode_tiff, "pbm": simple.decode_pnm, "pgm": simple.decode_pnm, "ppm": simple.decode_pnm, "qoi": simple.decode_qoi, "dds": simple.decode_dds,
    "psd": simple.decode_psd, "pcx": simple.decode_pcx, "tga": simple.decode_tga, "csv": _later("csv", "decode_csv"), "webp": _later("webp", "decode_webp"),
    "xlsx": _later("xlsx", "decode_xlsx"), "xls": _later("xls", "decode_xls"), "docx": _later("docx", "decode_docx"), "odt": _later("odt", "decode_odt"),
    "doc": _later("doc", "decode_doc"), "pptx": _later("pptx", "decode_pptx"), "ppt": _later("ppt", "decode_ppt"), "pdf": _later("pdf", "decode_pdf"),
    "svg": _later("svg", "decode_svg"), "mp4": _later("mp4", "decode_mp4"),
}.items():
    register_decoder(_kind, _decode)


def sniff(data: bytes) -> str | None:
    """The rules of mosaiq.operators.detect for one file's bytes."""
    at = lambda offset, magic: data[offset : offset + len(magic) // 2] == bytes.fromhex(magic)
    signed = lambda kind: any(at(o, m) for o, m in SIGNATURES[kind])
    for kind in list(SIGNATURES)[:15]:
        if signed(kind):
            return kind
    if at(0, ZIP):
        k = data.find(b"opendoc", 38, 126)
        if len(data) >= 60 and data[30:38] == b"mimetype" and k >= 0 and b".text" in data[k + 7 : k + 34]:
            return "odt"
        if data[30:34] == b"ppt/":
            return "pptx"
        if data.find(b"xl/", 30) >= 0:
            return "xlsx"
        if data.find(b"word/", 30) >= 0:
            return "docx"
    if at(0, OLE2):
        for kind, name in (("ppt", "PowerPoint Document"), ("doc", "WordDocument")):
            if ole_entry(name) in data:
                return kind
        return "xls"
    if signed("pdf"):
        return "pdf"
    plain = lambda head: not re.search(rb"[\x00-\x08\x0e-\x1a\x1c-\x1f]", head)
    if plain(data[:1024]) and re.search(rb"<svg[\s>]", data[:1024], re.IGNORECASE):
        return "svg"
    head = data[:512]
    if len(data) >= 4 and plain(head) and re.search(rb"[,;|\t]", head):
        lines = [x for x in re.split(rb"\r?\n", head) if x]
        if b"\n" in head and len(lines) > 1 and any(0 < lines[0].count(d.encode()) == lines[1].count(d.encode()) for d in DELIMITERS):
            return "csv"
    if signed("mp4"):
        return "mp4"
    if data[:1] == b"\x0a" and len(data) >= 4 and data[1] in (0, 2, 3, 4, 5) and data[2] in (0, 1) and data[3] in (1, 2, 4, 8):
        return "pcx"
    if len(data) >= 16 and data[1] in (0, 1) and data[2] in (1, 2, 3, 9, 10, 11) and any(data[12:14]) and any(data[14:16]):
        return "tga"
    return None


def decode(data: bytes, kind: str | None = None, target: tuple[int, int] | None = None) -> tuple[str, Grid]:
    """(type, pixels) of a file."""
    if len(data) > MAX_INPUT_BYTES:
        raise DecodeError("Input file too large")
    kind = kind or sniff(data)
    if kind is None:
        raise DecodeError("Could not detect file type")
    if kind not in DECODERS:
        raise DecodeError(f"No decoder for type: {kind}")
    grid = DECODERS[kind](data, target)
    check_size(grid.width, grid.height)
    return kind, grid


def thumbnail(data: bytes, width: int | None = None, height: int | None = None, fit: str | None = None, kind: str | None = None) -> tuple[str, int, int, bytes]:
    """(type, source width, source height, PNG bytes) of a file; raises DecodeError."""
    w, h = width or DEFAULT_WIDTH, height or DEFAULT_HEIGHT
    kind, grid = decode(data, kind, (w, h))
    return kind, grid.width, grid.height, png.encode_png(resize(grid, w, h, fit or DEFAULT_FIT))
