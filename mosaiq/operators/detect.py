"""Type detection from content, as one expression: the first rule that holds names the type."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type, offset, bytes as hex. The order of RULES decides between types.
SIGNATURES = {
    "jpeg": [(0, "FFD8FF")],
    "png": [(0, "89504E470D0A1A0A")],
    "bmp": [(0, "424D")],
    "gif": [(0, "4749463839"), (0, "4749463837")],
    "webp": [(8, "57454250")],
    "ico": [(0, "00000100")],
    "cur": [(0, "00000200")],
    "ani": [(8, "41434F4E")],
    "tiff": [(0, "49492A00"), (0, "4D4D002A")],
    "pbm": [(0, "5031"), (0, "5034")],
    "pgm": [(0, "5032"), (0, "5035")],
    "ppm": [(0, "5033"), (0, "5036")],
    "qoi": [(0, "716F6966")],
    "dds": [(0, "44445320")],
    "psd": [(0, "38425053")],
    "pdf": [(0, "25504446")],
    "mp4": [(4, "66747970")],
}
ZIP, OLE2 = "504B0304", "D0CF11E0A1B11AE1"
DELIMITERS = (",", "\t", ";", "|")
TYPES = (
    "jpeg", "png", "bmp", "gif", "webp", "ico", "cur", "ani", "tiff", "pbm", "pgm", "ppm", "qoi", "dds", "psd", "odt", "pptx", "xlsx", "ppt", "doc", "xls", "docx", "pdf", "svg", "csv", "mp4", "pcx", "tga",
)


def _hex(text: str) -> Column:
    return F.unhex(F.lit(text))


def at(content: Column, offset: int, magic: str) -> Column:
    """Whether content has the bytes (hex) at offset; false where it is too short."""
    n = len(magic) // 2
    return F.substring(content, offset + 1, n) == _hex(magic)


def byte(content: Column, offset: int) -> Column:
    """The byte at offset as an int; null past the end."""
    return F.conv(F.nullif(F.hex(F.substring(content, offset + 1, 1)), F.lit("")), 16, 10).cast("int")


def u16le(content: Column, offset: int) -> Column:
    return byte(content, offset) + byte(content, offset + 1) * 256


def _has(content: Column, begin: int, magic: str) -> Column:
    """Whether the bytes are anywhere from begin on."""
    return F.contains(F.substring(content, begin + 1, 1 << 30), _hex(magic))


def _lossy(content: Column, n: int) -> Column:
    """The first n bytes as text, one character a byte: enough for ASCII rules."""
    return F.decode(F.substring(content, 1, n), "ISO-8859-1")


def _is_text(head: Column) -> Column:
    return ~head.rlike("[\\x00-\\x08\\x0E-\\x1A\\x1C-\\x1F]")


def is_csv(content: Column) -> Column:
    """At least 4 bytes; in the first 512 no control bytes, a delimiter and a line feed; the first two lines that are not
    empty have one of the delimiters equally often, and at least once."""
    head = _lossy(content, 512)
    lines = F.filter(F.split(head, "\r?\n", -1), lambda x: x != "")
    same = F.lit(False)
    for d in DELIMITERS:
        count = lambda line, d=d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))
        same = same | ((count(F.get(lines, 0)) > 0) & (count(F.get(lines, 0)) == count(F.get(lines, 1))))
    text = F.length(content) >= 4
    return F.coalesce(text & _is_text(head) & head.rlike("[,;|\t]") & head.contains("\n") & (F.size(lines) >= 2) & same, F.lit(False))


def is_svg(content: Column) -> Column:
    head = _lossy(content, 1024)
    return _is_text(head) & head.rlike("(?i)<svg[\\x20\\t-\\r\\xA0>]")


def is_odt(content: Column) -> Column:
    """A ZIP whose first member is an uncompressed `mimetype` of an OpenDocument text."""
    head = F.substring(content, 39, 120 - 38 + 30)
    found = F.locate("opendoc", F.decode(head, "ISO-8859-1"))
    tail = F.substring(F.decode(head, "ISO-8859-1"), found + 7, F.lit(27))
    return at(content, 0, ZIP) & (F.length(content) >= 60) & at(content, 30, "6D696D6574797065") & (found > 0) & (found <= 82) & tail.contains(".text")


def is_pcx(content: Column) -> Column:
    return at(content, 0, "0A") & byte(content, 1).isin(0, 2, 3, 4, 5) & byte(content, 2).isin(0, 1) & byte(content, 3).isin(1, 2, 4, 8)


def is_tga(content: Column) -> Column:
    sized = (u16le(content, 12) > 0) & (u16le(content, 14) > 0)
    return (F.length(content) >= 16) & byte(content, 1).isin(0, 1) & byte(content, 2).isin(1, 2, 3, 9, 10, 11) & sized


def ole_entry(stream: str) -> bytes:
    name = stream.encode("utf-16-le")
    return name.ljust(64, b"\0") + struct.pack("<HB", len(name) + 2, 2)


def _ole(content: Column, stream: str) -> Column:
    """An OLE2 file with a directory entry of that name: UTF-16 filled up to 64 bytes, its length with the end mark, and the type
    of a stream. A cell or paragraph that holds the name has other bytes after it."""
    return at(content, 0, OLE2) & F.contains(content, _hex(ole_entry(stream).hex()))


def detect_type(content: Column, strict: bool = False) -> Column:
    """Type name of binary content; null where no rule holds.

    strict also repairs what the plain order gets wrong: a true-colour TGA without map starts as a CUR does, and a PPTX or DOCX
    whose first member isn't its own folder is known by its main part.
    """
    signed: dict[str, Column] = {}
    for t, rules in SIGNATURES.items():
        found = F.lit(False)
        for offset, magic in rules:
            found = found | at(content, offset, magic)
        signed[t] = found
    zipped = at(content, 0, ZIP)
    rules = [(t, signed[t]) for t in TYPES[:15]]
    rules += [("odt", is_odt(content))]
    slides = at(content, 30, "7070742F")
    rules += [("pptx", zipped & (slides | _has(content, 30, b"ppt/presentation.xml".hex()) if strict else slides))]
    if strict:
        rules += [("docx", zipped & _has(content, 30, b"word/document.xml".hex()))]
    rules += [("xlsx", zipped & _has(content, 30, "786C2F")), ("ppt", _ole(content, "PowerPoint Document")), ("doc", _ole(content, "WordDocument")), ("xls", at(content, 0, OLE2))]
    rules += [("docx", zipped & _has(content, 30, "776F72642F")), ("pdf", signed["pdf"]), ("svg", is_svg(content)), ("csv", is_csv(content)), ("mp4", signed["mp4"]), ("pcx", is_pcx(content)), ("tga", is_tga(content))]
    if strict:
        true_colour = is_tga(content) & at(content, 0, "00000200") & (u16le(content, 4) == 0) & byte(content, 16).isin(24, 32)
        rules = [("tga", true_colour), *rules]
    return F.coalesce(*(F.when(rule, F.lit(t)) for t, rule in rules))
