"""PDF objects: syntax, cross-references, object streams, filters."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from typing import Any

import numpy as np

from mosaiq.codecs.base import DecodeError
from mosaiq.codecs.paletted import lzw
from mosaiq.codecs.png import unfilter
from mosaiq.operators.limits import MAX_DEPTH, MAX_INFLATED_BYTES


class Name(str):
    """A name, without its slash."""


class Operator(str):
    """A word of a content stream."""


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


@dataclass
class Stream:
    info: dict
    raw: bytes


SPACE, DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_WORD = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_REF = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_NUMBER = re.compile(rb"[-+]*\d*\.?\d*$")
END = object()
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Reader:
    """Objects from bytes, one after another; content streams have operators between them and no references."""

    def __init__(self, data: bytes, at: int = 0, content: bool = False):
        self.data, self.at, self.content = data, at, content

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def next(self, depth: int = 0) -> Any:
        if depth > MAX_DEPTH:
            raise DecodeError("PDF nested too deeply")
        self.skip()
        d, at = self.data, self.at
        if at >= len(d):
            return END
        c = d[at : at + 1]
        if c == b"/":
            m = _WORD.match(d, at + 1)
            self.at = m.end() if m else at + 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0] if m else b"").decode("latin-1"))
        if c == b"(":
            return self._string()
        if d[at : at + 2] == b"<<":
            self.at += 2
            out: dict = {}
            while True:
                key = self.next(depth + 1)
                if key is END or key == Operator(">>") and isinstance(key, Operator):
                    return out
                value = self.next(depth + 1)
                if value is END:
                    return out
                if isinstance(value, Operator) and value == ">>":
                    return out
                if isinstance(key, Name):
                    out[str(key)] = value
        if c == b"<":
            end = d.find(b">", at)
            end = len(d) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            items: list = []
            while True:
                value = self.next(depth + 1)
                if value is END or isinstance(value, Operator) and value == "]":
                    return items
                items.append(value)
        if d[at : at + 2] == b">>":
            self.at += 2
            return Operator(">>")
        if c in (b"]", b"{", b"}", b")", b">"):
            self.at += 1
            return Operator(c.decode())
        if not self.content and (m := _REF.match(d, at)):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        word = _WORD.match(d, at)[0]
        self.at = at + len(word)
        if word[:1] in b"+-.0123456789" and _NUMBER.match(word):
            text = word.lstrip(b"+-")
            sign = -1 if word[: len(word) - len(text)].count(b"-") else 1
            try:
                return sign * (float(text) if b"." in text else int(text))
            except ValueError:
                return 0
        return {b"true": True, b"false": False, b"null": None}.get(word, Operator(word.decode("latin-1")))

    def _string(self) -> bytes:
        d, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(d):
            c = d[at : at + 1]
            at += 1
            if c == b"\\":
                e = d[at : at + 1]
                if m := re.compile(rb"[0-7]{1,3}").match(d, at):
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                elif e in (b"\r", b"\n"):
                    at += 2 if d[at : at + 2] == b"\r\n" else 1
                else:
                    out += _ESCAPES.get(e, e)
                    at += 1
                continue
            if c == b"(":
                depth += 1
            elif c == b")":
                depth -= 1
                if not depth:
                    break
            out += c
        self.at = at
        return bytes(out)


def _predicted(data: bytes, parms: dict) -> bytes:
    kind = parms.get("Predictor", 1)
    if not isinstance(kind, int) or kind < 2:
        return data
    colors, bits, columns = (int(parms.get(k, v) or v) for k, v in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    step, stride = max(1, colors * bits // 8), (columns * colors * bits + 7) // 8
    if kind == 2:
        if bits != 8:
            return data
        rows = np.frombuffer(data[: len(data) // stride * stride], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    n = -(-len(data) // (stride + 1))
    return unfilter(data, n, stride, step).tobytes()


def _ascii85(data: bytes) -> bytes:
    """Groups of five; a group cut short gives all four bytes."""
    out, group = bytearray(), []
    for c in data.split(b"~>")[0]:
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if group:
        group += [84] * (5 - len(group))
        out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
    return bytes(out)


class Document:
    def __init__(self, data: bytes):
        self.data, self.places, self.trailer = data, {}, {}
        self.kept: dict[int, Any] = {}
        self.packed: dict[int, dict[int, Any]] = {}
        self.open: set[int] = set()
        found = data.rfind(b"startxref")
        m = re.compile(rb"startxref\s+(\d+)").match(data, found) if found >= 0 else None
        try:
            if m:
                self._sections(int(m[1]))
        except (DecodeError, ValueError, IndexError, TypeError, zlib.error):
            self.places = {}
        if not self.places or "Root" not in self.trailer:
            self._scan()
        if "Encrypt" in self.trailer:
            raise DecodeError("Encrypted PDF is not supported")

    def _sections(self, first: int) -> None:
        """Cross-reference sections from the newest on; the first that names an object or the trailer wins."""
        todo, seen = [first], set()
        while todo:
            at = todo.pop()
            if at in seen or not 0 <= at < len(self.data):
                continue
            seen.add(at)
            r = Reader(self.data, at)
            r.skip()
            if self.data[r.at : r.at + 4] == b"xref":
                r.at += 4
                while isinstance(first := r.next(), int):
                    count = r.next()
                    for i in range(count):
                        offset, _, kind = r.next(), r.next(), r.next()
                        self.places.setdefault(first + i, ("at", offset) if kind == "n" else None)
                info = r.next() if first == "trailer" else {}
                after = [info[k] for k in ("XRefStm", "Prev") if isinstance(info.get(k), int)]
            else:
                stream = self._read(at)
                if not isinstance(stream, Stream):
                    raise DecodeError("PDF without cross-references")
                info, body = stream.info, self.filtered(stream)
                widths = info["W"]
                index = info.get("Index") or [0, info["Size"]]
                k = 0
                for a, n in zip(index[::2], index[1::2], strict=False):
                    for number in range(a, a + n):
                        v = []
                        for w in widths:
                            v.append(int.from_bytes(body[k : k + w], "big") if w else None)
                            k += w
                        kind = 1 if v[0] is None else v[0]
                        if k <= len(body):
                            self.places.setdefault(number, ("at", v[1]) if kind == 1 else ("in", v[1], v[2] or 0) if kind == 2 else None)
                after = [info["Prev"]] if isinstance(info.get("Prev"), int) else []
            for key, value in info.items():
                self.trailer.setdefault(key, value)
            todo += after

    def _scan(self) -> None:
        """Without usable cross-references: every `n g obj` there is, the last of a number."""
        for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b", self.data):
            self.places[int(m[1])] = ("at", m.start())
        for m in re.finditer(rb"trailer", self.data):
            info = Reader(self.data, m.end()).next()
            if isinstance(info, dict):
                self.trailer |= info
        if "Root" not in self.trailer:
            for number in list(self.places):
                found = self.get(Ref(number, 0))
                if isinstance(found, dict) and found.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(number, 0)
        if "Root" not in self.trailer:
            raise DecodeError("PDF without a catalog")

    def _read(self, at: int) -> Any:
        r = Reader(self.data, at)
        r.next(), r.next()
        if r.next() != "obj":
            raise DecodeError("Damaged PDF object")
        value = r.next()
        if isinstance(value, dict):
            r.skip()
            if self.data[r.at : r.at + 6] == b"stream":
                begin = r.at + 6
                begin += 2 if self.data[begin : begin + 2] == b"\r\n" else 1
                size = self.get(value.get("Length"))
                if not isinstance(size, int) or self.data[begin + size : begin + size + 20].strip(SPACE)[:9] != b"endstream":
                    end = self.data.find(b"endstream", begin)
                    size = (end if end >= 0 else len(self.data)) - begin
                return Stream(value, self.data[begin : begin + size])
        return value

    def get(self, value: Any) -> Any:
        """The object itself, references followed."""
        hops = 0
        while isinstance(value, Ref) and hops < 32:
            hops += 1
            n = value.number
            if n not in self.kept:
                place = self.places.get(n)
                if place is None or n in self.open:
                    return None
                self.open.add(n)
                try:
                    if place[0] == "at":
                        self.kept[n] = self._read(place[1])
                    else:
                        self.kept[n] = self._unpacked(place[1]).get(n)
                except (DecodeError, ValueError, IndexError, TypeError, zlib.error):
                    self.kept[n] = None
                finally:
                    self.open.discard(n)
            value = self.kept[n]
        return value

    def _unpacked(self, number: int) -> dict[int, Any]:
        """All objects of an object stream, decoded once."""
        if number not in self.packed:
            stream, out = self.get(Ref(number, 0)), {}
            if isinstance(stream, Stream):
                body = self.filtered(stream)
                head, first = Reader(body), int(self.get(stream.info.get("First")) or 0)
                pairs = [(head.next(), head.next()) for _ in range(int(self.get(stream.info.get("N")) or 0))]
                for n, at in pairs:
                    if isinstance(n, int) and isinstance(at, int):
                        out.setdefault(n, Reader(body, first + at).next())
            self.packed[number] = out
        return self.packed[number]

    def filters(self, stream: Stream) -> list[tuple[str, dict]]:
        names, parms = self.get(stream.info.get("Filter", stream.info.get("F"))), self.get(stream.info.get("DecodeParms", stream.info.get("DP")))
        names = names if isinstance(names, list) else [names] if names else []
        parms = parms if isinstance(parms, list) else [parms]
        parms = [p if isinstance(p, dict) else {} for p in map(self.get, parms)] + [{}] * len(names)
        return [(str(self.get(n)), {k: self.get(v) for k, v in p.items()}) for n, p in zip(names, parms, strict=False)]

    def filtered(self, stream: Stream, until: tuple[str, ...] = ("DCTDecode", "DCT", "JPXDecode")) -> bytes:
        """The bytes after the filters, up to a picture's; unknown filters change nothing."""
        data = stream.raw
        for name, parms in self.filters(stream):
            if name in until:
                break
            if name in ("FlateDecode", "Fl"):
                d, out = zlib.decompressobj(), b""
                try:
                    out = d.decompress(data, MAX_INFLATED_BYTES)
                except zlib.error:
                    out = _salvaged(data)
                data = _predicted(out, parms)
            elif name in ("LZWDecode", "LZW"):
                data = _predicted(lzw(data, 8, False, MAX_INFLATED_BYTES, early=int(parms.get("EarlyChange", 1))), parms)
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif name in ("ASCII85Decode", "A85"):
                data = _ascii85(data)
        return data

    def first_page(self) -> dict:
        """The first leaf of the page tree with what it inherits."""
        root = self.get(self.trailer.get("Root"))
        node = self.get(root.get("Pages")) if isinstance(root, dict) else None
        inherited: dict = {}
        for _ in range(MAX_DEPTH):
            if not isinstance(node, dict):
                break
            inherited |= {k: node[k] for k in ("MediaBox", "Resources", "Rotate") if k in node}
            kids = self.get(node.get("Kids"))
            if not isinstance(kids, list):
                return inherited | node
            node = next((k for k in map(self.get, kids) if isinstance(k, dict) and (k.get("Type") != "Pages" or self.get(k.get("Kids")))), None)
        raise DecodeError("PDF has no pages")


def _salvaged(data: bytes) -> bytes:
    """What a damaged deflate stream gives before its damage."""
    d, out = zlib.decompressobj(), bytearray()
    try:
        for i in range(0, len(data), 256):
            out += d.decompress(data[i : i + 256])
    except zlib.error:
        pass
    return bytes(out)
