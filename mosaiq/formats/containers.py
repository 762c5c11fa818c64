"""ZIP archives, XML trees and OLE2 compound files."""

from __future__ import annotations

import html
import re
import struct
import zlib
from dataclasses import dataclass, field

from mosaiq.codecs.base import DecodeError
from mosaiq.operators.limits import MAX_DEPTH, MAX_INFLATED_BYTES, MAX_STREAM_BYTES


def read_zip(data: bytes) -> dict[str, bytes]:
    """Members by name, the later of two equal names; stored and deflated ones, others are left out."""
    end = data.rfind(b"PK\5\6", max(0, len(data) - 65557))
    if end < 0 or end + 22 > len(data):
        raise DecodeError("Not a ZIP file")
    count, _, at = struct.unpack_from("<HII", data, end + 10)
    out: dict[str, bytes] = {}
    for _ in range(count):
        if data[at : at + 4] != b"PK\1\2" or at + 46 > len(data):
            break
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, size = struct.unpack_from("<II", data, at + 20)
        n, extra, note = struct.unpack_from("<HHH", data, at + 28)
        place = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n].decode("utf-8", "replace")
        at += 46 + n + extra + note
        if flags & 1:
            raise DecodeError("Encrypted ZIP is not supported")
        if place + 30 > len(data):
            continue
        begin = place + 30 + sum(struct.unpack_from("<HH", data, place + 26))
        body = data[begin : begin + packed]
        if method == 0:
            out[name] = body
        elif method == 8:
            try:
                d = zlib.decompressobj(-15)
                body = d.decompress(body, MAX_INFLATED_BYTES + 1)
            except zlib.error as e:
                raise DecodeError(f"ZIP data: {e}") from None
            if len(body) > MAX_INFLATED_BYTES:
                raise DecodeError("Decompressed data too large")
            out[name] = body
    return out


@dataclass
class Node:
    """An element: its tag without prefix, attributes with and without theirs, children, and all its own text."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list["Node"] = field(default_factory=list)
    text: str = ""

    def child(self, tag: str) -> "Node | None":
        return next((c for c in self.children if c.tag == tag), None)

    def all(self, tag: str) -> list["Node"]:
        return [c for c in self.children if c.tag == tag]

    def deep(self, tag: str) -> "Node | None":
        """The first descendant of that tag, in document order."""
        for c in self.children:
            if c.tag == tag:
                return c
            if (found := c.deep(tag)) is not None:
                return found
        return None

    def at(self, *tags: str) -> "Node | None":
        node: Node | None = self
        for t in tags:
            node = node.child(t) if node is not None else None
        return node

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    def number(self, name: str, default: float | None = None) -> float | None:
        m = re.match(r"\s*[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", self.attrs.get(name, ""))
        return float(m[0]) if m else default


_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<\?.*?(?:\?>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<!(?:[^<>\[]|\[.*?\])*>|<(/?)([^\s/>]+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def parse_xml(data: bytes | str) -> Node:
    """Lenient: unclosed elements end with their parent, unknown entities stay as they are, prolog and comments are skipped."""
    text = data if isinstance(data, str) else data.decode("utf-8-sig", "replace") if data[:2] not in (b"\xff\xfe", b"\xfe\xff") else data.decode("utf-16")
    top = Node("")
    stack, last = [top], 0
    for m in _TOKEN.finditer(text):
        if m.start() > last:
            stack[-1].text += html.unescape(text[last : m.start()]) if "&" in text[last : m.start()] else text[last : m.start()]
        last = m.end()
        if m[2] is None:
            continue
        tag = m[2].rsplit(":", 1)[-1]
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        node = Node(tag)
        for name, a, b in _ATTRIBUTE.findall(m[3]):
            value = html.unescape(a or b)
            node.attrs[name] = value
            node.attrs.setdefault(name.rsplit(":", 1)[-1], value)
        stack[-1].children.append(node)
        if not m[3].rstrip().endswith("/"):
            if len(stack) > MAX_DEPTH:
                raise DecodeError("XML nested too deeply")
            stack.append(node)
    if not top.children:
        raise DecodeError("XML without an element")
    return top.children[0]


def relations(files: dict[str, bytes], part: str) -> dict[str, str]:
    """Targets by id of a part's relationships, as names of members."""
    folder, _, name = part.rpartition("/")
    data = files.get(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
    if data is None:
        return {}
    return {r.get("Id", ""): join_path(folder, r.get("Target", "")) for r in parse_xml(data).all("Relationship")}


def join_path(folder: str, target: str) -> str:
    if target.startswith("/"):
        return target[1:]
    parts = folder.split("/") if folder else []
    for p in target.split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p != ".":
            parts.append(p)
    return "/".join(parts)


def read_ole2(data: bytes) -> dict[str, bytes]:
    """Streams by name. Chains end at a mark, outside the file, or where they would return to themselves."""
    if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1") or len(data) < 512:
        raise DecodeError("Not an OLE2 file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    first_dir, _, cutoff, first_mini, _, first_list, lists = struct.unpack_from("<IIIIIII", data, 48)
    sector = lambda i: data[size * (i + 1) : size * (i + 2)]
    words = lambda raw: list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
    places = words(data[76:512])
    for _ in range(lists):
        if first_list >= 0xFFFFFFFA or size * (first_list + 1) >= len(data):
            break
        more = words(sector(first_list))
        places += more[:-1]
        first_list = more[-1]
    table = [w for p in places if p < 0xFFFFFFFA for w in words(sector(p))]

    def chain(start: int, following: list[int]) -> list[int]:
        out, seen = [], set()
        while start < len(following) and start not in seen and len(out) < 100_000:
            seen.add(start)
            out.append(start)
            start = following[start]
        return out

    read = lambda start: b"".join(map(sector, chain(start, table)))
    folder = read(first_dir)
    entries = []
    for i in range(0, len(folder) - 127, 128):
        n = struct.unpack_from("<H", folder, i + 64)[0]
        start, length = struct.unpack_from("<II", folder, i + 116)
        entries.append((folder[i : i + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace"), folder[i + 66], start, length))
    root = next((e for e in entries if e[1] == 5), None)
    mini = read(root[2]) if root else b""
    mini_table = words(read(first_mini)) if first_mini < 0xFFFFFFFA else []
    out: dict[str, bytes] = {}
    for name, kind, start, length in entries:
        if kind != 2:
            continue
        if length > MAX_STREAM_BYTES:
            raise DecodeError("Stream too large")
        if length < cutoff:
            body = b"".join(mini[small * k : small * (k + 1)] for k in chain(start, mini_table))
        else:
            body = read(start)
        out.setdefault(name, body[:length])
    return out
