"""What is inside files, as tables: archive members, compound-file streams, XML nodes, delimited rows, cells, runs, records, boxes.

Each function takes files (path, content) and gives rows of (path, ..., error). A file that can't be read is one row with
its error and nulls. Rows are sent on as they come, so a file may have more of them than fit in a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.operators.limits import MAX_INPUT_BYTES

BATCH = 4096
_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<string>": pa.list_(pa.string())}


def file_table(files: DataFrame, rows: Callable[[bytes], Iterator[tuple]], schema: str, key: str = "path", content: str = "content") -> DataFrame:
    """(key, the columns of schema, error) of what `rows` yields for each file."""
    own = T._parse_datatype_string(schema)
    names, kinds = own.names, [_KINDS[f.dataType.simpleString()] for f in own]
    body = F.when(F.length(content) <= MAX_INPUT_BYTES, F.col(content))

    def run(batches):
        def batch(path, held):
            columns = [pa.array([r[i] for r in held], k) for i, k in enumerate([*kinds, pa.string()])]
            keys = pa.array([path] * len(held), pa.string())
            return pa.RecordBatch.from_arrays([keys, *columns], names=[key, *names, "error"])

        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held: list[tuple] = []
                try:
                    raw = data.as_py()
                    if raw is None:
                        raise ValueError("Input file too large")
                    for r in rows(raw):
                        held.append((*r, None))
                        if len(held) >= BATCH:
                            yield batch(path, held)
                            held = []
                except Exception as e:  # the file's row, not the job
                    held.append((*[None] * len(names), str(e) or type(e).__name__))
                if held:
                    yield batch(path, held)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    return files.select(F.col(key).cast("string").alias(key), body.alias("content")).mapInArrow(run, f"`{key}` string, {fields}, error string")


def zip_members(files: DataFrame, **at: str) -> DataFrame:
    """(name, size, content) of each stored or deflated member."""

    def rows(data: bytes):
        from mosaiq.formats.containers import read_zip

        for name, body in read_zip(data).items():
            yield name, len(body), body

    return file_table(files, rows, "name string, size bigint, content binary", **at)


def ole2_streams(files: DataFrame, **at: str) -> DataFrame:
    def rows(data: bytes):
        from mosaiq.formats.containers import read_ole2

        for name, body in read_ole2(data).items():
            yield name, len(body), body

    return file_table(files, rows, "name string, size bigint, content binary", **at)


def xml_nodes(files: DataFrame, **at: str) -> DataFrame:
    """(id, parent, ord, depth, tag, attrs, text) in document order; ids count from 0, the root's parent is null."""

    def rows(data: bytes):
        from mosaiq.formats.containers import parse_xml

        stack, n = [(parse_xml(data), None, 0, 0)], 0
        while stack:
            node, parent, order, depth = stack.pop()
            yield n, parent, order, depth, node.tag, list(node.attrs.items()), node.text
            stack += [(c, n, i, depth + 1) for i, c in reversed(list(enumerate(node.children)))]
            n += 1

    return file_table(files, rows, "id bigint, parent bigint, ord int, depth int, tag string, attrs map<string,string>, text string", **at)


def csv_rows(files: DataFrame, **at: str) -> DataFrame:
    """(row, fields): quoted fields, doubled quotes and ragged rows by the exact rules."""

    def rows(data: bytes):
        from mosaiq.formats.csv import parse

        yield from enumerate(parse(data.decode("utf-8", "replace").removeprefix("﻿")))

    return file_table(files, rows, "row int, fields array<string>", **at)


def _sheet(data: bytes):
    from mosaiq.codecs.registry import sniff
    from mosaiq.formats import xls, xlsx

    return xls.parse_xls(data) if sniff(data) == "xls" else xlsx.parse_xlsx(data)


def sheet_cells(files: DataFrame, **at: str) -> DataFrame:
    """(row, col, value, is_number, style, display) of the first sheet of XLSX and XLS files."""

    def rows(data: bytes):
        from mosaiq.formats.sheet import CellStyle, format_number

        s = _sheet(data)
        for c in s.cells:
            style = s.styles[c.style] if 0 <= c.style < len(s.styles) else CellStyle()
            yield c.row, c.col, c.value, c.numeric, c.style, format_number(c.value, style.number_format, style.code) if c.numeric else c.value

    return file_table(files, rows, "row int, col int, value string, is_number boolean, style int, display string", **at)


def sheet_merges(files: DataFrame, **at: str) -> DataFrame:
    def rows(data: bytes):
        for i, m in enumerate(_sheet(data).merges):
            yield i, *m

    return file_table(files, rows, "seq int, r0 int, c0 int, r1 int, c1 int", **at)


def text_runs(files: DataFrame, **at: str) -> DataFrame:
    """(block, run, text, size, bold, color) of the paragraphs of DOCX, ODT and DOC files; tables are left out."""

    def rows(data: bytes):
        from mosaiq.codecs.registry import sniff
        from mosaiq.formats import doc, docx, odt
        from mosaiq.formats.document import Paragraph

        parse = {"doc": doc.parse_doc, "odt": odt.parse_odt}.get(sniff(data) or "", docx.parse_docx)
        for i, block in enumerate(parse(data).blocks):
            if isinstance(block, Paragraph):
                for k, r in enumerate(block.runs):
                    if r.image is None:
                        yield i, k, r.text, float(r.style.size), r.style.bold, r.style.color

    return file_table(files, rows, "block int, run int, text string, size double, bold boolean, color string", **at)


def slide_shapes(files: DataFrame, **at: str) -> DataFrame:
    """(z, x, y, w, h, text, fill, is_image) of the first slide of PPTX and PPT files."""

    def rows(data: bytes):
        from mosaiq.codecs.registry import sniff
        from mosaiq.formats import ppt, pptx

        slide = ppt.parse_ppt(data) if sniff(data) == "ppt" else pptx.parse_pptx(data)
        for z, s in enumerate(slide.shapes):
            yield z, *map(float, s.box), "\n".join("".join(r.text for r in p.runs) for p in s.paras), s.fill, s.image is not None

    return file_table(files, rows, "z int, x double, y double, w double, h double, text string, fill string, is_image boolean", **at)


def biff_records(files: DataFrame, **at: str) -> DataFrame:
    """(seq, type, size, continuations, body) of a workbook stream, continuations joined to their record."""

    def rows(data: bytes):
        from mosaiq.formats.containers import read_ole2
        from mosaiq.formats.xls import records

        streams = read_ole2(data)
        for i, (kind, body, cuts) in enumerate(records(streams.get("Workbook") or streams.get("Book") or b"")):
            yield i, kind, len(body), len(cuts), body

    return file_table(files, rows, "seq int, type int, size int, continuations int, body binary", **at)


def mp4_samples(files: DataFrame, **at: str) -> DataFrame:
    """(sample, offset, size, is_sync) of every sample of the video track."""

    def rows(data: bytes):
        from mosaiq.formats.mp4 import video_track

        t = video_track(data)
        sync, sample, step = None if t.stss is None else set(t.stss), 0, 0
        for chunk, offset in enumerate(t.chunks, 1):
            while step + 1 < len(t.stsc) and t.stsc[step + 1][0] <= chunk:
                step += 1
            for _ in range(t.stsc[step][1] if t.stsc else 1):
                if sample >= len(t.sizes):
                    return
                yield sample + 1, offset, t.sizes[sample], sync is None or sample + 1 in sync
                offset += t.sizes[sample]
                sample += 1

    return file_table(files, rows, "sample int, offset bigint, size bigint, is_sync boolean", **at)


def pdf_objects(files: DataFrame, **at: str) -> DataFrame:
    """(number, kind, keys, size): what each cross-reference leads to."""

    def rows(data: bytes):
        from mosaiq.formats.pdf_file import Document, Ref, Stream

        doc = Document(data)
        for n in sorted(doc.places):
            value = doc.get(Ref(n, 0))
            info = value.info if isinstance(value, Stream) else value if isinstance(value, dict) else {}
            yield n, type(value).__name__.lower() if value is not None else "free", sorted(info), len(value.raw) if isinstance(value, Stream) else None

    return file_table(files, rows, "number int, kind string, keys array<string>, size bigint", **at)
