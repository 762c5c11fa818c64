"""Picture files in each raster format, their bytes built by expressions from the driver's tables, decoded and compared as pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import thumbnails
from mosaiq.plans.registry import query
from mosaiq.session import table
from mosaiq.sources import tables

# A picture for each supplier, 4 to 10 pixels wide and 3 to 7 high; k counts its pixels.
_PICTURE = """
WITH p AS (SELECT id, w, h, y.range::INT AS y, x.range::INT AS x, (y.range * w + x.range)::INT AS k, ((id * 31 + y.range * 17 + x.range * 5) % 256)::INT AS r, (y.range * 40 % 256)::INT AS g, (x.range * 60 % 256)::INT AS b, ((x.range + y.range) * 20 % 256)::INT AS a
  FROM (SELECT s_suppkey AS id, (s_suppkey % 7 + 4)::INT AS w, (s_suppkey % 5 + 3)::INT AS h FROM supplier), range(7) y, range(10) x WHERE y.range < h AND x.range < w)
"""


def _sizes() -> tuple[Column, Column, Column]:
    """The id, width and height of a picture."""
    return F.col("id"), F.col("w"), F.col("h")


def _red(y: Column, x: Column) -> Column:
    return F.pmod(F.col("id") * 31 + y * 17 + x * 5, F.lit(256))


def _alpha(y: Column, x: Column) -> Column:
    return (x + y) * 20


def _byte(v: Column | int) -> Column:
    """Two hex digits of a value modulo 256; files are put together in hex and turned into bytes once."""
    v = F.lit(v) if isinstance(v, int) else v
    return F.lpad(F.hex(F.pmod(v.cast("long"), F.lit(256))), 2, "0")


def _bytes(*values: Column | int) -> Column:
    return F.concat(*map(_byte, values))


def _little(v: Column | int, n: int) -> Column:
    v = (F.lit(v) if isinstance(v, int) else v).cast("long")
    return _bytes(*(F.shiftright(v, 8 * i) for i in range(n)))


def _big(v: Column | int, n: int) -> Column:
    v = (F.lit(v) if isinstance(v, int) else v).cast("long")
    return _bytes(*(F.shiftright(v, 8 * i) for i in reversed(range(n))))


def _hex(digits: str) -> Column:
    return F.lit(digits)


def _ascii(text: str) -> Column:
    return F.lit(text.encode().hex())


def _join(n: Column | int, part: Callable[[Column], Column]) -> Column:
    """part(0) to part(n - 1), one after the other; n is at least 1."""
    last = F.lit(n - 1) if isinstance(n, int) else n - 1
    return F.array_join(F.transform(F.sequence(F.lit(0), last.cast("int")), part), "")


def _rows(line: Callable[[Column], Column], from_bottom: bool = False) -> Column:
    return _join(F.col("h"), lambda j: line(F.col("h") - 1 - j if from_bottom else j))


def _grid(pixel: Callable[[Column, Column], Column], from_bottom: bool = False) -> Column:
    return _rows(lambda y: _join(F.col("w"), lambda x: pixel(y, x)), from_bottom)


def _decoded(spark: SparkSession, sf_dir: str, file: Column) -> DataFrame:
    """Pixels of the files whose bytes the hex digits of `file` are."""
    i = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(i.alias("id"), (i % 7 + 4).cast("int").alias("w"), (i % 5 + 3).cast("int").alias("h"))
    return thumbnails.pixels(thumbnails.decoded(rows.select("id", F.unhex(file).alias("content")), "id"), "id")


@query("bmp_decode", _PICTURE + "SELECT id, y, x, r, g, b, CASE WHEN id % 2 = 0 THEN a ELSE 255 END AS a FROM p")
def bmp_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 bits from the top for even ids, 24 bits from the bottom with padded lines for odd ones."""
    own, wide, tall = _sizes()
    head = lambda high, bits: F.concat(_ascii("BM"), _hex("00" * 8), _little(54, 4), _little(40, 4), _little(wide, 4), _little(high, 4), _little(1, 2), _little(bits, 2), _hex("00" * 24))
    colour = lambda y, x: _bytes(x * 60, y * 40, _red(y, x))
    stride = (F.floor((wide * 3 + 3) / 4) * 8).cast("int")
    lines = _rows(lambda y: F.rpad(_join(wide, lambda x: colour(y, x)), stride, "0"), from_bottom=True)
    deep = F.concat(head(-tall, 32), _grid(lambda y, x: F.concat(colour(y, x), _byte(_alpha(y, x)))))
    return _decoded(spark, sf_dir, F.when(own % 2 == 0, deep).otherwise(F.concat(head(tall, 24), lines)))


@query(
    "pnm_decode",
    _PICTURE
    + """, v AS (SELECT id, y, x, CASE id % 3 WHEN 0 THEN floor((id * 31 + y * 17 + x * 5) % 101 * 255.0::DOUBLE / 100 + 0.5)::INT WHEN 1 THEN ((id + x * y + 1) % 2 * 255)::INT ELSE ((id + x + y + 1) % 2 * 255)::INT END AS v FROM p)
SELECT id, y, x, v AS r, v AS g, v AS b, 255 AS a FROM v
""",
)
def pnm_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 with a maximum of 100, P1 and P4, by the remainder of the id by 3."""
    own, wide, tall = _sizes()
    sizes = F.concat(wide.cast("string"), F.lit(" "), tall.cast("string"), F.lit("\n"))
    gray = F.concat(F.hex(F.concat(F.lit("P5\n# gray\n"), sizes, F.lit("100\n"))), _grid(lambda y, x: _byte((own * 31 + y * 17 + x * 5) % 101)))
    plain = F.hex(F.concat(F.lit("P1\n"), sizes, _rows(lambda y: F.concat(_join(wide, lambda x: ((own + x * y) % 2).cast("string")), F.lit("\n")))))
    stride = F.floor((wide + 7) / 8).cast("int")
    bits = lambda y: F.rpad(_join(wide, lambda x: ((own + x + y) % 2).cast("string")), stride * 8, "0")
    packed = F.concat(F.hex(F.concat(F.lit("P4\n"), sizes)), _rows(lambda y: F.lpad(F.conv(bits(y), 2, 16), stride * 2, "0")))
    return _decoded(spark, sf_dir, F.when(own % 3 == 0, gray).when(own % 3 == 1, plain).otherwise(packed))


@query(
    "qoi_decode",
    _PICTURE
    + """, d AS (SELECT * FROM (VALUES (0, 0, 0, 0), (1, 1, -1, 0), (2, 14, 9, 6), (3, 14, 9, 6), (4, 0, 0, 0)) t(m, dr, dg, db))
SELECT id, y, x, ((id * 31 + k // 5 * 17 + dr) % 256)::INT AS r, ((k // 5 * 40 + dg + 256) % 256)::INT AS g, ((k // 5 * 60 + db) % 256)::INT AS b, (255 - k // 5)::INT AS a FROM p JOIN d ON d.m = p.k % 5
""",
)
def qoi_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each five pixels one is written in full, then a small and a larger difference, a run and a place of the index."""
    own, wide, tall = _sizes()

    def step(k: Column) -> Column:
        j = F.floor(k / 5)
        r, g, b, a = (F.pmod(v, F.lit(256)) for v in (own * 31 + j * 17, j * 40, j * 60, 255 - j))
        place = (r * 3 + g * 5 + b * 7 + a * 11) % 64
        small, larger, run = _hex("76"), _hex("AAB4"), _hex("C0")  # by (1, -1, 0), by (13, 10, 6), one more
        return F.when(k % 5 == 0, F.concat(_hex("FF"), _bytes(r, g, b, a))).when(k % 5 == 1, small).when(k % 5 == 2, larger).when(k % 5 == 3, run).otherwise(_byte(place))

    return _decoded(spark, sf_dir, F.concat(_ascii("qoif"), _big(wide, 4), _big(tall, 4), _hex("0400"), _join(wide * tall, step), _hex("0000000000000001")))


@query(
    "tga_decode",
    _PICTURE
    + """, c AS (SELECT id, y, x, id % 3 AS kind, r, g, b, a, ((id * 31 + y * 17) % 256)::INT AS r0, y * 20 % 256 AS a0, (x + y + id) % 20 AS e FROM p)
SELECT id, y, x, CASE kind WHEN 0 THEN r WHEN 1 THEN r0 WHEN 2 THEN CASE WHEN e < 16 THEN e * 16 ELSE 0 END END::INT AS r, CASE kind WHEN 0 THEN r WHEN 1 THEN g ELSE CASE WHEN e < 16 THEN 255 - e * 10 ELSE 0 END END::INT AS g,
  CASE kind WHEN 0 THEN r WHEN 1 THEN 0 ELSE CASE WHEN e < 16 THEN e * 3 ELSE 0 END END::INT AS b, CASE kind WHEN 0 THEN 255 WHEN 1 THEN a0 ELSE CASE WHEN e < 16 THEN 255 ELSE 0 END END::INT AS a FROM c
""",
)
def tga_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey from the bottom, 32 bits in runs from the top, and a map of 16 colours with indices beyond it."""
    own, wide, tall = _sizes()
    head = lambda has_map, kind, entries, map_bits, bits, flags: F.concat(_bytes(0, has_map, kind, 0, 0), _little(entries, 2), _byte(map_bits), _hex("00000000"), _little(wide, 2), _little(tall, 2), _bytes(bits, flags))
    none = F.lit(0)
    gray = F.concat(head(0, 3, 0, 0, 8, 0), _grid(lambda y, x: _byte(_red(y, x)), from_bottom=True))
    runs = F.concat(head(0, 10, 0, 0, 32, 32), _rows(lambda y: _bytes(wide - 1 + 128, none, y * 40, _red(y, none), _alpha(y, none))))
    colours = _join(16, lambda e: _bytes(e * 3, 255 - e * 10, e * 16))
    mapped = F.concat(head(1, 1, 16, 24, 8, 32), colours, _grid(lambda y, x: _byte((x + y + own) % 20)))
    return _decoded(spark, sf_dir, F.when(own % 3 == 0, gray).when(own % 3 == 1, runs).otherwise(mapped))


@query("pcx_decode", _PICTURE + "SELECT id, y, x, r, CASE WHEN id % 2 = 0 THEN g ELSE 255 - r END AS g, CASE WHEN id % 2 = 0 THEN b ELSE r * 7 % 256 END AS b, 255 AS a FROM p")
def pcx_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three planes for even ids, a palette at the end for odd ones; lines of an even number of bytes in runs of one."""
    own, wide, tall = _sizes()
    even = (F.floor((wide + 1) / 2) * 2).cast("int")
    head = lambda planes: F.concat(_hex("0A050108"), _hex("00000000"), _little(wide - 1, 2), _little(tall - 1, 2), _hex("00" * 53), _byte(planes), _little(even, 2), _hex("00" * 60))
    coded = lambda v: F.when(F.pmod(v, F.lit(256)) >= 192, F.concat(_hex("C1"), _byte(v))).otherwise(_byte(v))
    line = lambda part: F.concat(_join(wide, lambda x: coded(part(x))), F.when(even > wide, _hex("00")).otherwise(_hex("")))
    planes = F.concat(head(3), _rows(lambda y: F.concat(line(lambda x: _red(y, x)), line(lambda x: y * 40 + x * 0), line(lambda x: x * 60))))
    palette = F.concat(_hex("0C"), _join(256, lambda i: _bytes(i, 255 - i, i * 7)))
    return _decoded(spark, sf_dir, F.when(own % 2 == 0, planes).otherwise(F.concat(head(1), _rows(lambda y: line(lambda x: _red(y, x))), palette)))


@query(
    "gif_decode",
    _PICTURE
    + """, i AS (SELECT id, y, x, ((id * 3 + x * 11 + y * 7) % 128)::INT AS i FROM p)
SELECT id, y, x, CASE WHEN i = 5 THEN 0 ELSE i * 2 END AS r, CASE WHEN i = 5 THEN 0 ELSE 255 - i END AS g, CASE WHEN i = 5 THEN 0 ELSE i * 5 % 256 END AS b, CASE WHEN i = 5 THEN 0 ELSE 255 END AS a FROM i
""",
)
def gif_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """128 colours, one of them clear; interlaced for even ids. Codes have 8 bits throughout, as the table stays below 256."""
    own, wide, tall = _sizes()
    palette = _join(128, lambda i: _bytes(i * 2, 255 - i, i * 5))
    turn = lambda y: F.when(y % 8 == 0, 0).when(y % 8 == 4, 1).when(y % 4 == 2, 2).otherwise(3)
    order = F.array_sort(F.transform(F.sequence(F.lit(0), tall - 1), lambda y: F.struct(F.when(own % 2 == 0, turn(y)).otherwise(0).alias("turn"), y.alias("y"))))
    lines = F.array_join(F.transform(order, lambda o: _join(wide, lambda x: _byte((own * 3 + x * 11 + o["y"] * 7) % 128))), "")
    frame = F.concat(_hex("2C00000000"), _little(wide, 2), _little(tall, 2), _byte(F.when(own % 2 == 0, 64).otherwise(0)), _hex("07"), _byte(wide * tall + 2), _hex("80"), lines, _hex("81003B"))
    return _decoded(spark, sf_dir, F.concat(_ascii("GIF89a"), _little(wide, 2), _little(tall, 2), _hex("E60000"), palette, _hex("21F9040100000500"), frame))


@query(
    "psd_decode",
    _PICTURE
    + """SELECT id, y, x, CASE WHEN id % 3 < 2 THEN r ELSE floor(255 * (1 - r / 255.0::DOUBLE) * (1 - a / 255.0::DOUBLE) + 0.5)::INT END AS r, CASE WHEN id % 3 < 2 THEN g ELSE floor(255 * (1 - g / 255.0::DOUBLE) * (1 - a / 255.0::DOUBLE) + 0.5)::INT END AS g,
  CASE WHEN id % 3 < 2 THEN b ELSE floor(255 * (1 - b / 255.0::DOUBLE) * (1 - a / 255.0::DOUBLE) + 0.5)::INT END AS b, CASE WHEN id % 3 = 1 THEN a ELSE 255 END AS a FROM p
""",
)
def psd_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGB of 8 bits in PackBits, RGB and alpha of 16 bits, and CMYK, by the remainder of the id by 3."""
    own, wide, tall = _sizes()
    head = lambda channels, depth, mode, packing: F.concat(_ascii("8BPS"), _big(1, 2), _hex("00" * 6), _big(channels, 2), _big(tall, 4), _big(wide, 4), _big(depth, 2), _big(mode, 2), _hex("00" * 12), _big(packing, 2))
    parts = [_red, lambda y, x: y * 40 + x * 0, lambda y, x: x * 60 + y * 0, _alpha]
    packed = F.concat(_join(tall * 3, lambda _: _hex("0000")), *(_rows(lambda y, part=part: F.concat(_byte(wide - 1), _join(wide, lambda x: _byte(part(y, x))))) for part in parts[:3]))
    deep = F.concat(*(_grid(lambda y, x, part=part: F.concat(_byte(part(y, x)), _hex("55"))) for part in parts))
    inks = F.concat(*(_grid(lambda y, x, part=part: _byte(part(y, x))) for part in parts))
    return _decoded(spark, sf_dir, F.when(own % 3 == 0, F.concat(head(3, 8, 3, 1), packed)).when(own % 3 == 1, F.concat(head(4, 16, 3, 0), deep)).otherwise(F.concat(head(4, 8, 4, 0), inks)))


@query(
    "dds_decode",
    _PICTURE
    + """SELECT id, y, x, CASE WHEN id % 2 = 0 THEN r ELSE floor(r // 8 * 255.0::DOUBLE / 31 + 0.5)::INT END AS r, CASE WHEN id % 2 = 0 THEN g ELSE floor(g // 4 * 255.0::DOUBLE / 63 + 0.5)::INT END AS g,
  CASE WHEN id % 2 = 0 THEN b ELSE floor(b // 8 * 255.0::DOUBLE / 31 + 0.5)::INT END AS b, CASE WHEN id % 2 = 0 THEN a ELSE 255 END AS a FROM p
""",
)
def dds_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pixels: 32 bits with alpha for even ids, 5, 6 and 5 bits for odd ones."""
    own, wide, tall = _sizes()
    head = lambda flags, bits, *masks: F.concat(_ascii("DDS "), _hex("00" * 8), _little(tall, 4), _little(wide, 4), _hex("00" * 60), _little(flags, 4), _hex("00" * 4), _little(bits, 4), *(_little(m, 4) for m in masks), _hex("00" * 20))
    deep = F.concat(head(0x41, 32, 0xFF0000, 0xFF00, 0xFF, 0xFF000000), _grid(lambda y, x: _bytes(x * 60, y * 40, _red(y, x), _alpha(y, x))))
    eighth = lambda v, n: F.floor(F.pmod(v, F.lit(256)) / n)
    short = F.concat(head(0x40, 16, 0xF800, 0x7E0, 0x1F, 0), _grid(lambda y, x: _little(eighth(_red(y, x), 8) * 2048 + eighth(y * 40, 4) * 32 + eighth(x * 60, 8), 2)))
    return _decoded(spark, sf_dir, F.when(own % 2 == 0, deep).otherwise(short))


@query("tiff_decode", _PICTURE + "SELECT id, y, x, r, CASE WHEN id % 2 = 0 THEN g ELSE r END AS g, CASE WHEN id % 2 = 0 THEN b ELSE r END AS b, 255 AS a FROM p")
def tiff_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Little-endian RGB for even ids; big-endian grey, white at 0, in PackBits for odd ones."""
    own, wide, tall = _sizes()

    def head(number: Callable[[Column | int, int], Column], order: str, packing: int, colour: int, samples: int, size: Column) -> Column:
        tags = [(256, wide), (257, tall), (258, 8), (259, packing), (262, colour), (273, 122), (277, samples), (278, tall), (279, size)]
        return F.concat(_ascii(order), number(42, 2), number(8, 4), number(len(tags), 2), *(F.concat(number(tag, 2), number(4, 2), number(1, 4), number(v, 4)) for tag, v in tags), _hex("00" * 4))

    rgb = F.concat(head(_little, "II", 1, 2, 3, wide * tall * 3), _grid(lambda y, x: _bytes(_red(y, x), y * 40, x * 60)))
    lines = _rows(lambda y: F.concat(_byte(wide - 1), _join(wide, lambda x: _byte(255 - _red(y, x)))))
    return _decoded(spark, sf_dir, F.when(own % 2 == 0, rgb).otherwise(F.concat(head(_big, "MM", 32773, 0, 1, (wide + 1) * tall), lines)))


@query("ico_decode", _PICTURE + "SELECT id, y, x, r, g, b, CASE WHEN id % 2 = 0 THEN a WHEN (x + y) % 3 = 0 THEN 0 ELSE 255 END AS a FROM p")
def ico_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An icon behind a smaller one: 32 bits with alpha for even ids, 24 bits and a mask for odd ones."""
    own, wide, tall = _sizes()
    entry = lambda w, h, bits, size, at: F.concat(_bytes(w, h, 0, 0), _little(1, 2), _little(bits, 2), _little(size, 4), _little(at, 4))
    head = lambda bits: F.concat(_hex("000001000200"), entry(1, 1, 32, 4, 38), entry(wide, tall, bits, 4096, 42), _hex("00" * 4), _little(40, 4), _little(wide, 4), _little(tall * 2, 4), _little(1, 2), _little(bits, 2), _hex("00" * 24))
    colour = lambda y, x: _bytes(x * 60, y * 40, _red(y, x))
    deep = F.concat(head(32), _grid(lambda y, x: F.concat(colour(y, x), _byte(_alpha(y, x))), from_bottom=True))
    stride = (F.floor((wide * 24 + 31) / 32) * 8).cast("int")
    lines = _rows(lambda y: F.rpad(_join(wide, lambda x: colour(y, x)), stride, "0"), from_bottom=True)
    bits = lambda y: F.rpad(_join(wide, lambda x: F.when((x + y) % 3 == 0, "1").otherwise("0")), 32, "0")
    mask = _rows(lambda y: F.lpad(F.conv(bits(y), 2, 16), 8, "0"), from_bottom=True)
    return _decoded(spark, sf_dir, F.when(own % 2 == 0, deep).otherwise(F.concat(head(24), lines, mask)))


@query(
    "csv_quoted",
    """
WITH r AS (SELECT c_nationkey::VARCHAR AS id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS row, [c_custkey::VARCHAR, c_name || ', "' || c_mktsegment || '"'] || CASE WHEN c_custkey % 3 = 0 THEN ['two' || chr(10) || 'lines'] WHEN c_custkey % 3 = 1 THEN ['', 'last'] ELSE [] END AS f FROM customer)
SELECT id, row, (generate_subscripts(f, 1) - 1)::INT AS col, unnest(f) AS value FROM r
""",
)
def csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation, read by the exact rules: delimiters, quotes and line ends in quotes, ragged rows, CR LF for even nations."""
    key, named = F.col("c_custkey"), F.concat(F.lit('"'), "c_name", F.lit(', ""'), "c_mktsegment", F.lit('"""'))
    rest = F.when(key % 3 == 0, ',"two\nlines"').when(key % 3 == 1, ",,last").otherwise("")
    line = F.struct(key.alias("key"), F.concat(key.cast("string"), F.lit(","), named, rest).alias("line"))
    files = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(line))["line"].alias("lines"))
    ends = F.when(F.col("c_nationkey") % 2 == 0, F.concat_ws("\r\n", "lines")).otherwise(F.concat_ws("\n", "lines"))
    rows = tables.csv_rows(files.select(F.col("c_nationkey").alias("id"), F.encode(ends, "UTF-8").alias("content")), key="id")
    return rows.select("id", "row", F.posexplode("fields").alias("col", "value"))
