"""Pixel and vector relations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import color
from mosaiq.operators import pixels, spans
from mosaiq.plans.registry import query
from mosaiq.session import table


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))


@query(
    "palette_lookup",
    """
WITH p AS (SELECT event_id, (user_id % 300)::INT AS idx FROM events), c AS (SELECT range::INT AS idx, (range * 7 % 256)::INT AS r, (range * 13 % 256)::INT AS g, (range * 29 % 256)::INT AS b FROM range(256))
SELECT event_id, p.idx, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, CASE WHEN r IS NULL THEN 0 ELSE 255 END AS a FROM p LEFT JOIN c USING (idx)
""",
)
def palette_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 300).cast("int").alias("idx"))
    part = lambda k, n: (F.col("id") * k % 256).cast("int").alias(n)
    palette = spark.range(256).select(F.col("id").cast("int").alias("idx"), part(7, "r"), part(13, "g"), part(29, "b"))
    return pixels.palette_lookup(rows, palette)


@query(
    "gif_deinterlace",
    """
WITH r AS (SELECT range AS y, CASE WHEN range % 8 = 0 THEN 0 WHEN range % 8 = 4 THEN 1 WHEN range % 4 = 2 THEN 2 ELSE 3 END AS p FROM range(333))
SELECT (row_number() OVER (ORDER BY p, y) - 1)::INT AS n, y::INT AS y FROM r
""",
)
def gif_deinterlace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.interlaced_rows(333, spark)


@query(
    "delta_decode",
    """
SELECT l_orderkey, k, (sum(q) OVER (PARTITION BY l_orderkey ORDER BY k ROWS UNBOUNDED PRECEDING) % 256)::INT AS decoded
FROM (SELECT l_orderkey, l_quantity::INT * 5 AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS k FROM lineitem)
""",
)
def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity").cast("int") * 5).alias("q"), k.alias("k"))
    return pixels.undelta(rows, ["l_orderkey"], "k", "q").drop("q")


@query(
    "dds_mask",
    """
WITH m AS (SELECT o_orderkey AS id, o_orderkey * 2654435761 % 4294967296 AS v, m FROM orders, (VALUES (16711680::BIGINT), (63488::BIGINT), (2016::BIGINT), (31::BIGINT), (0::BIGINT)) t(m))
SELECT id, m AS mask, CASE WHEN m = 0 THEN 255 ELSE floor(((v & m) // greatest(m & -m, 1)) * 255.0 / (2.0 ^ bit_count(m) - 1) + 0.5)::INT END AS channel FROM m
""",
)
def dds_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keys(spark, sf_dir).withColumn("v", F.col("id") * 2654435761 % 4294967296)
    rows = rows.withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for m in (0xFF0000, 0xF800, 0x7E0, 0x1F, 0)))))
    return rows.select("id", "mask", color.mask_channel(F.col("v"), F.col("mask")).alias("channel"))


@query(
    "rgb565",
    "SELECT o_orderkey AS id, floor(((v >> 11) & 31) * 255.0 / 31 + 0.5)::INT AS r, floor(((v >> 5) & 63) * 255.0 / 63 + 0.5)::INT AS g, floor((v & 31) * 255.0 / 31 + 0.5)::INT AS b FROM (SELECT o_orderkey, o_orderkey * 40503 % 65536 AS v FROM orders)",
)
def rgb565(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).select("id", color.rgb565(F.col("id") * 40503 % 65536).alias("c")).select("id", "c.*")


@query(
    "cmyk_rgb",
    """
SELECT id, floor(255 * (1 - c) * (1 - k) + 0.5)::INT AS r, floor(255 * (1 - m) * (1 - k) + 0.5)::INT AS g, floor(255 * (1 - y) * (1 - k) + 0.5)::INT AS b
FROM (SELECT o_orderkey AS id, (o_orderkey % 17) / 16.0::DOUBLE AS c, (o_orderkey * 5 % 17) / 16.0::DOUBLE AS m, (o_orderkey * 7 % 17) / 16.0::DOUBLE AS y, (o_orderkey * 11 % 9) / 8.0::DOUBLE AS k FROM orders)
""",
)
def cmyk_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return _keys(spark, sf_dir).select("id", color.cmyk_to_rgb(i % 17 / 16.0, i * 5 % 17 / 16.0, i * 7 % 17 / 16.0, i * 11 % 9 / 8.0).alias("c")).select("id", "c.*")


@query(
    "ycbcr_rgb",
    """
WITH v AS (SELECT o_orderkey AS id, (o_orderkey * 37 % 256)::INT AS y, (o_orderkey * 59 % 256)::INT AS cb, (o_orderkey * 83 % 256)::INT AS cr FROM orders)
SELECT id, greatest(0, least(255, floor(y + (cr - 128) * 1.402::DOUBLE + 0.5)))::INT AS r, greatest(0, least(255, floor(y - (cb - 128) * 0.344136::DOUBLE - (cr - 128) * 0.714136::DOUBLE + 0.5)))::INT AS g,
  greatest(0, least(255, floor(y + (cb - 128) * 1.772::DOUBLE + 0.5)))::INT AS b, greatest(0, least(255, (298 * (y - 16) + 409 * (cr - 128) + 128) >> 8))::INT AS vr,
  greatest(0, least(255, floor((298 * (y - 16) - 100 * (cb - 128) - 208 * (cr - 128) + 128) / 256)))::INT AS vg, greatest(0, least(255, floor((298 * (y - 16) + 516 * (cb - 128) + 128) / 256)))::INT AS vb FROM v
""".replace("(298 * (y - 16) + 409 * (cr - 128) + 128) >> 8", "floor((298 * (y - 16) + 409 * (cr - 128) + 128) / 256)"),
)
def ycbcr_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = [(F.col("id") * k % 256).cast("int") for k in (37, 59, 83)]
    rows = _keys(spark, sf_dir).select("id", color.ycbcr_to_rgb(*part).alias("f"), color.ycbcr_limited_to_rgb(*part).alias("v"))
    return rows.select("id", "f.*", *(F.col("v." + c).alias("v" + c) for c in "rgb"))


@query(
    "alpha_blend",
    """
WITH RECURSIVE l AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS z, (event_id * 31 % 256)::INT AS r, (event_id * 57 % 256)::INT AS g, (event_id * 91 % 256)::INT AS b, (event_id * 17 % 256)::INT AS a FROM events
), s AS (
  SELECT user_id, 0::BIGINT AS z, 255 AS r, 255 AS g, 255 AS b, 255 AS a FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT s.user_id, l.z, floor(l.r * (l.a / 255.0::DOUBLE) + s.r * (1 - l.a / 255.0::DOUBLE) + 0.5)::INT, floor(l.g * (l.a / 255.0::DOUBLE) + s.g * (1 - l.a / 255.0::DOUBLE) + 0.5)::INT,
    floor(l.b * (l.a / 255.0::DOUBLE) + s.b * (1 - l.a / 255.0::DOUBLE) + 0.5)::INT, least(255, floor(l.a + s.a * (1 - l.a / 255.0::DOUBLE) + 0.5)::INT) FROM s JOIN l ON l.user_id = s.user_id AND l.z = s.z + 1
)
SELECT user_id, arg_max(r, z) AS r, arg_max(g, z) AS g, arg_max(b, z) AS b, arg_max(a, z) AS a FROM s GROUP BY user_id
""",
)
def alpha_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k, n: (F.col("event_id") * k % 256).cast("int").alias(n)
    layer = F.struct(F.col("event_id").alias("z"), part(31, "r"), part(57, "g"), part(91, "b"), part(17, "a"))
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(layer)).alias("layers"))
    white = F.struct(*(F.lit(255).alias(c) for c in "rgba"))
    return per.select("user_id", color.over(F.col("layers"), white).alias("p")).select("user_id", "p.*")


# A star of seven points for each nation, 64 x 64.
_STAR = """
WITH v AS (SELECT n_nationkey AS id, k.range AS ord, (n_nationkey * 7 + k.range * k.range * 23 + k.range * 11) % 64 + 0.25::DOUBLE AS x, (n_nationkey * 3 + k.range * 37) % 61 + 0.125::DOUBLE AS y FROM nation, range(7) k),
p AS (SELECT a.id, a.ord, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM v a JOIN v b ON a.id = b.id AND b.ord = (a.ord + 1) % 7),
e AS (SELECT id, ord, least(y0, y1) AS y_min, greatest(y0, y1) AS y_max, CASE WHEN y1 > y0 THEN x0 ELSE x1 END AS x, (x1 - x0) / (y1 - y0) AS slope, CASE WHEN y1 > y0 THEN 1 ELSE -1 END AS dir FROM p WHERE abs(y1 - y0) >= 0.001),
h AS (SELECT id, ord, l.range AS line, dir, x + (l.range + 0.5 - y_min) * slope AS x FROM e JOIN range(64) l ON y_min <= l.range + 0.5 AND l.range + 0.5 < y_max)
"""


def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("ord"))
    n, k = F.col("id"), F.col("ord")
    return rows.select("id", "ord", ((n * 7 + k * k * 23 + k * 11) % 64 + 0.25).alias("x"), ((n * 3 + k * 37) % 61 + 0.125).alias("y"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.crossings(spans.edges(_star(spark, sf_dir), ["id"], "ord"), ["id"], 64)


@query("edges_scan", _STAR + "SELECT id, ord::INT AS ord, line::INT AS line, dir, floor(x * 1e6 + 0.5) / 1e6 AS x FROM h")
def edges_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).withColumn("x", F.floor(F.col("x") * 1e6 + 0.5) / 1e6)


@query(
    "nonzero_spans",
    _STAR + """, w AS (SELECT *, sum(dir) OVER (PARTITION BY id, line ORDER BY x, ord ROWS UNBOUNDED PRECEDING) AS s FROM h),
t AS (SELECT *, lead(x) OVER (PARTITION BY id, line ORDER BY x, ord) AS x_end FROM w WHERE s = 0 OR s - dir = 0)
SELECT id, line::INT AS line, greatest(0, floor(x))::INT AS x_from, least(63, floor(x_end))::INT AS x_to FROM t WHERE s - dir = 0 AND s <> 0 AND x_end IS NOT NULL AND greatest(0, floor(x)) <= least(63, floor(x_end))
""",
)
def nonzero_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.nonzero_spans(_hits(spark, sf_dir), ["id"], 64)


@query(
    "evenodd_spans",
    _STAR + """, w AS (SELECT *, row_number() OVER (PARTITION BY id, line ORDER BY x, ord) AS n, lead(x) OVER (PARTITION BY id, line ORDER BY x, ord) AS x_end FROM h)
SELECT id, line::INT AS line, greatest(0, floor(x))::INT AS x_from, least(63, floor(x_end))::INT AS x_to FROM w WHERE n % 2 = 1 AND x_end IS NOT NULL AND greatest(0, floor(x)) <= least(63, floor(x_end))
""",
)
def evenodd_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.evenodd_spans(_hits(spark, sf_dir), ["id"], 64)


_IMAGES = """
WITH RECURSIVE s AS (SELECT n_nationkey AS img, 5 + n_nationkey % 7 AS w, 4 + n_nationkey % 5 AS h FROM nation),
p AS (SELECT img, yy.range AS y, xx.range AS x, ((img * 31 + yy.range * 17 + xx.range * 5) % 256)::INT AS r, ((yy.range * 40 + img) % 256)::INT AS g, ((xx.range * 60) % 256)::INT AS b, (255 - (yy.range + xx.range) * 9 % 256)::INT AS a FROM s, range(8) yy, range(11) xx WHERE yy.range < h AND xx.range < w)
"""


def _images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("n_nationkey")
    sizes = table(spark, sf_dir, "nation").select(n.alias("img"), (n % 7 + 5).alias("w"), (n % 5 + 4).alias("h"))
    grid = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    i, y, x = F.col("img"), F.col("y"), F.col("x")
    return sizes, grid.select("img", "y", "x", ((i * 31 + y * 17 + x * 5) % 256).alias("r"), ((y * 40 + i) % 256).alias("g"), (x * 60 % 256).alias("b"), (255 - (y + x) * 9 % 256).alias("a"))


@query(
    "resize_bilinear",
    _IMAGES + """, g AS (SELECT img, w, h, ty.range AS ty, tx.range AS tx, greatest(0, least((tx.range + 0.5::DOUBLE) / 9 * w - 0.5::DOUBLE, w - 1)) AS sx, greatest(0, least((ty.range + 0.5::DOUBLE) / 6 * h - 0.5::DOUBLE, h - 1)) AS sy FROM s, range(6) ty, range(9) tx),
q AS (SELECT *, floor(sx) AS x0, floor(sy) AS y0, least(floor(sx) + 1, w - 1) AS x1, least(floor(sy) + 1, h - 1) AS y1, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM g)
SELECT q.img, ty::INT AS y, tx::INT AS x,
""" + ",\n".join(f"  floor((tl.{c} + (tr.{c} - tl.{c}) * fx) + ((bl.{c} + (br.{c} - bl.{c}) * fx) - (tl.{c} + (tr.{c} - tl.{c}) * fx)) * fy + 0.5)::INT AS {c}" for c in "rgba") + """
FROM q JOIN p tl ON tl.img = q.img AND tl.x = x0 AND tl.y = y0 JOIN p tr ON tr.img = q.img AND tr.x = x1 AND tr.y = y0 JOIN p bl ON bl.img = q.img AND bl.x = x0 AND bl.y = y1 JOIN p br ON br.img = q.img AND br.x = x1 AND br.y = y1
""",
)
def resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, rows = _images(spark, sf_dir)
    return pixels.bilinear(rows, sizes, 9, 6)


@query(
    "composite_nn",
    _IMAGES + """, c AS (SELECT yy.range AS y, xx.range AS x FROM range(40) yy, range(40) xx),
k AS (SELECT img, img AS z, img % 6 * 5 AS dx, img % 4 * 7 AS dy, 6 + img % 3 AS dw, 5 + img % 4 AS dh, w, h FROM s),
t AS (SELECT cc.y, cc.x, p.r, p.g, p.b, p.a, row_number() OVER (PARTITION BY cc.y, cc.x ORDER BY z) AS n FROM k JOIN c cc ON cc.x >= dx AND cc.x < dx + dw AND cc.y >= dy AND cc.y < dy + dh
  JOIN p ON p.img = k.img AND p.x = floor((cc.x - dx) * w / dw) AND p.y = floor((cc.y - dy) * h / dh) WHERE p.a > 0),
f AS (SELECT y, x, 0::BIGINT AS n, 255 AS r, 255 AS g, 255 AS b, 255 AS a FROM c
  UNION ALL SELECT f.y, f.x, t.n, floor(t.r * (t.a / 255.0::DOUBLE) + f.r * (1 - t.a / 255.0::DOUBLE) + 0.5)::INT, floor(t.g * (t.a / 255.0::DOUBLE) + f.g * (1 - t.a / 255.0::DOUBLE) + 0.5)::INT,
    floor(t.b * (t.a / 255.0::DOUBLE) + f.b * (1 - t.a / 255.0::DOUBLE) + 0.5)::INT, least(255, floor(t.a + f.a * (1 - t.a / 255.0::DOUBLE) + 0.5)::INT) FROM f JOIN t ON t.y = f.y AND t.x = f.x AND t.n = f.n + 1)
SELECT y::INT AS y, x::INT AS x, arg_max(r, n) AS r, arg_max(g, n) AS g, arg_max(b, n) AS b, arg_max(a, n) AS a FROM f GROUP BY f.y, f.x
""",
)
def composite_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, rows = _images(spark, sf_dir)
    i = F.col("img")
    placed = sizes.select("img", i.alias("z"), (i % 6 * 5).alias("dx"), (i % 4 * 7).alias("dy"), (i % 3 + 6).alias("dw"), (i % 4 + 5).alias("dh"), "w", "h")
    canvas = spark.range(1600).select(F.floor(F.col("id") / 40).cast("int").alias("y"), (F.col("id") % 40).cast("int").alias("x"), *(F.lit(255).alias(c) for c in "rgba"))
    return pixels.composite(canvas, placed, rows)


@query(
    "gradient_mean",
    """
WITH s AS (SELECT o_custkey AS gradient, (o_orderkey * 37 % 256)::INT AS r, (o_orderkey * 59 % 256)::INT AS g, (o_orderkey * 83 % 256)::INT AS b, (o_orderkey % 5) / 4.0::DOUBLE AS opacity FROM orders)
SELECT gradient, floor(avg(r) + 0.5)::INT AS r, floor(avg(g) + 0.5)::INT AS g, floor(avg(b) + 0.5)::INT AS b, floor(avg(255 * opacity) + 0.5)::INT AS a FROM s GROUP BY gradient
""",
)
def gradient_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    stops = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gradient"), (i * 37 % 256).alias("r"), (i * 59 % 256).alias("g"), (i * 83 % 256).alias("b"), (i % 5 / 4.0 * 255).alias("a"))
    return stops.groupBy("gradient").agg(*(F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in "rgba"))


@query("pnm_scale", "SELECT o_orderkey AS id, floor((o_orderkey * 977 % (m + 1)) * 255.0 / m + 0.5)::INT AS v FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 15 WHEN 1 THEN 1023 ELSE 65535 END AS m FROM orders)")
def pnm_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    most = F.when(i % 3 == 0, 15).when(i % 3 == 1, 1023).otherwise(65535)
    return _keys(spark, sf_dir).select("id", color.scale_to_byte(i * 977 % (most + 1), most).alias("v"))


@query(
    "hex_rgb",
    "SELECT p_partkey, t AS text, CASE WHEN regexp_matches(t, '^#?[0-9A-Fa-f]{6}$') THEN ('0x' || substr(ltrim(t, '#'), 1, 2))::INT END AS r, CASE WHEN regexp_matches(t, '^#?[0-9A-Fa-f]{6}$') THEN ('0x' || substr(ltrim(t, '#'), 3, 2))::INT END AS g, CASE WHEN regexp_matches(t, '^#?[0-9A-Fa-f]{6}$') THEN ('0x' || substr(ltrim(t, '#'), 5, 2))::INT END AS b FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE '#' || printf('%06X', (p_partkey * 104729 % 16777216)::BIGINT) END AS t FROM part)",
)
def hex_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    t = F.when(k % 4 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("#"), F.lpad(F.hex(k * 104729 % 16777216), 6, "0")))
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("text"), color.from_hex(t).alias("c")).select("p_partkey", "text", "c.*")
