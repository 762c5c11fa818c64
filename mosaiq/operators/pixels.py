"""Pixels as rows (image, y, x, channels): lookups, resampling, composition, and decoding that is a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.rounding import half_up

CHANNELS = ("r", "g", "b", "a")


def palette_lookup(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """pixels (.., idx) with the palette's colour; an index beyond the palette is transparent black."""
    found = pixels.join(palette, "idx", "left")
    return found.select(*pixels.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"), F.when(F.col("r").isNull(), 0).otherwise(255).alias("a"))


def interlaced_rows(height: int, spark) -> DataFrame:
    """(n, y): the picture row that the n-th stored row of an interlaced GIF holds."""
    y = F.col("y")
    at = F.when(y % 8 == 0, 0).when(y % 8 == 4, 1).when(y % 4 == 2, 2).otherwise(3)
    rows = spark.range(height).select(F.col("id").cast("int").alias("y")).withColumn("pass", at)
    return rows.select((F.row_number().over(Window.orderBy("pass", "y")) - 1).alias("n"), "y")


def undelta(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Running sums modulo 256: the Sub filter, predictor 2 and DC prediction."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("decoded", F.pmod(F.sum(value).over(w), F.lit(256)).cast("int"))


def bilinear(pixels: DataFrame, sizes: DataFrame, to_w: int, to_h: int, key: str = "img") -> DataFrame:
    """Stretch every image to to_w x to_h: four equal joins of the target grid with the source pixels.

    pixels (key, y, x, r, g, b, a), sizes (key, w, h).
    """
    grid = sizes.select(key, "w", "h", F.explode(F.sequence(F.lit(0), F.lit(to_h - 1))).alias("ty")).withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(to_w - 1))))
    at = lambda t, n, size: F.greatest(F.lit(0.0), F.least((F.col(t) + 0.5) / n * F.col(size) - 0.5, F.col(size) - 1.0))
    grid = grid.withColumn("sx", at("tx", to_w, "w")).withColumn("sy", at("ty", to_h, "h"))
    grid = grid.withColumn("x0", F.floor("sx").cast("int")).withColumn("y0", F.floor("sy").cast("int"))
    grid = grid.withColumn("x1", F.least(F.col("x0") + 1, F.col("w") - 1).cast("int")).withColumn("y1", F.least(F.col("y0") + 1, F.col("h") - 1).cast("int"))
    grid = grid.withColumn("fx", F.col("sx") - F.col("x0")).withColumn("fy", F.col("sy") - F.col("y0"))
    for y, x, n in (("y0", "x0", "tl"), ("y0", "x1", "tr"), ("y1", "x0", "bl"), ("y1", "x1", "br")):
        side = pixels.select(key, F.col("y").alias(y), F.col("x").alias(x), F.struct(*CHANNELS).alias(n))
        grid = grid.join(side, [key, y, x])
    mixed = []
    for c in CHANNELS:
        v = lambda n, c=c: F.col(n)[c].cast("double")
        top, low = v("tl") + (v("tr") - v("tl")) * F.col("fx"), v("bl") + (v("br") - v("bl")) * F.col("fx")
        mixed.append(half_up(top + (low - top) * F.col("fy")).cast("int").alias(c))
    return grid.select(key, F.col("ty").alias("y"), F.col("tx").alias("x"), *mixed)


def composite(canvas: DataFrame, placed: DataFrame, pixels: DataFrame, key: str = "img") -> DataFrame:
    """Paint images, scaled to their rectangles by the nearest pixel, over a canvas (y, x, r, g, b, a).

    placed (key, z, dx, dy, dw, dh, w, h); pixels (key, y, x, ...). Rectangles are enumerated, so joins are on equal pixels.
    """
    rows = placed.withColumn("cy", F.explode(F.sequence("dy", F.col("dy") + F.col("dh") - 1))).withColumn("cx", F.explode(F.sequence("dx", F.col("dx") + F.col("dw") - 1)))
    rows = rows.withColumn("y", F.floor((F.col("cy") - F.col("dy")) * F.col("h") / F.col("dh")).cast("int")).withColumn("x", F.floor((F.col("cx") - F.col("dx")) * F.col("w") / F.col("dw")).cast("int"))
    tops = rows.join(pixels, [key, "y", "x"]).where("a > 0")
    layers = tops.groupBy(F.col("cy").alias("y"), F.col("cx").alias("x")).agg(F.array_sort(F.collect_list(F.struct("z", "r", "g", "b", "a"))).alias("layers"))
    from mosaiq.functions.color import over

    base = F.struct(*(F.col(c).cast("int").alias(c) for c in CHANNELS))
    out = canvas.join(layers, ["y", "x"], "left")
    return out.select("y", "x", F.when(F.col("layers").isNull(), base).otherwise(over(F.col("layers"), base)).alias("p")).select("y", "x", "p.*")
