"""Spreadsheet cells as tables: display text, styles, merges, sizes, overflow, charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.rounding import half_up


def display_values(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """cells (.., type, value) with display: shared strings by index (none there: empty), booleans, texts, numbers.

    strings (idx, text) is joined without a hint: it may be small enough to be broadcast, or large and shuffled. Cells
    without an index are then dealt by their position, so they don't gather in one task.
    """
    index = F.when(F.col("type") == "s", F.regexp_extract("value", "^\\s*([0-9]+)", 1).try_cast("long"))
    place = lambda there, x: F.struct(F.lit(there).alias("there"), x.cast("long").alias("x"))
    at = F.when(index.isNotNull(), place(True, index)).otherwise(place(False, F.monotonically_increasing_id()))
    listed = strings.where("idx is not null").select(place(True, F.col("idx")).alias("idx"), "text")
    found = cells.withColumn("idx", at).join(listed, "idx", "left")
    shown = F.when(F.col("type") == "s", F.coalesce("text", F.lit(""))).when(F.col("type") == "b", F.when(F.col("value") == "1", "TRUE").otherwise("FALSE"))
    return found.withColumn("display", shown.otherwise(F.coalesce("value", F.lit("")))).drop("idx", "text")


def styled(cells: DataFrame, xfs: DataFrame, fonts: DataFrame, fills: DataFrame) -> DataFrame:
    """Star join of a cell's style to its font and fill; missing ones have the defaults 11 points, no fill, general format."""
    out = cells.join(xfs, cells["style"] == xfs["xf"], "left").join(fonts, "font", "left").join(fills, "fill", "left")
    return out.select(*cells.columns, F.coalesce("size", F.lit(11)).alias("size"), F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("rgb", F.lit("none")).alias("rgb"), F.coalesce("num_fmt", F.lit(0)).alias("num_fmt"))


def merge_owner(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """cells (keys, row, col) with the merge that covers them (the last one listed) and whether they are its origin.

    Rectangles are enumerated to their cells, so the range join is one on equal (row, col).
    """
    rows = merges.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    owner = rows.groupBy(*keys, "row", "col").agg(F.max(F.struct("seq", "r0", "c0")).alias("m"))
    out = cells.join(owner, [*keys, "row", "col"], "left")
    origin = (F.col("row") == F.col("m.r0")) & (F.col("col") == F.col("m.c0"))
    return out.select(*cells.columns, F.col("m.seq").alias("merge"), F.coalesce(origin, F.lit(True)).alias("drawn"))


def row_heights(records: DataFrame, keys: list[str], default: float = 15.0) -> DataFrame:
    """Height of each row: 0 if any of its records hides it, else the last record's, else the default."""
    own = records.groupBy(*keys, "row").agg(F.max("hidden").alias("hidden"), F.max_by("height", "seq").alias("height"))
    return own.select(*keys, "row", F.when(F.col("hidden"), 0.0).otherwise(F.coalesce("height", F.lit(default))).alias("height"))


def overflow(cells: DataFrame, keys: list[str], width: Column, need: Column) -> DataFrame:
    """Last column that a text may cover: it grows over empty cells until it fits or the next text begins.

    cells (keys, col, text, ...) hold every column of a row, empty ones with an empty text. Columns are read from the last
    to the first, as a frame up to the end of the row is computed anew for every cell.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("col"))
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = cells.withColumn("_w", width).withColumn("_need", need)
    rows = rows.withColumn("_stop", F.min(F.when(F.col("text") != "", F.col("col"))).over(ahead)).withColumn("_last", F.max("col").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    limit = F.coalesce(F.col("_stop") - 1, F.col("_last"))
    wanted = F.col("col") + F.greatest(F.ceil(F.col("_need") / F.col("_w")) - 1, F.lit(0))
    return rows.where("text <> ''").select(*cells.columns, F.least(limit, wanted).cast("int").alias("end_col"))


def nice(value: Column, up: bool) -> Column:
    """The 1-2-5-10 number at or above value (up) or near it."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    part = value / power
    steps = ((1.0, 1), (2.0, 2), (5.0, 5)) if up else ((1.5, 1), (3.0, 2), (7.0, 5))
    out = F.lit(10)
    for most, n in reversed(steps):
        out = F.when(part <= most if up else part < most, n).otherwise(out)
    return out * power


def nice_axis(least: Column, most: Column) -> Column:
    """Struct lo, hi, step of an axis of about five steps; it begins at 0 if all values are positive."""
    low = F.least(least, F.lit(0.0))
    high = F.when(most == low, low + 1).otherwise(most)
    step = nice(nice(high - low, True) / 5, False)
    return F.struct((F.floor(low / step) * step).alias("lo"), (F.ceil(high / step) * step).alias("hi"), step.alias("step"))


def pie(slices: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Start and sweep of each slice in radians, from 12 o'clock; slices under 0.001 turn on without being drawn."""
    w = Window.partitionBy(*keys)
    before = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(value).over(w)
    turn = F.lit(2 * 3.141592653589793)
    out = slices.withColumn("sweep", F.when(total != 0, F.col(value) / total * turn))
    start = F.coalesce(F.sum(value).over(before), F.lit(0)) / total * turn - turn / 4
    return out.withColumn("start", F.when(total != 0, start)).withColumn("drawn", F.coalesce(F.col("sweep") >= 0.001, F.lit(False)))


def banded(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The first `most` rows of each key with their number and the parity that colours them."""
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    return numbered.where(F.col("n") < most).withColumn("band", F.pmod("n", F.lit(2)))


def column_widths(cells: DataFrame, keys: list[str], width: Column, page: float, least: float = 40.0) -> DataFrame:
    """Natural widths (at least `least`) brought to the page's width: all stretched where they are narrower, else each shrunk, but not below `least`."""
    natural = cells.groupBy(*keys, "col").agg(F.greatest(F.lit(least), F.max(width)).alias("natural"))
    total = F.sum("natural").over(Window.partitionBy(*keys))
    scaled = F.col("natural") * (F.lit(page) / total)
    return natural.withColumn("width", F.when(total <= page, scaled).otherwise(F.greatest(F.lit(least), scaled)))


def round6(x: Column) -> Column:
    return half_up(x * 1e6) / 1e6
