"""Polygon filling as relations: edges, the scan lines that they cross, and spans by windows over each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, ord, y_min, y_max, x, slope, dir) of closed polygons given by ordered (x, y); nearly flat edges are dropped."""
    w = Window.partitionBy(*keys).orderBy(order)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(everything))
    both = points.select(*keys, F.col(order).alias("ord"), F.col("x").alias("x0"), F.col("y").alias("y0"), nxt("x").alias("x1"), nxt("y").alias("y1"))
    both = both.where(F.abs(F.col("y1") - F.col("y0")) >= 0.001)
    down = F.col("y1") > F.col("y0")
    pick = lambda a, b: F.when(down, F.col(a)).otherwise(F.col(b))
    return both.select(
        *keys, "ord", F.least("y0", "y1").alias("y_min"), F.greatest("y0", "y1").alias("y_max"), pick("x0", "x1").alias("x"),
        ((F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("slope"), F.when(down, 1).otherwise(-1).alias("dir"),
    )


def crossings(found: DataFrame, keys: list[str], height: int) -> DataFrame:
    """(keys, line, x, dir, ord): each edge at the lines whose centre it spans; lines are enumerated, so nothing is joined."""
    low = F.greatest(F.lit(0), F.ceil(F.col("y_min") - 0.5)).cast("int")
    high = F.least(F.lit(height - 1), F.ceil(F.col("y_max") - 0.5) - 1).cast("int")
    rows = found.where(low <= high).withColumn("line", F.explode(F.sequence(low, high)))
    return rows.select(*keys, "line", "ord", "dir", (F.col("x") + (F.col("line") + 0.5 - F.col("y_min")) * F.col("slope")).alias("x"))


def nonzero_spans(hits: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, line, x_from, x_to), ends included: a span opens where the winding number leaves 0 and closes where it returns."""
    w = Window.partitionBy(*keys, "line").orderBy("x", "ord")
    wound = hits.withColumn("sum", F.sum("dir").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    wound = wound.withColumn("open", (F.col("sum") - F.col("dir") == 0) & (F.col("sum") != 0)).withColumn("shut", (F.col("sum") == 0) & (F.col("dir") != 0))
    ends = wound.where("open or shut").withColumn("x_end", F.lead("x").over(w))
    return _clip(ends.where("open and x_end is not null"), keys, width)


def evenodd_spans(hits: DataFrame, keys: list[str], width: int) -> DataFrame:
    w = Window.partitionBy(*keys, "line").orderBy("x", "ord")
    paired = hits.withColumn("n", F.row_number().over(w)).withColumn("x_end", F.lead("x").over(w))
    return _clip(paired.where("n % 2 = 1 and x_end is not null"), keys, width)


def _clip(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    begin, end = F.greatest(F.lit(0), F.floor("x")).cast("int"), F.least(F.lit(width - 1), F.floor("x_end")).cast("int")
    return rows.select(*keys, "line", begin.alias("x_from"), end.alias("x_to")).where("x_from <= x_to")
