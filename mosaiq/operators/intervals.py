"""Lookups in interval and step tables, without theta joins: intervals are cut into equal buckets, or turned into
events and carried forward by a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, order: str, bucket: int = 1024, how: str = "left") -> DataFrame:
    """Each point with the first (by order) interval of its keys that has start <= point < end.

    Intervals are exploded to the buckets of width `bucket` that they touch, so the join is on equal keys and buckets
    and may shuffle like any other; each point is in one bucket. An interval of n buckets makes n rows.
    """
    cols = [c for c in intervals.columns if c not in keys]
    low, high = F.floor(F.col(start) / bucket).cast("long"), F.floor((F.col(end) - 1) / bucket).cast("long")
    spread = intervals.where(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(low, high)))
    spread = spread.select(*keys, "_bucket", F.struct(F.col(order).alias("_order"), *cols).alias("_hit"))
    rows = points.withColumn("_row", F.monotonically_increasing_id()).withColumn("_bucket", F.floor(F.col(point) / bucket).cast("long"))
    inside = (rows[point] >= F.col("_hit")[start]) & (rows[point] < F.col("_hit")[end])
    joined = rows.join(spread, [*keys, "_bucket"], "left")
    joined = joined.withColumn("_hit", F.when(inside, F.col("_hit")))
    best = joined.groupBy("_row", *points.columns).agg(F.min("_hit").alias("_hit"))
    out = best if how == "left" else best.where("_hit is not null")
    return out.select(*points.columns, *(F.col("_hit")[c].alias(c) for c in cols))


def as_of(points: DataFrame, steps: DataFrame, keys: list[str], at: str, value: str, default=None) -> DataFrame:
    """Each point with the value of the last step at or before it: one sort per key over both, no join.

    Points and steps are put together, steps first where they are equal, and the last value is carried forward.
    """
    marked = steps.select(*keys, F.col(at), F.col(value).alias("_value"), F.lit(0).alias("_side"), *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in (*keys, at)))
    both = points.withColumn("_value", F.lit(None).cast(steps.schema[value].dataType)).withColumn("_side", F.lit(1)).unionByName(marked)
    forward = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_value", ignorenulls=True).over(forward)).where("_side = 1")
    last = F.col("_last") if default is None else F.coalesce("_last", F.lit(default))
    return found.select(*points.columns, last.alias(value))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], bucket: int = 256) -> DataFrame:
    """Pairs of [start, end) intervals of the same keys that overlap, with the common part (from, to).

    left has (keys, l_start, l_end, ...), right (keys, r_start, r_end, ...). Both are cut into buckets; a pair is kept in
    the first bucket that both touch.
    """

    def cut(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.where(F.col(s) < F.col(e)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor((F.col(e) - 1) / bucket))))

    both = cut(left, "l_start", "l_end").join(cut(right, "r_start", "r_end"), [*keys, "_bucket"])
    begin, end = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    both = both.where((begin < end) & (F.col("_bucket") == F.floor(begin / bucket)))
    return both.withColumn("from", begin).withColumn("to", end).drop("_bucket")


def runs(rows: DataFrame, keys: list[str], order: str, same: list[str], text: str) -> DataFrame:
    """Gaps and islands: neighbours with equal `same` columns become one run with its texts joined in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    numbered = rows.withColumn("_new", (first | changed).cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return numbered.groupBy(*keys, "run", *same).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias(text), F.count(F.lit(1)).alias("n"), F.min(order).alias("start"))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of least order of each key: sorted by nothing, aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def prefix_positions(rows: DataFrame, keys: list[str], order: str, size: str) -> DataFrame:
    """start: the sizes before each row, within its keys."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)))


def visible_count(rows: DataFrame, keys: list[str], order: str, size: str, page: float) -> DataFrame:
    """How many rows begin before the page's end: the first i >= 1 whose prefix sum is beyond it, else all."""
    placed = prefix_positions(rows, keys, order, size).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    ends = placed.withColumn("_end", F.col("start") + F.col(size))
    return ends.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_end") > page, F.col("_i"))), F.count(F.lit(1))).cast("long").alias("visible"))
