"""Affine maps and boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def multiply(first: Column, then: Column) -> Column:
    """Array of six: `first`, then `then`, over row vectors."""
    a, b, c, d, e, f = (F.get(first, i) for i in range(6))
    p, q, r, s, t, u = (F.get(then, i) for i in range(6))
    return F.array(a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def composed(matrices: Column) -> Column:
    """The product of an ordered array of matrices, the first applied first."""
    one = F.array(*(F.lit(float(v)) for v in (1, 0, 0, 1, 0, 0)))
    return F.aggregate(matrices, one, multiply)


def bounds(m: Column, w: Column, h: Column) -> Column:
    """Struct x0, y0, x1, y1 of the image of a w x h rectangle."""
    at = lambda i, j, k: [F.get(m, k) + (F.get(m, i) * w if dx else 0) + (F.get(m, j) * h if dy else 0) for dx in (0, 1) for dy in (0, 1)]
    xs, ys = at(0, 2, 4), at(1, 3, 5)
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def free_spans(left: Column, right: Column, x: Column, w: Column) -> Column:
    """Array of struct (from, to): what a box [x, x + w) leaves of a line, parts of at most one point not counted."""
    part = lambda a, b: F.struct(a.cast("double").alias("from"), b.cast("double").alias("to"))
    outside = (x + w <= left) | (x >= right)
    split = F.filter(F.array(part(left, x), part(x + w, right)), lambda s: s["to"] - s["from"] > 1)
    return F.when(outside, F.array(part(left, right))).otherwise(split)
