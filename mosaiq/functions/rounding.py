"""Rounding as the file formats' renderers need it: ties toward positive infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """floor(x + 0.5) as a double; Spark's own round() takes ties away from zero."""
    return F.floor(x + F.lit(0.5))
