"""Limits and option defaults; what is over a limit gets an error in a column, never a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MAX_INPUT_BYTES = 512 << 20
MAX_PIXELS = 100_000_000
MAX_INFLATED_BYTES = 256 << 20
MAX_STREAM_BYTES = 256 << 20
MAX_DEPTH = 200
MAX_CMAP_ENTRIES = 1_000_000
MAX_CONTINUE_RECORDS = 10_000
DEFAULT_WIDTH = DEFAULT_HEIGHT = 256
DEFAULT_FIT = "cover"


def dimension_error(w: Column, h: Column) -> Column:
    """What is wrong with an image's size; null if nothing is."""
    bad = w.isNull() | h.isNull() | (w < 1) | (h < 1)
    return F.when(bad, "Invalid image dimensions").when(w.cast("long") * h > MAX_PIXELS, "Image too large")


def input_error(length: Column) -> Column:
    return F.when(length > MAX_INPUT_BYTES, "Input file too large")


def with_defaults(options: DataFrame) -> DataFrame:
    """width, height, fit and type filled in where they are null or not there at all."""
    defaults = {"width": F.lit(DEFAULT_WIDTH), "height": F.lit(DEFAULT_HEIGHT), "fit": F.lit(DEFAULT_FIT), "type": F.lit(None).cast("string")}
    return options.withColumns({n: F.coalesce(F.col(n), v) if n in options.columns else v for n, v in defaults.items()})
