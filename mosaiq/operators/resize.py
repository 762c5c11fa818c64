"""Fit geometry and resampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mosaiq.functions.rounding import half_up


def scaled_rect(w: Column, h: Column, to_w: Column, to_h: Column, fit: Column) -> Column:
    """Struct of the source crop and the target rectangle for a fit mode.

    cover crops the source around its centre, contain letterboxes, anything else (fill) stretches.
    Null in any argument gives null fields.
    """
    sx, sy = to_w.cast("double") / w, to_h.cast("double") / h
    cover, contain = fit == "cover", fit == "contain"
    scale = F.when(cover, F.greatest(sx, sy)).otherwise(F.least(sx, sy))
    src_w = F.when(cover, half_up(to_w / scale)).otherwise(w)
    src_h = F.when(cover, half_up(to_h / scale)).otherwise(h)
    dst_w = F.when(contain, half_up(w * scale)).otherwise(to_w)
    dst_h = F.when(contain, half_up(h * scale)).otherwise(to_h)
    fields = {
        "src_x": half_up((w - src_w) / 2), "src_y": half_up((h - src_h) / 2), "src_w": src_w, "src_h": src_h,
        "dst_x": half_up((to_w - dst_w) / 2), "dst_y": half_up((to_h - dst_h) / 2), "dst_w": dst_w, "dst_h": dst_h,
    }
    return F.struct(*(v.cast("int").alias(k) for k, v in fields.items()))
