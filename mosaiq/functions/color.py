"""Colour arithmetic on channel columns; every channel is 0..255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mosaiq.functions.rounding import half_up


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(255)).cast("int")


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Struct r, g, b of inks in 0..1: 255 (1 - ink) (1 - black)."""
    own = lambda x, n: half_up((1 - x) * (1 - k) * 255).cast("int").alias(n)
    return F.struct(own(c, "r"), own(m, "g"), own(y, "b"))


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    """Full-range BT.601 in floating point, as JPEG has it."""
    b, r = cb - 128, cr - 128
    parts = (y + r * 1.402, y - b * 0.344136 - r * 0.714136, y + b * 1.772)
    return F.struct(*(clamp(half_up(p)).alias(n) for p, n in zip(parts, "rgb", strict=True)))


def ycbcr_limited_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    """Limited-range BT.601 in integers, as video has it."""
    c, d, e = (y - 16) * 298, cb - 128, cr - 128
    parts = (c + e * 409 + 128, c - d * 100 - e * 208 + 128, c + d * 516 + 128)
    return F.struct(*(clamp(F.shiftright(p.cast("int"), 8)).alias(n) for p, n in zip(parts, "rgb", strict=True)))


def mask_channel(value: Column, mask: Column) -> Column:
    """The bits of value under mask as 0..255; a zero mask gives 255."""
    bits = F.bit_count(mask)
    low = mask.bitwiseAND(-mask)
    field = (value.bitwiseAND(mask) / F.greatest(low, F.lit(1))).cast("long")
    return F.when(mask == 0, F.lit(255)).otherwise(half_up(field * 255.0 / (F.pow(F.lit(2.0), bits) - 1)).cast("int"))


def rgb565(value: Column) -> Column:
    """Struct r, g, b of a packed 5-6-5 value."""
    part = lambda shift, most, n: half_up(F.shiftright(value, shift).bitwiseAND(most) * 255.0 / most).cast("int").alias(n)
    return F.struct(part(11, 31, "r"), part(5, 63, "g"), part(0, 31, "b"))


def scale_to_byte(value: Column, most: Column) -> Column:
    return half_up(value * 255.0 / most).cast("int")


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(x.cast("long")), 2, "0") for x in (r, g, b))))


def from_hex(text: Column) -> Column:
    """Struct r, g, b of rrggbb with or without #; null where it is none."""
    digits = F.regexp_extract(text, "^#?([0-9A-Fa-f]{6})$", 1)
    part = lambda i, n: F.conv(F.nullif(F.substring(digits, i, 2), F.lit("")), 16, 10).cast("int").alias(n)
    return F.struct(part(1, "r"), part(3, "g"), part(5, "b"))


def tinted(channel: Column, tint: Column) -> Column:
    """Lighter towards white for a positive tint, darker for a negative one; null and 0 change nothing."""
    light = half_up(channel + (255 - channel) * tint)
    return F.when(tint > 0, clamp(light)).when(tint < 0, clamp(half_up(channel * (1 + tint)))).otherwise(channel.cast("int"))


def apply_tint(text: Column, tint: Column) -> Column:
    """rrggbb after the tint, in lower case; unchanged where the tint is null or 0."""
    rgb = from_hex(text)
    return F.when(F.coalesce(tint, F.lit(0.0)) == 0, text).otherwise(to_hex(*(tinted(rgb[n], tint) for n in "rgb")))


def over(layers: Column, background: Column) -> Column:
    """Struct r, g, b, a after painting an ordered array of such structs over background."""

    def paint(under: Column, top: Column) -> Column:
        share = top["a"] / 255.0
        mixed = [half_up(top[n] * share + under[n] * (1 - share)).cast("int").alias(n) for n in "rgb"]
        alpha = F.least(F.lit(255), half_up(top["a"] + under["a"] * (1 - share)).cast("int")).alias("a")
        return F.struct(*mixed, alpha)

    return F.aggregate(layers, background, paint)
