"""Pictures inside documents: those that can't be decoded are left out."""

from __future__ import annotations

import struct

from mosaiq.codecs.base import Grid


def picture(data: bytes | None) -> Grid | None:
    from mosaiq.codecs import jpeg, paletted, png

    if not data:
        return None
    try:
        if data[:2] == b"\xff\xd8":
            return jpeg.decode_jpeg(data)
        if data[:8] == png.MAGIC:
            return png.decode_png(data)
        if data[:4] == b"GIF8":
            return paletted.decode_gif(data)
    except (ValueError, IndexError, struct.error):
        return None
    return None
