"""One file at a time: the three calls, and the same over DataFrames in mosaiq.operators.thumbnails."""

from __future__ import annotations

import base64
import os

from mosaiq.codecs import registry
from mosaiq.codecs.base import DecodeError
from mosaiq.codecs.registry import register_decoder  # noqa: F401
from mosaiq.operators.limits import MAX_INPUT_BYTES


def _load(source: str | os.PathLike | bytes) -> bytes:
    if isinstance(source, bytes | bytearray | memoryview):
        data = bytes(source)
        if len(data) > MAX_INPUT_BYTES:
            raise DecodeError("Input file too large")
        return data
    if not isinstance(source, str | os.PathLike):
        raise DecodeError("Input must be a path or bytes")
    if os.path.getsize(source) > MAX_INPUT_BYTES:
        raise DecodeError("Input file too large")
    with open(source, "rb") as f:
        return f.read()


def thumbnail(source: str | os.PathLike | bytes, width: int | None = None, height: int | None = None, fit: str | None = None, type: str | None = None) -> bytes:
    """PNG bytes of a file's thumbnail: 256 x 256, cover, type by content, unless told otherwise."""
    return registry.thumbnail(_load(source), width, height, fit, type)[3]


def thumbnail_as_base64(source: str | os.PathLike | bytes, **options) -> str:
    return base64.b64encode(thumbnail(source, **options)).decode()


def thumbnail_to_file(source: str | os.PathLike | bytes, to: str | os.PathLike, **options) -> None:
    with open(to, "wb") as f:
        f.write(thumbnail(source, **options))
