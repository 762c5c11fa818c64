"""What the decoders share: the pixel grid, errors, limits, bytes."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from mosaiq.operators.limits import MAX_PIXELS


class DecodeError(ValueError):
    """A file that can't be decoded; becomes the error column of its row."""


@dataclass
class Grid:
    """Pixels, RGBA: an array of height x width x 4 bytes."""

    rgba: np.ndarray

    @property
    def width(self) -> int:
        return self.rgba.shape[1]

    @property
    def height(self) -> int:
        return self.rgba.shape[0]


def check_size(w: float, h: float) -> tuple[int, int]:
    if not (np.isfinite(w) and np.isfinite(h)) or w < 1 or h < 1:
        raise DecodeError("Invalid image dimensions")
    if w * h > MAX_PIXELS:
        raise DecodeError("Image too large")
    return int(w), int(h)


def half_up(x):
    return np.floor(np.asarray(x, dtype=np.float64) + 0.5)


def opaque(rgb: np.ndarray) -> Grid:
    """A grid of an h x w x 3 array."""
    out = np.full((*rgb.shape[:2], 4), 255, np.uint8)
    out[..., :3] = rgb
    return Grid(out)


def gray(values: np.ndarray) -> Grid:
    return opaque(np.repeat(values[..., None], 3, axis=2))


def unpack(fmt: str, data: bytes, at: int = 0) -> tuple:
    try:
        return struct.unpack_from(fmt, data, at)
    except struct.error:
        raise DecodeError("Unexpected end of file") from None


def padded(data: bytes, n: int) -> np.ndarray:
    """The first n bytes, zeros where the data end."""
    got = np.frombuffer(data[:n], np.uint8)
    return got if len(got) == n else np.concatenate((got, np.zeros(n - len(got), np.uint8)))


def bits_to_samples(rows: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Samples of 1, 2, 4 or 8 bits from rows of bytes, highest bits first."""
    if bits == 8:
        return rows[:, :width]
    flat = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits)
    return (flat << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2).astype(np.uint8)[:, :width]


def packbits(data: bytes, at: int, size: int) -> tuple[bytes, int]:
    """PackBits from `at` until `size` bytes are out; (bytes, where it stopped)."""
    out = bytearray()
    while len(out) < size and at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out[:size]), at
