"""Fit geometry and bilinear resampling of whole grids; the same rules as the relational ones in mosaiq.operators."""

from __future__ import annotations

import math

import numpy as np

from mosaiq.codecs.base import Grid, half_up


def scaled_rect(w: int, h: int, to_w: int, to_h: int, fit: str) -> tuple[tuple[int, int, int, int], tuple[int, int, int, int]]:
    """((x, y, w, h) of the source, (x, y, w, h) of the target)."""
    r = lambda v: math.floor(v + 0.5)
    if fit == "cover":
        s = max(to_w / w, to_h / h)
        cw, ch = r(to_w / s), r(to_h / s)
        return (r((w - cw) / 2), r((h - ch) / 2), cw, ch), (0, 0, to_w, to_h)
    if fit == "contain":
        s = min(to_w / w, to_h / h)
        ow, oh = r(w * s), r(h * s)
        return (0, 0, w, h), (r((to_w - ow) / 2), r((to_h - oh) / 2), ow, oh)
    return (0, 0, w, h), (0, 0, to_w, to_h)


def resize(grid: Grid, to_w: int, to_h: int, fit: str = "cover") -> Grid:
    if (grid.width, grid.height) == (to_w, to_h):
        return grid
    (sx, sy, sw, sh), (dx, dy, dw, dh) = scaled_rect(grid.width, grid.height, to_w, to_h, fit)
    out = np.zeros((to_h, to_w, 4), np.uint8)
    if dw < 1 or dh < 1:
        return Grid(out)

    def taps(begin, size, n, most):
        at = np.clip(begin + (np.arange(n) + 0.5) / n * size - 0.5, 0, most - 1)
        low = np.floor(at).astype(np.int64)
        return low, np.minimum(low + 1, most - 1), at - low

    x0, x1, fx = taps(sx, sw, dw, grid.width)
    y0, y1, fy = taps(sy, sh, dh, grid.height)
    fx = fx[:, None]
    for i in range(0, dh, 256):  # in bands of rows, to bound the memory
        rows = slice(i, i + 256)
        p, q = grid.rgba[y0[rows]].astype(np.float64), grid.rgba[y1[rows]].astype(np.float64)
        top, low = p[:, x0] + (p[:, x1] - p[:, x0]) * fx, q[:, x0] + (q[:, x1] - q[:, x0]) * fx
        band = half_up(top + (low - top) * fy[rows][:, None, None]).astype(np.uint8)
        y = dy + i
        a, b = max(0, y), min(to_h, y + len(band))
        u, v = max(0, dx), min(to_w, dx + dw)
        if a < b and u < v:
            out[a:b, u:v] = band[a - y : b - y, u - dx : v - dx]
    return Grid(out)
