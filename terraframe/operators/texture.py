"""Grey-level co-occurrence texture of tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .tiles import map_tiles

LEVELS = 64
# Row and column steps of an angle, in units of the distance.
STEPS = {0: (0, 1), 45: (-1, 1), 90: (-1, 0), 135: (-1, -1)}


def quantise(x: np.ndarray, lo: float | None = None, hi: float | None = None) -> np.ndarray:
    """Levels 1 to 64 between each tile's least and greatest value (or given ones), 0 for missing."""
    known = ~np.isnan(x)
    low = np.where(known, x, np.inf).min((1, 2), keepdims=True) if lo is None else lo
    high = np.where(known, x, -np.inf).max((1, 2), keepdims=True) if hi is None else hi
    with np.errstate(invalid="ignore"):
        level = ((x - low) * (LEVELS - 1) / np.maximum(high - low, 1e-12)).astype(np.float64)
    return np.where(known, np.trunc(np.where(known, level, 0)).clip(0, LEVELS - 1) + 1, 0).astype(np.int64)


def _one_angle(q: np.ndarray, window: int, dr: int, dc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, rows, cols = q.shape
    pad = max(abs(dr), abs(dc))
    wide = np.pad(q, ((0, 0), (pad, pad), (pad, pad)))
    other = wide[:, pad + dr : pad + dr + rows, pad + dc : pad + dc + cols]
    half = window // 2
    views = [np.lib.stride_tricks.sliding_window_view(np.pad(a, ((0, 0), (half, half), (half, half))), (window, window), axis=(1, 2)).reshape(n, rows, cols, -1) for a in (q, other)]
    a, b = views
    ok = (a > 0) & (b > 0)
    pairs = ok.sum(-1)
    some = np.maximum(pairs, 1)
    d2 = np.where(ok, (a - b) ** 2, 0)
    contrast = d2.sum(-1) / some
    homogeneity = np.where(ok, 1 / (1 + d2), 0).sum(-1) / some
    # Squares of cell counts: runs of equal cells among both orders of all pairs.
    cells = np.concatenate([np.where(ok, a * (LEVELS + 1) + b, -1), np.where(ok, b * (LEVELS + 1) + a, -1)], -1)
    cells.sort(-1)
    at = np.arange(cells.shape[-1])
    first = np.concatenate([np.ones((*cells.shape[:-1], 1), bool), cells[..., 1:] != cells[..., :-1]], -1)
    rank = at - np.maximum.accumulate(np.where(first, at, 0), -1)
    energy = np.where(cells >= 0, 2 * rank + 1, 0).sum(-1) / (2 * some) ** 2
    none = pairs == 0
    return tuple(np.where(none, 0.0, x) for x in (energy, contrast, homogeneity))


def glcm(x: np.ndarray, window: int = 7, distance: int = 1, angle: int = -1, lo: float | None = None, hi: float | None = None) -> dict[str, np.ndarray]:
    q = quantise(x, lo, hi)
    angles = list(STEPS) if angle == -1 else [angle]
    parts = [_one_angle(q, window, STEPS[a][0] * distance, STEPS[a][1] * distance) for a in angles]
    border = window // 2 + distance
    inside = np.zeros(x.shape, bool)
    inside[:, border : x.shape[1] - border, border : x.shape[2] - border] = True
    return {k: np.where(inside, sum(p[i] for p in parts) / len(parts), np.nan) for i, k in enumerate(("energy", "contrast", "homogeneity"))}


def compute_glcm(df: DataFrame, window: int = 7, distance: int = 1, angle: int = -1, lo: float | None = None, hi: float | None = None, data: str = "data") -> DataFrame:
    """Adds energy, contrast and homogeneity arrays. For blocks of a large image, give the image's own ``lo`` and ``hi``,
    so that levels mean the same in every block."""
    if window < 3 or window % 2 == 0:
        raise ValueError("window must be odd and at least 3")
    if angle != -1 and angle not in STEPS:
        raise ValueError(f"angle must be -1 or one of {sorted(STEPS)}")
    return map_tiles(df, lambda x: glcm(x, window, distance, angle, lo, hi), ["energy", "contrast", "homogeneity"], data)
