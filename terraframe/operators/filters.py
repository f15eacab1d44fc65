"""Neighbourhood filters on stacks of tiles (n, rows, cols).

Windows repeat the edge, except in ``convolve2d``, where what lies outside is left out. A missing tap is left
out and weighted means are weighted anew; where a filter needs every tap (gradients) a missing one has the
centre's value. A missing centre stays missing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .tiles import map_tiles


def _taps(x: np.ndarray, radius: int) -> np.ndarray:
    """(n, rows, cols, taps) of the square window, rows first."""
    p = np.pad(x, ((0, 0), (radius, radius), (radius, radius)), mode="edge")
    w = np.lib.stride_tricks.sliding_window_view(p, (2 * radius + 1, 2 * radius + 1), axis=(1, 2))
    return w.reshape(*x.shape, -1)


def _keep_missing(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), np.nan, out)


def _filled(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(taps), x[..., None], taps)


def convolve2d(x: np.ndarray, kernel) -> np.ndarray:
    """Correlation with a kernel; half its size, rounded down, lies before the centre."""
    k = np.asarray(kernel, float)
    a, b = k.shape[0] // 2, k.shape[1] // 2
    p = np.pad(np.nan_to_num(x), ((0, 0), (a, k.shape[0] - 1 - a), (b, k.shape[1] - 1 - b)))
    w = np.lib.stride_tricks.sliding_window_view(p, k.shape, axis=(1, 2))
    return _keep_missing(x, np.einsum("nrcij,ij->nrc", w, k))


def _blur_axis(x: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    radius = len(weights) // 2
    p = np.pad(x, [(radius, radius) if a == axis else (0, 0) for a in range(3)], mode="edge")
    w = np.lib.stride_tricks.sliding_window_view(p, len(weights), axis=axis)
    known = ~np.isnan(w)
    return (np.where(known, w, 0) @ weights) / np.maximum(known @ weights, 1e-300)


def gaussian_blur(x: np.ndarray, sigma: float = 1.0, kradius: int | None = None) -> np.ndarray:
    radius = max(1, math.ceil(3 * sigma)) if kradius is None else kradius
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()
    return _keep_missing(x, _blur_axis(_blur_axis(x, w, 2), w, 1))


def _sobel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = _filled(x, _taps(x, 1))
    gx = (t[..., 2] + 2 * t[..., 5] + t[..., 8]) - (t[..., 0] + 2 * t[..., 3] + t[..., 6])
    gy = (t[..., 6] + 2 * t[..., 7] + t[..., 8]) - (t[..., 0] + 2 * t[..., 1] + t[..., 2])
    return gx, gy


def sobel_magnitude(x: np.ndarray, norm: str = "l2") -> np.ndarray:
    if norm not in ("l1", "l2"):
        raise ValueError(f"norm must be l1 or l2, not {norm!r}")
    gx, gy = _sobel(x)
    return _keep_missing(x, np.abs(gx) + np.abs(gy) if norm == "l1" else np.sqrt(gx * gx + gy * gy))


def sobel_direction(x: np.ndarray) -> np.ndarray:
    gx, gy = _sobel(x)
    return _keep_missing(x, np.arctan2(gy, gx))


def laplacian(x: np.ndarray, connectivity: int = 4) -> np.ndarray:
    if connectivity not in (4, 8):
        raise ValueError(f"connectivity must be 4 or 8, not {connectivity!r}")
    t = _filled(x, _taps(x, 1))
    if connectivity == 4:
        return t[..., [1, 3, 5, 7]].sum(-1) - 4 * x
    return t.sum(-1) - 9 * x


def unsharp_mask(x: np.ndarray, sigma: float = 1.0, amount: float = 1.0, kradius: int | None = None, threshold: float = 0.0) -> np.ndarray:
    rest = x - gaussian_blur(x, sigma, kradius)
    return np.where(np.abs(rest) >= threshold, x + amount * rest, x)


def median_filter(x: np.ndarray, radius: int = 1) -> np.ndarray:
    t = _taps(x, radius)
    return _keep_missing(x, np.median(t, -1) if not np.isnan(x).any() else np.nanmedian(np.where(np.isnan(x)[..., None], 0.0, t), -1))


def bilateral_filter(x: np.ndarray, sigma_s: float = 2.0, sigma_r: float = 0.1, kradius: int | None = None) -> np.ndarray:
    radius = max(1, math.ceil(2 * sigma_s)) if kradius is None else kradius
    d = np.arange(-radius, radius + 1)
    space = -(d[:, None] ** 2 + d[None, :] ** 2).reshape(-1) / (2 * sigma_s**2)
    t = _taps(x, radius)
    known = ~np.isnan(t)
    w = np.where(known, np.exp(space - (np.where(known, t, 0) - x[..., None]) ** 2 / (2 * sigma_r**2)), 0)
    return _keep_missing(x, (w * np.where(known, t, 0)).sum(-1) / np.maximum(w.sum(-1), 1e-300))


def _extreme(x: np.ndarray, radius: int, least: bool) -> np.ndarray:
    t = _taps(np.where(np.isnan(x), np.inf if least else -np.inf, x), radius)
    return _keep_missing(x, t.min(-1) if least else t.max(-1))


def morpho_erode(x: np.ndarray, radius: int = 1) -> np.ndarray:
    return _extreme(x, radius, True)


def morpho_dilate(x: np.ndarray, radius: int = 1) -> np.ndarray:
    return _extreme(x, radius, False)


def morpho_open(x: np.ndarray, radius: int = 1) -> np.ndarray:
    return morpho_dilate(morpho_erode(x, radius), radius)


def morpho_close(x: np.ndarray, radius: int = 1) -> np.ndarray:
    return morpho_erode(morpho_dilate(x, radius), radius)


def top_hat_white(x: np.ndarray, radius: int = 3) -> np.ndarray:
    return x - morpho_open(x, radius)


def top_hat_black(x: np.ndarray, radius: int = 3) -> np.ndarray:
    return morpho_close(x, radius) - x


# Names and defaults of the filters, with their kernels.
FILTERS: dict[str, tuple[Callable[..., np.ndarray], dict]] = {
    "gaussian": (gaussian_blur, {"sigma": 1.0, "kradius": None}),
    "bilateral": (bilateral_filter, {"sigma_s": 2.0, "sigma_r": 0.1, "kradius": None}),
    "median": (median_filter, {"radius": 1}),
    "sobel_magnitude": (sobel_magnitude, {"norm": "l2"}),
    "sobel_direction": (sobel_direction, {}),
    "laplacian": (laplacian, {"connectivity": 4}),
    "unsharp_mask": (unsharp_mask, {"sigma": 1.0, "amount": 1.0, "kradius": None, "threshold": 0.0}),
    "erode": (morpho_erode, {"radius": 1}),
    "dilate": (morpho_dilate, {"radius": 1}),
    "open": (morpho_open, {"radius": 1}),
    "close": (morpho_close, {"radius": 1}),
    "top_hat_white": (top_hat_white, {"radius": 3}),
    "top_hat_black": (top_hat_black, {"radius": 3}),
    "convolve": (convolve2d, {"kernel": None}),
}
AVAILABLE_FILTERS = sorted(FILTERS)


def list_filters() -> dict[str, dict]:
    return {k: dict(params) for k, (_, params) in FILTERS.items()}


def apply_filter(df: DataFrame, name: str, data: str = "data", **params) -> DataFrame:
    """Filter every tile (and so every band, each a row); other columns pass through."""
    key = name.strip().lower()
    if key not in FILTERS:
        raise ValueError(f"unknown filter {name!r}; known: {AVAILABLE_FILTERS}")
    kernel, defaults = FILTERS[key]
    own = defaults | params
    if unknown := set(own) - set(defaults):
        raise ValueError(f"{name} takes no {sorted(unknown)}")
    if key == "convolve" and own["kernel"] is None:
        raise ValueError("convolve needs a kernel")
    kernel(np.zeros((1, 2, 2)), **own)  # wrong parameters fail here, not in a task
    return map_tiles(df, lambda x: kernel(x, **own), data, data)
