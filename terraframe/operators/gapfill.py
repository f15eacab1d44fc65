"""Filling gaps of pixel series. Positions are indices in time, not dates; valid values never change.

``fill_linear`` is windows over rows. The others run on series (``values ARRAY<DOUBLE>``), vectorised over all
pixels of a batch: their recurrences go over time once, whatever the number of pixels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.frames import fresh
from .tiles import map_series

METHODS = ("linear", "savgol", "pchip", "ets", "gauss")


def fill_linear(df: DataFrame, keys: list[str], order: str, value: str = "value", out: str = "filled") -> DataFrame:
    """Between the neighbours by index; before the first and after the last valid value, that value."""
    w = W.partitionBy(*keys).orderBy(order)
    t, before, behind = fresh(df, "t", "a", "b")
    df = df.withColumn(t, F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    b = F.first(known, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    df = df.withColumn(before, a).withColumn(behind, b)
    a, b = (lambda c: F.col(f"{before}.{c}")), (lambda c: F.col(f"{behind}.{c}"))
    between = a("v") + (F.col(t) - a("t")) / (b("t") - a("t")) * (b("v") - a("v"))
    return df.withColumn(out, F.coalesce(F.col(value), between, a("v"), b("v"))).drop(t, before, behind)


def linear(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    t = np.arange(n)
    known = ~np.isnan(x)
    last = np.maximum.accumulate(np.where(known, t, -1), 1)
    following = np.minimum.accumulate(np.where(known, t, n)[:, ::-1], 1)[:, ::-1]
    row = np.arange(len(x))[:, None]
    a, b = x[row, np.maximum(last, 0)], x[row, np.minimum(following, n - 1)]
    share = (t - last) / np.maximum(following - last, 1)
    return np.where(known, x, np.where(last < 0, b, np.where(following >= n, a, a + share * (b - a))))


def odd_window(window: int) -> int:
    window = max(3, int(window))
    return window + 1 - window % 2


def _symmetric(x: np.ndarray, window: int, weigh) -> np.ndarray:
    """Gaps by a weighted sum over a window that shrinks alike on both sides at the ends."""
    full, n = linear(x), x.shape[1]
    out = full.copy()
    for t in range(n):
        half = min(window // 2, t, n - 1 - t)
        out[:, t] = full[:, t - half : t + half + 1] @ weigh(half)
    return np.where(np.isnan(x), out, x)


def savgol(x: np.ndarray, window: int = 5) -> np.ndarray:
    """Quadratic least squares at the window's middle."""

    def weigh(half: int) -> np.ndarray:
        k = np.arange(-half, half + 1.0)
        s0, s2, s4 = len(k), (k**2).sum(), (k**4).sum()
        return (s4 - k**2 * s2) / (s0 * s4 - s2 * s2) if half else np.ones(1)

    return _symmetric(x, odd_window(window), weigh)


def gauss(x: np.ndarray, window: int = 5) -> np.ndarray:
    window = odd_window(window)
    sigma = window / 4.0

    def weigh(half: int) -> np.ndarray:
        w = np.exp(-0.5 * (np.arange(-half, half + 1.0) / sigma) ** 2)
        return w / w.sum()

    return _symmetric(x, window, weigh)


def _compact(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Valid values moved to the front: counts, times and values; what is behind them is of no meaning."""
    known = ~np.isnan(x)
    order = np.argsort(~known, axis=1, kind="stable")
    return known.sum(1), order.astype(float), np.take_along_axis(x, order, 1)


def pchip(x: np.ndarray) -> np.ndarray:
    """Cubic Hermite. Interior slopes are weighted means of the slope before, as already updated, and the secant; a limiter
    then goes over the segments in order."""
    n, t, y = _compact(x)
    size = x.shape[1]
    knots = np.arange(size)
    inner = knots[None, :] < n[:, None] - 1
    h = np.where(inner[:, :-1], np.diff(t, axis=1), 1.0) if size > 1 else np.empty((len(x), 0))
    secant = np.where(inner[:, :-1], np.diff(np.nan_to_num(y), axis=1) / h, 0.0)
    d = np.zeros_like(x)
    d[:, : size - 1] = secant
    end = np.maximum(n - 1, 0)
    row = np.arange(len(x))
    some = n >= 2
    d[row[some], end[some]] = d[row[some], end[some] - 1]
    for k in range(1, size - 1):
        w1, w2 = 2 * h[:, k] + h[:, k - 1], h[:, k] + 2 * h[:, k - 1]
        d[:, k] = np.where(k < n - 1, (w1 * d[:, k - 1] + w2 * d[:, k]) / (w1 + w2), d[:, k])
    for k in range(size - 1):
        here, s = k < n - 1, secant[:, k]
        flat = np.abs(s) < 1e-14
        safe = np.where(flat, 1.0, s)
        a, b = d[:, k] / safe, d[:, k + 1] / safe
        tau = a * a + b * b
        steep = here & ~flat & (tau > 9)
        scale = 3 * s / np.sqrt(np.maximum(tau, 1e-300))
        d[:, k] = np.where(here & flat, 0.0, np.where(steep, scale * a, d[:, k]))
        d[:, k + 1] = np.where(here & flat, 0.0, np.where(steep, scale * b, d[:, k + 1]))
    known = ~np.isnan(x)
    before = np.cumsum(known, 1) - 1
    lo = np.clip(before, 0, np.maximum(n - 2, 0)[:, None])
    hi = np.minimum(lo + 1, size - 1)
    r = row[:, None]
    width = np.maximum(t[r, hi] - t[r, lo], 1e-12)
    u = (knots[None, :] - t[r, lo]) / width
    y = np.nan_to_num(y)
    curve = (2 * u**3 - 3 * u**2 + 1) * y[r, lo] + (u**3 - 2 * u**2 + u) * width * d[r, lo] + (3 * u**2 - 2 * u**3) * y[r, hi] + (u**3 - u**2) * width * d[r, hi]
    inside = (before >= 0) & (before < n[:, None] - 1)
    return np.where(known, x, np.where(inside, curve, linear(x)))


# The constants that are tried.
ALPHAS = tuple(0.1 + k * 0.2 for k in range(5))
BETAS = tuple(0.05 + k * 0.1 for k in range(5))


def ets(x: np.ndarray) -> np.ndarray:
    """Holt's linear trend with the best of 25 pairs of constants; a gap gets level and trend as they stand before it."""
    n, t, y = _compact(x)
    size = x.shape[1]
    y = np.nan_to_num(y)
    if size < 3:
        return linear(x)
    start = (y[:, 1] - y[:, 0]) / np.maximum(t[:, 1] - t[:, 0], 1.0)
    best, alpha, beta = np.full(len(x), np.inf), np.full(len(x), 0.3), np.full(len(x), 0.1)
    for a in ALPHAS:
        for b in BETAS:
            level, trend, error = y[:, 0], start, np.zeros(len(x))
            for k in range(1, size):
                on = k < n
                new = a * y[:, k] + (1 - a) * (level + trend)
                trend = np.where(on, b * (new - level) + (1 - b) * trend, trend)
                level = np.where(on, new, level)
                error = error + np.where(on, (y[:, k] - level) ** 2, 0)
            better = error < best
            best, alpha, beta = np.where(better, error, best), np.where(better, a, alpha), np.where(better, b, beta)
    known = ~np.isnan(x)
    out, level, trend = np.nan_to_num(x), y[:, 0], start
    seen = np.zeros(len(x), int)
    for k in range(size):
        on = known[:, k]
        late = on & (seen > 0)
        new = alpha * out[:, k] + (1 - alpha) * (level + trend)
        trend = np.where(late, beta * (new - level) + (1 - beta) * trend, trend)
        level = np.where(late, new, level)
        out[:, k] = np.where(on, out[:, k], level + trend)
        seen += on
    plain = linear(x)
    count = np.cumsum(known, 1)
    edge = (count == 0) | (count == n[:, None])
    return np.where(known, x, np.where(edge | (n <= 2)[:, None], plain, out))


def smooth(x: np.ndarray, window: int = 5) -> np.ndarray:
    """Savitzky-Golay over valid neighbours only; valid positions are rewritten, gaps stay. Sums are added neighbour by
    neighbour, the last first, as a join in SQL adds them: a matrix product's order hangs on the batch, and equal peaks on the order."""
    half_full, n = odd_window(window) // 2, x.shape[1]
    out = x.copy()
    for t in range(n):
        half = min(half_full, t, n - 1 - t)
        k = np.arange(-half, half + 1.0)
        w = x[:, t - half : t + half + 1]
        known = ~np.isnan(w)
        v = np.where(known, w, 0)
        s0, s1, s2, s3, s4 = (known @ k**p for p in range(5))
        y0, y1, y2 = (sum((v[:, j] * k[j] ** p for j in reversed(range(len(k)))), np.zeros(len(x))) for p in range(3))
        det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
        fit = y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2)
        ok = (np.abs(det) >= 1e-12) & ~np.isnan(x[:, t])
        out[:, t] = np.where(ok, fit / np.where(ok, det, 1), x[:, t])
    return out


def interpolate_gaps(series: DataFrame, method: str = "linear", window: int = 5, values: str = "values", out: str = "filled") -> DataFrame:
    """Series with their gaps filled; a series without any value stays as it is."""
    kernels = {"linear": linear, "savgol": lambda x: savgol(x, window), "pchip": pchip, "ets": ets, "gauss": lambda x: gauss(x, window)}
    if method not in kernels:
        raise ValueError(f"unknown method {method!r}; known: {list(kernels)}")
    return map_series(series, kernels[method], values, out)


def savgol_smooth(series: DataFrame, window: int = 5, values: str = "values", out: str = "smoothed") -> DataFrame:
    return map_series(series, lambda x: smooth(x, window), values, out)


def unfold(series: DataFrame, keys: list[str], values: str = "filled", out: str = "value") -> DataFrame:
    """(keys, t_idx, value), t_idx from 0."""
    return series.select(*keys, F.posexplode(values).alias("t_idx", out))
