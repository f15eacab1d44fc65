"""Periodic orthogonal wavelets of tiles, several levels, and what is built on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiles import map_tiles

# Low-pass and high-pass taps.
LOW = {
    "haar": (0.7071067811865476, 0.7071067811865476),
    "db4": (0.4829629131445341, 0.8365163037378079, 0.2241438680420134, -0.1294095225512604),
    "db6": (0.3326705529500825, 0.8068915093110924, 0.4598775021184915, -0.1350110200102546, -0.0854412738820267, 0.0352262918857095),
    "coif1": (-0.0156557281357920, -0.0727326195125265, 0.3848648468648578, 0.8525720202116004, 0.3378976624574818, -0.0727326195125265),
    "sym4": (-0.0757657147893551, -0.0296355276459541, 0.4976186676324578, 0.8037387518052163, 0.2978577956052774, -0.0992195435769354, -0.0126039672622612, 0.0322231006040427),
    "sym6": (
        0.0154041093270274, 0.0034907120842175, -0.1179901111481906, -0.0483117425856330, 0.4910559419267466, 0.7876411410301940,
        0.3379294217276218, -0.0726375227864625, -0.0210602925123006, 0.0447249017706658, 0.0017677118642428, -0.0078007083250341,
    ),
}
#: Families whose high-pass taps have the other sign.
NEGATED = ("coif1", "sym6")
WAVELETS = tuple(LOW)
MAD = 0.6744897501960817


def taps(wavelet: str) -> tuple[np.ndarray, np.ndarray]:
    if wavelet not in LOW:
        raise ValueError(f"unknown wavelet {wavelet!r}; known: {list(LOW)}")
    lo = np.array(LOW[wavelet])
    hi = lo[::-1] * np.where(np.arange(len(lo)) % 2, -1.0, 1.0)
    return lo, -hi if wavelet in NEGATED else hi


def dwt1d(x: np.ndarray, wavelet: str = "haar", axis: int = -1) -> np.ndarray:
    """Approximation in the first half, detail in the second."""
    lo, hi = taps(wavelet)
    x = np.moveaxis(x, axis, -1)
    n = x.shape[-1]
    at = (2 * np.arange(n // 2)[:, None] + np.arange(len(lo))[None, :]) % n
    w = x[..., at]
    return np.moveaxis(np.concatenate([w @ lo, w @ hi], -1), -1, axis)


def idwt1d(c: np.ndarray, wavelet: str = "haar", axis: int = -1) -> np.ndarray:
    lo, hi = taps(wavelet)
    c = np.moveaxis(c, axis, -1)
    n = c.shape[-1]
    a, d = c[..., : n // 2], c[..., n // 2 :]
    out = np.zeros(c.shape)
    for j in range(len(lo)):
        at = (2 * np.arange(n // 2) + j) % n
        np.add.at(out, (..., at), a * lo[j] + d * hi[j])
    return np.moveaxis(out, -1, axis)


def _check(rows: int, cols: int, levels: int) -> None:
    if levels < 1 or rows % 2**levels or cols % 2**levels:
        raise ValueError(f"{rows} x {cols} can't be halved {levels} times")


def dwt2d(x: np.ndarray, levels: int = 1, wavelet: str = "haar") -> np.ndarray:
    """The quad tree: LL of the last level at the top left, LH to its right, HL below it, HH between them."""
    _check(*x.shape[1:], levels)
    out = x.astype(float).copy()
    r, c = x.shape[1:]
    for _ in range(levels):
        out[:, :r, :c] = dwt1d(dwt1d(out[:, :r, :c], wavelet, 2), wavelet, 1)
        r, c = r // 2, c // 2
    return out


def idwt2d(x: np.ndarray, levels: int = 1, wavelet: str = "haar") -> np.ndarray:
    _check(*x.shape[1:], levels)
    out = x.copy()
    for k in range(levels - 1, -1, -1):
        r, c = x.shape[1] >> k, x.shape[2] >> k
        out[:, :r, :c] = idwt1d(idwt1d(out[:, :r, :c], wavelet, 1), wavelet, 2)
    return out


def dwt3d(x: np.ndarray, levels: int = 1, wavelet: str = "haar") -> np.ndarray:
    """(times, rows, cols): all levels of every slice, then a cascade over time on the first slices."""
    if x.shape[0] % 2**levels:
        raise ValueError(f"{x.shape[0]} times can't be halved {levels} times")
    out = dwt2d(x, levels, wavelet)
    n = len(out)
    for _ in range(levels):
        out[:n] = dwt1d(out[:n], wavelet, 0)
        n //= 2
    return out


def idwt3d(x: np.ndarray, levels: int = 1, wavelet: str = "haar") -> np.ndarray:
    out = x.copy()
    for k in range(levels - 1, -1, -1):
        out[: len(x) >> k] = idwt1d(out[: len(x) >> k], wavelet, 0)
    return idwt2d(out, levels, wavelet)


def soft(x: np.ndarray, t) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - t, 0)


def _bands(rows: int, cols: int, levels: int):
    for k in range(1, levels + 1):
        r, c = rows >> k, cols >> k
        yield slice(0, r), slice(c, 2 * c)
        yield slice(r, 2 * r), slice(0, c)
        yield slice(r, 2 * r), slice(c, 2 * c)


def sigma_of(band: np.ndarray) -> np.ndarray:
    return np.median(np.abs(band), (1, 2)) / MAD


def bayes_threshold_of(band: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    signal = np.sqrt(np.maximum((band**2).mean((1, 2)) - sigma**2, 0))
    return np.where(signal < 1e-12, np.abs(band).max((1, 2)), sigma**2 / np.maximum(signal, 1e-300))


def denoise(x: np.ndarray, levels: int = 3, wavelet: str = "db4") -> np.ndarray:
    """Each detail band shrunk by its own threshold; the noise is read off the finest diagonal band."""
    c = dwt2d(x, levels, wavelet)
    sigma = sigma_of(c[:, x.shape[1] // 2 :, x.shape[2] // 2 :])
    for r, s in _bands(*x.shape[1:], levels):
        band = c[:, r, s]
        c[:, r, s] = soft(band, bayes_threshold_of(band, sigma)[:, None, None])
    return idwt2d(c, levels, wavelet)


# On DataFrames.


def transform(df: DataFrame, levels: int = 1, wavelet: str = "haar", data: str = "data") -> DataFrame:
    taps(wavelet)
    return map_tiles(df, lambda x: dwt2d(x, levels, wavelet), data, data)


def inverse(df: DataFrame, levels: int = 1, wavelet: str = "haar", data: str = "data") -> DataFrame:
    taps(wavelet)
    return map_tiles(df, lambda x: idwt2d(x, levels, wavelet), data, data)


def _cubes(shape: tuple[int, int, int], kernel):
    return lambda x: np.stack([kernel(cube.reshape(shape)).reshape(cube.shape) for cube in x])


def transform3d(df: DataFrame, shape: tuple[int, int, int], levels: int = 1, wavelet: str = "haar", data: str = "data") -> DataFrame:
    """Rows whose data are cubes of (times, rows, cols); n_rows x n_cols is as many values."""
    taps(wavelet)
    return map_tiles(df, _cubes(shape, lambda x: dwt3d(x, levels, wavelet)), data, data)


def inverse3d(df: DataFrame, shape: tuple[int, int, int], levels: int = 1, wavelet: str = "haar", data: str = "data") -> DataFrame:
    taps(wavelet)
    return map_tiles(df, _cubes(shape, lambda x: idwt3d(x, levels, wavelet)), data, data)


def bayes_denoise(df: DataFrame, levels: int = 3, wavelet: str = "db4", data: str = "data") -> DataFrame:
    taps(wavelet)
    return map_tiles(df, lambda x: denoise(x, levels, wavelet), data, data)


def coefficients(df: DataFrame, keys: list[str], levels: int = 1, data: str = "data") -> DataFrame:
    """(keys, level, subband, row, col, coef) of transformed tiles."""
    i = df.select(*keys, "n_rows", "n_cols", F.posexplode(data).alias("_i", "coef"))
    i = i.withColumn("r", F.expr("_i div n_cols").cast("int")).withColumn("c", (F.col("_i") % F.col("n_cols")).cast("int"))
    level = F.lit(levels)
    for k in range(levels, 0, -1):
        outside = (F.col("r") >= F.floor(F.col("n_rows") / 2**k)) | (F.col("c") >= F.floor(F.col("n_cols") / 2**k))
        level = F.when(outside, F.lit(k)).otherwise(level)
    i = i.withColumn("level", level.cast("int"))
    hr, hc = F.floor(F.col("n_rows") / F.pow(F.lit(2), F.col("level"))), F.floor(F.col("n_cols") / F.pow(F.lit(2), F.col("level")))
    down, right = F.col("r") >= hr, F.col("c") >= hc
    name = F.when(down & right, "HH").when(down, "HL").when(right, "LH").otherwise("LL")
    return i.select(*keys, "level", name.alias("subband"), (F.col("r") - F.when(down, hr).otherwise(0)).cast("int").alias("row"), (F.col("c") - F.when(right, hc).otherwise(0)).cast("int").alias("col"), "coef")


def threshold_coeffs(coef: Column, subband: Column, threshold: float, mode: str = "soft") -> Column:
    """Detail coefficients shrunk (soft) or cleared (hard); the approximation stays."""
    if threshold < 0 or mode not in ("soft", "hard"):
        raise ValueError("threshold must not be negative, mode must be soft or hard")
    small = F.signum(coef) * F.greatest(F.abs(coef) - threshold, F.lit(0.0)) if mode == "soft" else F.when(F.abs(coef) <= threshold, 0.0).otherwise(coef)
    return F.when(subband == "LL", coef).otherwise(small)


def subband_stats(df: DataFrame, keys: list[str], coef: str = "coef") -> DataFrame:
    """energy, mean, variance, mean and largest size, noise sigma and BayesShrink threshold (noise of the band itself) of each sub-band."""
    x = F.col(coef)
    g = df.groupBy(*keys).agg(
        F.sum(x * x).alias("energy"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.avg(F.abs(x)).alias("mean_abs"), F.max(F.abs(x)).alias("max_abs"), (F.percentile(F.abs(x), F.lit(0.5)) / MAD).alias("sigma"), F.avg(x * x).alias("_p")
    )
    return g.withColumn("threshold", bayes_threshold(F.col("_p"), F.col("max_abs"), F.col("sigma"))).drop("_p")


def bayes_threshold(power: Column, largest: Column, sigma: Column) -> Column:
    signal = F.sqrt(F.greatest(power - sigma * sigma, F.lit(0.0)))
    return F.when(signal < 1e-12, largest).otherwise(sigma * sigma / F.when(signal >= 1e-12, signal))
