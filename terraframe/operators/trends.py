"""Trends, breaks and seasons of pixels over time. Missing observations are NULL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tiles import map_pairs

TINY = 1e-12


#: Pairs that a kernel holds at once; a single series of more is counted in passes.
PAIRS = 1 << 22


def _observations(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """One row per pixel: its valid observations in time order as two arrays, x and y."""
    valid = F.when(F.col(value).isNotNull(), F.struct(F.col(day).cast("double").alias("x"), F.col(value).cast("double").alias("y")))
    series = df.groupBy(*keys).agg(F.array_sort(F.collect_list(valid)).alias("obs"))
    return series.select(*keys, F.transform("obs", lambda o: o["x"]).alias("x"), F.transform("obs", lambda o: o["y"]).alias("y"))


def _slopes(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Slopes of pairs of columns, NaN for two observations of one time."""
    dx = x[:, j] - x[:, i]
    return np.divide(y[:, j] - y[:, i], dx, out=np.full(dx.shape, np.nan), where=np.abs(dx) > TINY)


def _median_of_long(x: np.ndarray, y: np.ndarray) -> float:
    """The median slope of one long series, in memory that grows with the series, not with its pairs: sampled slopes bracket
    it, a pass counts those below and keeps those inside; the bracket is widened until the middle is inside."""
    n, rng = len(x), np.random.default_rng(0)
    i = rng.integers(0, n - 1, 1 << 18)
    j = rng.integers(i + 1, n)
    seen = np.sort(_slopes(x[None], y[None], i, j)[0])
    seen = seen[~np.isnan(seen)]
    for part in (0.01, 0.05, 0.25, 1.0):
        lo, hi = (-np.inf, np.inf) if part == 1 or not len(seen) else np.quantile(seen, [max(0.0, 0.5 - part), min(1.0, 0.5 + part)])
        below = total = 0
        inside = []
        for k in range(n - 1):
            s = _slopes(x[None], y[None], np.full(n - 1 - k, k), np.arange(k + 1, n))[0]
            s = s[~np.isnan(s)]
            below, total = below + int((s < lo).sum()), total + len(s)
            inside.append(s[(s >= lo) & (s <= hi)])
        kept = np.sort(np.concatenate(inside))
        first, last = (total - 1) // 2 - below, total // 2 - below
        if total and 0 <= first and last < len(kept):
            return float((kept[first] + kept[last]) / 2)
    return np.nan


def _theil_sen(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    m, n = x.shape
    if not n:
        return {"slope": np.full(m, np.nan), "intercept": np.full(m, np.nan)}
    slope = np.zeros(m)
    i, j = np.triu_indices(n, 1) if n * n <= 2 * PAIRS else (None, None)
    if n > 1:
        step = max(1, PAIRS // max(1, n * (n - 1) // 2))
        for lo in range(0, m, step):
            if i is None:
                slope[lo] = _median_of_long(x[lo], y[lo])
                continue
            s = _slopes(x[lo : lo + step], y[lo : lo + step], i, j)
            some = ~np.isnan(s).all(1)
            slope[lo : lo + step][some] = np.nanmedian(s[some], 1)
    slope = np.nan_to_num(slope)
    return {"slope": slope, "intercept": np.median(y, 1) - (slope * np.median(x, 1) if n > 1 else 0.0)}


def theil_sen(df: DataFrame, keys: list[str], day: str = "day", value: str = "value") -> DataFrame:
    """Median of all slopes, and intercept; (0, value) for one observation, NULL for none. One exchange by pixel; slopes
    are made in batches of series of one length and never leave the kernel."""
    return map_pairs(_observations(df, keys, day, value), _theil_sen, "x", "y", ["slope", "intercept"])


def _mann_kendall(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    m, n = y.shape
    out = {k: np.full(m, np.nan) for k in ("S", "varS", "Z", "trend")}
    if n < 4:
        return out
    s = np.zeros(m)
    for k in range(n - 1):
        s += np.sign(y[:, k + 1 :] - y[:, k : k + 1]).sum(1)
    ordered = np.sort(y, 1)
    start = np.concatenate([np.ones((m, 1), bool), ordered[:, 1:] != ordered[:, :-1]], 1)
    first = np.flatnonzero(start)
    size = np.diff(np.append(first, m * n)).astype(float)
    ties = np.bincount(first // n, size * (size - 1) * (2 * size + 5), m)
    var = (n * (n - 1) * (2 * n + 5) - ties) / 18
    z = np.divide(s - np.sign(s), np.sqrt(np.maximum(var, 0)), out=np.zeros(m), where=var >= TINY)
    return {"S": s, "varS": var, "Z": z, "trend": np.where(np.abs(z) > 1.96, np.sign(z), 0.0)}


def mann_kendall(df: DataFrame, keys: list[str], day: str = "day", value: str = "value") -> DataFrame:
    """S, its tie-corrected variance, Z and trend (-1, 0, 1 at |Z| > 1.96); NULL below four observations."""
    return map_pairs(_observations(df, keys, day, value), _mann_kendall, "x", "y", ["S", "varS", "Z", "trend"])


def breakpoint_scan(df: DataFrame, keys: list[str], day: str = "day", value: str = "value") -> DataFrame:
    """The break that leaves the least residuals of two lines: break_day, magnitude, rss_ratio; NULL below six observations.
    Sums are of days and values less their pixel's means."""
    w = W.partitionBy(*keys)
    t = df.where(F.col(value).isNotNull()).select(*keys, F.col(day).alias("d"), F.col(value).alias("v"))
    t = t.withColumn("n", F.count("v").over(w)).withColumn("x", F.col("d") - F.avg("d").over(w)).withColumn("y", F.col("v") - F.avg("v").over(w))
    order = W.partitionBy(*keys).orderBy("d")
    t = t.withColumn("k", F.row_number().over(order)).withColumn("d2", F.lead("d").over(order)).withColumn("x2", F.lead("x").over(order))
    up = order.rowsBetween(W.unboundedPreceding, 0)
    terms = {"sx": F.col("x"), "sy": F.col("y"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y")}
    t = t.select("*", *[F.sum(e).over(up).alias(f"l_{k}") for k, e in terms.items()], *[F.sum(e).over(w).alias(f"t_{k}") for k, e in terms.items()])

    def line(n: Column, s: dict[str, Column]) -> tuple[Column, Column, Column]:
        """Residuals, slope and intercept."""
        cxx, cxy, cyy = (s[a] - s[b] * s[c] / n for a, b, c in (("xx", "sx", "sx"), ("xy", "sx", "sy"), ("yy", "sy", "sy")))
        flat = cxx < TINY
        slope = F.when(flat, 0.0).otherwise(cxy / F.when(~flat, cxx))
        return F.greatest(F.lit(0.0), cyy - slope * cxy), slope, (s["sy"] - slope * s["sx"]) / n

    n = F.col("n").cast("double")
    t = t.where((F.col("k") >= 3) & (F.col("k") <= F.col("n") - 3))
    left = line(F.col("k").cast("double"), {k: F.col(f"l_{k}") for k in terms})
    right = line(n - F.col("k"), {k: F.col(f"t_{k}") - F.col(f"l_{k}") for k in terms})
    whole = line(n, {k: F.col(f"t_{k}") for k in terms})
    t = t.select(*keys, "k", (left[0] + right[0]).alias("rss"), whole[0].alias("one"), F.col("d").alias("break_day"), ((right[2] + right[1] * F.col("x2")) - (left[2] + left[1] * F.col("x"))).alias("magnitude"))
    best = t.groupBy(*keys).agg(F.min_by(F.struct("rss", "one", "break_day", "magnitude"), F.struct("rss", "k")).alias("b"))
    out = best.select(*keys, "b.break_day", "b.magnitude", F.when(F.col("b.one") <= TINY, 1.0).otherwise(F.col("b.rss") / F.when(F.col("b.one") > TINY, F.col("b.one"))).alias("rss_ratio"))
    return df.select(*keys).distinct().join(out, keys, "left")


def phenology(df: DataFrame, keys: list[str], day: str = "day", value: str = "value", rising_pct: float = 20, falling_pct: float = 20, least: int = 4) -> DataFrame:
    """Start, peak and end of season in days, and the peak's value. The start is the first upward crossing before the first
    maximum, the end the last downward crossing after it, between observations; NULL below ``least`` observations or without amplitude."""
    w = W.partitionBy(*keys)
    t = df.where(F.col(value).isNotNull()).select(*keys, F.col(day).alias("d"), F.col(value).alias("v"))
    order = W.partitionBy(*keys).orderBy("d")
    t = t.select("*", F.count("v").over(w).alias("n"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"), F.lag("d").over(order).alias("d0"), F.lag("v").over(order).alias("v0"))
    t = t.withColumn("peak", F.min(F.when(F.col("v") == F.col("hi"), F.col("d"))).over(w))
    amp = F.col("hi") - F.col("lo")
    t = t.withColumn("r", F.col("lo") + rising_pct / 100.0 * amp).withColumn("f", F.col("lo") + falling_pct / 100.0 * amp)
    at = lambda thr: F.col("d0") + (F.col(thr) - F.col("v0")) / F.nullif(F.col("v") - F.col("v0"), F.lit(0.0)) * (F.col("d") - F.col("d0"))
    up = (F.col("v0") < F.col("r")) & (F.col("v") >= F.col("r")) & (F.col("d") <= F.col("peak"))
    down = (F.col("v") < F.col("f")) & (F.col("v0") >= F.col("f")) & (F.col("d") > F.col("peak"))
    g = t.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max(amp).alias("amp"), F.min_by(at("r"), F.when(up, F.col("d"))).alias("sos"), F.max("peak").alias("pos"), F.max_by(at("f"), F.when(down, F.col("d"))).alias("eos"), F.max("hi").alias("peak_val")
    )
    ok = (F.col("n") >= least) & (F.col("amp") >= 1e-6)
    out = g.select(*keys, *[F.when(ok, F.col(c)).alias(c) for c in ("sos", "pos", "eos", "peak_val")])
    return df.select(*keys).distinct().join(out, keys, "left")
