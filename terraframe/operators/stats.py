"""Statistics of bands and of pixels over time.

``keys`` name a pixel (or a band); missing observations are NULL in the value column, and a pixel without any
keeps its row. Each operator aggregates or windows by the same keys, so that one exchange serves them.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.frames import fresh, with_group

TINY = 1e-12


def days_between(ts: Column, first: Column) -> Column:
    """Fractional days."""
    return F.timestamp_diff("MICROSECOND", first, ts) / 86400e6


def valid_obs_count(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("count"), (F.count(value) / F.count(F.lit(1))).alias("fraction"))


SHARES = (0.10, 0.25, 0.50, 0.75, 0.90)


def _quantiles(value: str) -> tuple[Column, list[Column]]:
    """The aggregate, and its columns."""
    return F.percentile(value, F.array(*map(F.lit, SHARES))).alias("q"), [F.get("q", F.lit(k)).alias(f"p{round(100 * s)}") for k, s in enumerate(SHARES)]


def pixel_quantiles(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    agg, columns = _quantiles(value)
    return df.groupBy(*keys).agg(agg).select(*keys, *columns)


def pixel_iqr(df: DataFrame, keys: list[str], value: str = "value", fence: float = 1.5) -> DataFrame:
    """The rows with iqr and outlier (Tukey's fences, strict); NULL with fewer than two observations."""
    w = W.partitionBy(*keys)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).over(w)
    (own,) = fresh(df, "q")
    df = df.withColumn(own, F.when(F.count(value).over(w) >= 2, q))
    a, b = F.get(own, F.lit(0)), F.get(own, F.lit(1))
    out = (F.col(value) < a - fence * (b - a)) | (F.col(value) > b + fence * (b - a))
    return df.withColumn("iqr", b - a).withColumn("outlier", out).drop(own)


def raster_band_stats(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """mean, std (with 1e-12 under the root), min, max; zeros for no pixels."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*keys).agg(zero(F.avg(value)).alias("mean"), zero(F.sqrt(F.var_pop(value) + 1e-12)).alias("std"), zero(F.min(value)).alias("min"), zero(F.max(value)).alias("max"))


def band_stats(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """mean, population std, min, max of valid pixels; zeros for none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*keys).agg(zero(F.avg(value)).alias("mean"), zero(F.stddev_pop(value)).alias("std"), zero(F.min(value)).alias("min"), zero(F.max(value)).alias("max"))


def dataset_stats(df: DataFrame, band: str = "band", value: str = "value") -> DataFrame:
    """Over all scenes: mean, std, min, max, n_pixels of each band; no pixels give mean 0 and std 1."""
    d = lambda c, x: F.coalesce(c, F.lit(x))
    return df.groupBy(band).agg(
        d(F.avg(value), 0.0).alias("mean"), d(F.stddev_pop(value), 1.0).alias("std"), d(F.min(value), 0.0).alias("min"), d(F.max(value), 0.0).alias("max"), F.count(value).alias("n_pixels")
    )


def merge_stats(parts: DataFrame, band: str = "band") -> DataFrame:
    """Merge partial statistics (band, n, mean, m2, min, max) of disjoint pixels."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))
    total = parts.groupBy(band).agg(n.alias("n"), mean.alias("mean"), F.sum("m2").alias("_m2"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_q"), F.min("min").alias("min"), F.max("max").alias("max"))
    m2 = F.greatest(F.lit(0.0), F.col("_m2") + F.col("_q") - F.col("n") * F.col("mean") * F.col("mean"))
    return total.select(band, "n", "mean", F.sqrt(m2 / F.when(F.col("n") > 0, F.col("n"))).alias("std"), "min", "max")


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def band_covariance(df: DataFrame, bands: list[str], keys: list[str] | None = None) -> DataFrame:
    """Sample covariance of every pair of band columns, (band_a, band_b, cov), both triangles.
    Means are over each band's own valid pixels, products over those valid in both; fewer than two give NULL."""
    keys = keys or []
    pairs = list(combinations_with_replacement(bands, 2))
    means = df.groupBy(*keys).agg(*[F.avg(b).alias(f"_m_{b}") for b in bands])  # one row per group
    joined = df.join(means, keys) if keys else df.crossJoin(F.broadcast(means))
    aggs = []
    for a, b in pairs:
        x, y = F.col(a) - F.col(f"_m_{a}"), F.col(b) - F.col(f"_m_{b}")
        n = F.count(x * y)
        aggs.append((F.sum(x * y) / F.when(n >= 2, n - 1)).alias(f"{a}|{b}"))
    wide = joined.groupBy(*keys).agg(*aggs)
    cells = [F.struct(F.lit(p).alias("band_a"), F.lit(q).alias("band_b"), F.col(f"`{a}|{b}`").alias("cov")) for a, b in pairs for p, q in {(a, b), (b, a)}]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def pearson(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """r over pairs valid in both; NULL below three, 0 where one does not vary."""
    both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), True)
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    g = df.groupBy(*keys).agg(F.count(both).alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("va"), F.var_pop(y).alias("vb"))
    root = F.sqrt(F.col("va") * F.col("vb")) * F.col("n")
    return g.select(*keys, F.when(F.col("n") >= 3, F.when(root <= TINY, 0.0).otherwise(F.col("c") * F.col("n") / F.when(root > TINY, root))).alias("r"))


def _regression(x: str, y: str) -> tuple[list[Column], list[Column]]:
    """The aggregates, and the columns made of them."""
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), True)
    u, v = F.when(both, F.col(x)), F.when(both, F.col(y))
    aggs = [F.count(both).alias("r_n"), F.avg(u).alias("r_mx"), F.avg(v).alias("r_my"), F.covar_pop(u, v).alias("r_c"), F.var_pop(u).alias("r_vx"), F.var_pop(v).alias("r_vy")]
    n, mx, my, c, vx, vy = (F.col(f"r_{k}") for k in ("n", "mx", "my", "c", "vx", "vy"))
    flat = vx < TINY
    slope = F.when(flat, 0.0).otherwise(c / F.when(~flat, vx))
    r2 = F.when(flat | (n * vy < TINY), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c * c / F.when(~flat & (vy > 0), vx * vy))))
    ok = lambda e: F.when(n >= 2, e)
    return aggs, [ok(slope).alias("slope"), ok(my - slope * mx).alias("intercept"), ok(r2).alias("r2")]


def pixel_regression(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """slope, intercept, r2 of least squares; NULL below two points; (0, mean, 0) where x does not vary."""
    aggs, columns = _regression(x, y)
    return df.groupBy(*keys).agg(*aggs).select(*keys, *columns)


def regression_on(df: DataFrame, keys: list[str], predictor: DataFrame, t: str = "t", x: str = "x", y: str = "value") -> DataFrame:
    """``pixel_regression`` on a predictor that all pixels share. predictor: t, x, one row for each time."""
    (own,) = fresh(df, "x")
    joined = with_group(df, predictor.select(F.col(t), F.col(x).alias(own)), [t], [own])
    return pixel_regression(joined, keys, own, y)


def pixel_profile(df: DataFrame, keys: list[str], x: str = "day", y: str = "value") -> DataFrame:
    """Coverage, quantiles and trend of each pixel from one aggregate: count, fraction, p10 to p90, slope, intercept, r2."""
    q, quantiles = _quantiles(y)
    aggs, trend = _regression(x, y)
    g = df.groupBy(*keys).agg(F.count(y).alias("count"), (F.count(y) / F.count(F.lit(1))).alias("fraction"), q, *aggs)
    return g.select(*keys, "count", "fraction", *quantiles, *trend)


def time_window_stats(df: DataFrame, keys: list[str], day: str = "day", value: str = "value", window_days: float = 30) -> DataFrame:
    """mean, std (sample; 0 for one), slope within half a window of the middle of the pixel's own valid dates. One window per pixel."""
    if window_days < 1:
        raise ValueError("window_days must be at least 1")
    w = W.partitionBy(*keys)
    own = F.when(F.col(value).isNotNull(), F.col(day))
    middle = (F.min(own).over(w) + F.max(own).over(w)) / 2
    (inside,) = fresh(df, "in")
    df = df.withColumn(inside, F.col(value).isNotNull() & (F.abs(F.col(day) - middle) <= window_days / 2))
    x, y = F.when(F.col(inside), F.col(day)), F.when(F.col(inside), F.col(value))
    g = df.groupBy(*keys).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("s"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("v"))
    flat = F.col("n") * F.col("v") <= TINY
    return g.select(*keys, "mean", F.when(F.col("n") >= 1, F.coalesce("s", F.lit(0.0))).alias("std"), F.when(F.col("n") >= 1, F.when(flat, 0.0).otherwise(F.col("c") / F.when(~flat, F.col("v")))).alias("slope"))


def anomaly_zscore(df: DataFrame, keys: list[str], day: str = "day", value: str = "value", window_days: float = 30, background: DataFrame | None = None) -> DataFrame:
    """(value - mean) / std by the background (keys, mean, std), which is that of ``time_window_stats`` by default."""
    bg = background if background is not None else time_window_stats(df, keys, day, value, window_days)
    mean, std = fresh(df, "mean", "std")
    joined = df.join(bg.select(*keys, F.col("mean").alias(mean), F.col("std").alias(std)), keys, "left")
    return joined.withColumn("zscore", F.when(F.col(std) >= TINY, (F.col(value) - F.col(mean)) / F.when(F.col(std) >= TINY, F.col(std)))).drop(mean, std)


def temporal_gap_stats(df: DataFrame, keys: list[str], day: str = "day", value: str = "value", order: str | None = None) -> DataFrame:
    """Largest and mean days between consecutive valid observations; NULL below two."""
    w = W.partitionBy(*keys).orderBy(order or day)
    before = F.last(F.when(F.col(value).isNotNull(), F.col(day)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    gap = F.when(F.col(value).isNotNull(), F.col(day) - before)
    (own,) = fresh(df, "gap")
    return df.withColumn(own, gap).groupBy(*keys).agg(F.max(own).alias("max_gap"), F.avg(own).alias("mean_gap"))


def fill_report(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    gaps = F.count_if(F.col(before).isNull())
    return df.groupBy(*keys).agg(gaps.alias("gaps"), F.count_if(F.col(before).isNull() & F.col(after).isNotNull()).alias("filled"))


def summary(df: DataFrame, keys: list[str], value: str = "value", above: float = 0.5) -> DataFrame:
    n = F.count(value)
    return df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), (100.0 * F.count_if(F.col(value) > above) / F.when(n > 0, n)).alias("pct_above"))


def mahalanobis(df: DataFrame, bands: list[str]) -> DataFrame:
    """The rows with their distance from the mean in units of the covariance. Only the B x B matrix comes to the driver."""
    import numpy as np

    rows = {(r["band_a"], r["band_b"]): r["cov"] for r in band_covariance(df, bands).collect()}
    inverse = np.linalg.pinv(np.array([[rows[a, b] for b in bands] for a in bands], float))
    mean = df.agg(*[F.avg(b) for b in bands]).first()
    x = [F.col(b) - F.lit(float(m)) for b, m in zip(bands, mean)]
    total = _sum([float(inverse[i, j]) * x[i] * x[j] for i in range(len(bands)) for j in range(len(bands))])
    return df.withColumn("mahalanobis", F.sqrt(F.greatest(F.lit(0.0), total)))


def principal_components(df: DataFrame, bands: list[str], k: int) -> DataFrame:
    """The rows with pc1..pck. Only the B x B matrix comes to the driver."""
    import numpy as np

    rows = {(r["band_a"], r["band_b"]): r["cov"] for r in band_covariance(df, bands).collect()}
    _, vectors = np.linalg.eigh(np.array([[rows[a, b] for b in bands] for a in bands], float))
    mean = df.agg(*[F.avg(b) for b in bands]).first()
    x = [F.col(b) - F.lit(float(m)) for b, m in zip(bands, mean)]
    parts = []
    for c in range(k):
        v = vectors[:, -1 - c]
        v = v * (1 if v[np.abs(v).argmax()] > 0 else -1)
        parts.append(_sum([float(w) * e for w, e in zip(v, x)]).alias(f"pc{c + 1}"))
    return df.select("*", *parts)
