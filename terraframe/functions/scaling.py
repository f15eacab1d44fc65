"""Rescaling, standardising and stretching of bands. ``keys`` name the columns that tell bands or images apart.

Statistics of a band or image are one aggregate, joined back to its pixels, so that no task holds a whole band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import exact_percentiles, fresh, with_group, with_stats

NODATA = -9999.0
TINY = 1e-12

# Means and standard deviations of pre-training sets.
SSL4EO_S12_ALL = {
    "B02": (1605.57, 1390.58), "B03": (1390.42, 1244.92), "B04": (1314.56, 1347.54), "B05": (1484.54, 1228.58), "B06": (2183.85, 1316.56),
    "B07": (2398.07, 1355.18), "B08": (2298.36, 1383.44), "B8A": (2525.60, 1368.69), "B11": (1796.35, 1198.10), "B12": (1241.28, 990.22),
}
SECO_RGB = {"B04": (1354.99, 2173.26), "B03": (1117.36, 2065.40), "B02": (990.22, 2057.84)}
PRESETS = {"sentinel2_all": SSL4EO_S12_ALL, "sentinel2_rgb": SECO_RGB, "sentinel2_rgbn": {b: SSL4EO_S12_ALL[b] for b in ("B04", "B03", "B02", "B08")}}
AVAILABLE_PRESETS = sorted(PRESETS)


def get_preset(name: str) -> dict[str, tuple[float, float]]:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; known: {AVAILABLE_PRESETS}")
    return PRESETS[name]


def preset_bands(name: str) -> list[str]:
    return list(get_preset(name))


def from_nodata(value: Column, nodata: float = NODATA) -> Column:
    """NULL for the nodata value, NaN and NULL."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & ~(F.abs(v - nodata) <= 1e-4), v)


def is_custom_nodata(value: Column, nodata: float) -> Column:
    return F.abs(value - nodata) <= 1e-3 + 1e-5 * abs(nodata)


def to_nodata(value: Column, nodata: float = NODATA) -> Column:
    return F.coalesce(value, F.lit(nodata))


def luminance(bands: list[Column]) -> Column:
    """One band as it is, three by Rec. 601, others their mean."""
    if len(bands) == 1:
        return bands[0]
    if len(bands) == 3:
        return 0.299 * bands[0] + 0.587 * bands[1] + 0.114 * bands[2]
    return sum(bands[1:], bands[0]) / len(bands)


def rescale(value: Column, lo: Column, hi: Column, out_min: float = 0.0, out_max: float = 1.0) -> Column:
    flat = hi - lo < TINY
    return F.when(value.isNull(), None).when(flat, F.lit(float(out_min))).otherwise(out_min + (value - lo) / F.when(~flat, hi - lo) * (out_max - out_min))


def normalize_band(df: DataFrame, keys: list[str], value: str = "value", src_min: float | None = None, src_max: float | None = None, out_min: float = 0.0, out_max: float = 1.0, out: str = "normalized") -> DataFrame:
    if src_min is not None and src_max is not None:
        return df.withColumn(out, rescale(F.col(value), F.lit(float(src_min)), F.lit(float(src_max)), out_min, out_max))
    joined, own = with_stats(df, keys, lo=F.min(value), hi=F.max(value))
    lo = F.lit(float(src_min)) if src_min is not None else F.col(own["lo"])
    hi = F.lit(float(src_max)) if src_max is not None else F.col(own["hi"])
    return joined.withColumn(out, rescale(F.col(value), lo, hi, out_min, out_max)).drop(*own.values())


def zscore(value: Column, mean: Column, std: Column) -> Column:
    flat = std < TINY
    return F.when(value.isNull(), None).when(flat, F.lit(0.0)).otherwise((value - mean) / F.when(~flat, std))


def minmax_band(df: DataFrame, keys: list[str], value: str = "value", out: str = "minmax") -> DataFrame:
    """To [0, 1]; a constant band is 0.5. Adds also vmin and vmax, 0 where nothing is valid."""
    joined, own = with_stats(df, keys, lo=F.coalesce(F.min(value), F.lit(0.0)), hi=F.coalesce(F.max(value), F.lit(0.0)))
    lo, hi = F.col(own["lo"]), F.col(own["hi"])
    flat = hi - lo < TINY
    scaled = F.when(F.col(value).isNull(), None).when(flat, F.lit(0.5)).otherwise((F.col(value) - lo) / F.when(~flat, hi - lo))
    return joined.withColumns({"vmin": lo, "vmax": hi, out: scaled}).drop(*own.values())


def normalize_for_dl(df: DataFrame, method: str, keys: list[str], band: str = "band", value: str = "value", stats: DataFrame | None = None, nodata: float | None = None, out: str = "normalized") -> DataFrame:
    """``minmax``, ``zscore`` (by ``stats`` with band, mean and std, else the image's own), or a preset.
    A band without statistics raises when it is computed."""
    if nodata is not None:
        df = df.withColumn(value, F.when(~is_custom_nodata(F.col(value), nodata), F.col(value)))
    if method == "minmax":
        return minmax_band(df, [*keys, band], value, out).drop("vmin", "vmax")
    if method == "zscore" and stats is None:
        joined, own = with_stats(df, [*keys, band], mean=F.avg(value), std=F.stddev_pop(value))
        return joined.withColumn(out, zscore(F.col(value), F.col(own["mean"]), F.col(own["std"]))).drop(*own.values())
    if method != "zscore":
        preset = get_preset(method)  # at most a dozen rows
        stats = df.sparkSession.createDataFrame([(b, m, s) for b, (m, s) in preset.items()], "band string, mean double, std double")
    own, mean, std = fresh(df, "band", "mean", "std")
    known = stats.select(F.col("band").alias(own), F.col("mean").alias(mean), F.col("std").alias(std))
    joined = df.join(known, df[band] == F.col(own), "left")
    checked = F.when(F.col(own).isNull(), F.raise_error(F.concat(F.lit("no statistics for band "), F.coalesce(F.col(band), F.lit("null")))).cast("double")).otherwise(zscore(F.col(value), F.col(mean), F.col(std)))
    return joined.withColumn(out, checked).drop(own, mean, std)


def percentile_stretch(df: DataFrame, keys: list[str], value: str = "value", lo: float = 0.02, hi: float = 0.98, out: str = "stretched") -> DataFrame:
    """Linear between two exact percentiles of the finite values, clipped to [0, 1]; 0 if they are equal."""
    (p,) = fresh(df, "percentiles")
    known = exact_percentiles(df, keys, value, [lo, hi], p)
    empty = df.select(*keys).distinct().join(known, [df[k].eqNullSafe(known[k]) for k in keys], "left_anti") if keys else None
    if empty is not None:  # bands without a valid pixel keep their rows
        known = known.unionByName(empty.withColumn(p, F.array(F.lit(None).cast("double"), F.lit(None).cast("double"))))
    joined = with_group(df, known, keys, [p])
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - a) / F.when(b > a, b - a)))
    return joined.withColumn(out, F.when(F.col(value).isNull(), None).when(b > a, scaled).otherwise(F.lit(0.0))).select(*df.columns, out)


def to_byte(stretched: Column) -> Column:
    return (stretched * 255).cast("int")
