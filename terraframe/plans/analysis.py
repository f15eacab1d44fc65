"""The whole chain on a stack: gaps filled, then coverage, quantiles, trends and season of each pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import with_group
from ..operators import gapfill, stats, tiles, trends


def dense(pixels: DataFrame, keys: list[str], times: DataFrame, t: str = "t_idx", value: str = "value") -> DataFrame:
    """(keys, t, value) with a row for every time of the stack; NULL where a pixel has none. times: t, one row per scene."""
    cells = pixels.select(*keys).distinct().crossJoin(times.select(t))
    return cells.join(pixels.select(*keys, t, value), [*keys, t], "left")


def analyse(pixels: DataFrame, keys: list[str], times: DataFrame, method: str = "pchip", window: int = 5, t: str = "t_idx", day: str = "day", value: str = "value") -> DataFrame:
    """One row per pixel: n_valid before filling, the profile of the filled series (p10 to p90, slope, intercept, r2), Theil-Sen
    (ts_slope), Mann-Kendall (mk_z, mk_trend) and season (sos, pos, eos, peak_val).

    pixels: keys, t, value (NULL where missing); times: t and day, a row for each time of the stack. Everything is grouped by
    pixel, so that one exchange serves the chain."""
    series = tiles.to_series(dense(pixels, keys, times, t, value), keys, t, value)
    series = series.withColumn("n_valid", F.size(F.filter("values", lambda v: v.isNotNull())).cast("long"))
    filled = gapfill.interpolate_gaps(series, method, window)
    ordered = times.select(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(day).cast("double").alias("d")))).alias("axis"))  # one row
    placed = filled.crossJoin(F.broadcast(ordered)).select(*keys, "n_valid", F.explode(F.arrays_zip(F.col("filled").alias("v"), F.transform("axis", lambda x: x["d"]).alias("d"))).alias("z"))
    long = placed.select(*keys, "n_valid", F.col("z.d").alias("d"), F.col("z.v").alias("v"))
    out = long.groupBy(*keys).agg(F.max("n_valid").alias("n_valid"))
    for part in (
        stats.pixel_profile(long, keys, "d", "v").drop("count", "fraction"),
        trends.theil_sen(long, keys, "d", "v").select(*keys, F.col("slope").alias("ts_slope")),
        trends.mann_kendall(long, keys, "d", "v").select(*keys, F.col("Z").alias("mk_z"), F.col("trend").alias("mk_trend")),
        trends.phenology(long, keys, "d", "v"),
    ):
        out = with_group(out, part, keys, [c for c in part.columns if c not in keys])
    return out
