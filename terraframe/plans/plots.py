"""The data behind each figure; drawing is left to the caller."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scaling import percentile_stretch, to_byte
from ..operators import quality


def band_frame(pixels: DataFrame, band: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """A band's pixels stretched between its 2nd and 98th percentiles."""
    own = pixels.where(F.col("band") == band) if band is not None else pixels
    return percentile_stretch(own, keys or ["band"])


def rgb_frame(pixels: DataFrame, red: str, green: str, blue: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, row, col, r, g, b) as bytes."""
    keys = keys or []
    own = percentile_stretch(pixels.where(F.col("band").isin(red, green, blue)), [*keys, "band"])
    of = lambda b: F.max(F.when(F.col("band") == b, to_byte(F.col("stretched"))))
    return own.groupBy(*keys, "row", "col").agg(of(red).alias("r"), of(green).alias("g"), of(blue).alias("b"))


def grid_frame(panels: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Panels (title, pixels, band) one below another, with panel_id."""
    if not panels:
        raise ValueError("no panels")
    parts = [band_frame(p, b).withColumns({"panel_id": F.lit(k), "title": F.lit(t)}) for k, (t, p, b) in enumerate(panels)]
    return reduce(DataFrame.unionByName, parts)


def mask_frame(scl: DataFrame, bad=quality.BAD_CLASSES) -> DataFrame:
    return scl.withColumn("bad", quality.scl_mask(F.col("scl"), bad))


def timeseries_frame(pixels: DataFrame, lon: float, lat: float, bands: list[str] | None = None, scl: DataFrame | None = None, half: float | None = None, epsg: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """(ts, band, value, cloudy) at a point, or as the mean of a box. Class layers are found by their time; a time without one
    is not cloudy. Without ``scl`` cloudy is NULL. keys tell places apart that share times."""
    keys = keys or []
    own = pixels.where(F.col("band").isin(*bands)) if bands else pixels
    value = quality.nearest_pixel(own, [*keys, "ts", "band"], lon, lat, epsg=epsg) if half is None else quality.bbox_mean(own, [*keys, "ts", "band"], lon, lat, half)
    if scl is None:
        return value.withColumn("cloudy", F.lit(None).cast("boolean"))
    cloudy = quality.nearest_pixel(scl, [*keys, "ts"], lon, lat, "scl", epsg=epsg).select(*keys, "ts", quality.scl_mask(F.col("value")).alias("cloudy"))
    return value.join(cloudy, [*keys, "ts"], "left").withColumn("cloudy", F.coalesce("cloudy", F.lit(False)))
