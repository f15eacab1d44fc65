"""Band groups, technical layers and locations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Groups of band names. Joining groups keeps duplicates.
RGB = ("blue", "green", "red")
RGB_NIR = (*RGB, "nir")
VEGETATION = ("red", "nir", "rededge1", "rededge2", "rededge3")
AGRICULTURE = ("blue", "green", "red", "nir", "rededge1", "swir16", "swir22")
ALL_10M = RGB_NIR
ALL_20M = ("rededge1", "rededge2", "rededge3", "nir08", "swir16", "swir22")
ALL = ALL_10M + ALL_20M
COASTAL_AEROSOL, WATER_VAPOUR = ("coastal",), ("nir09",)
TECHNICAL = ("scl", "aot", "wvp")
VISUAL = ("visual", "thumbnail")


@dataclass(frozen=True)
class Location:
    lon: float
    lat: float
    name: str | None = None


def timestamp_from_path(path: Column, modified: Column | None = None) -> Column:
    """The time in a file's name (``20240131T101112``), else when it was last written."""
    t = F.try_to_timestamp(F.regexp_extract(path, "([0-9]{8}T[0-9]{6})", 1), F.lit("yyyyMMdd'T'HHmmss"))
    return F.coalesce(t, modified) if modified is not None else t


def base_name(name: Column, ts: Column, lat: Column, lon: Column) -> Column:
    """``<name>_<time>``, or date and place."""
    return F.when(name.isNotNull(), F.concat_ws("_", name, F.date_format(ts, "yyyyMMdd'T'HHmmss"))).otherwise(F.concat_ws("_", F.date_format(ts, "yyyy-MM-dd"), F.format_string("%.4f", lat), F.format_string("%.4f", lon)))
