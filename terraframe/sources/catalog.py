"""Searching a catalogue of scenes, kept as a table: (item_id, ts, min_lon, min_lat, max_lon, max_lat, ...)."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import bands
from .bands import Location


@dataclass(frozen=True)
class SearchConfig:
    """Range of time, box and limits of a search, and what to fetch."""

    start: datetime | None = None
    end: datetime | None = None
    look_back_days: int = 30
    half: float = 0.05
    max_items: int = 50
    keep_items: int = 10
    max_cloud: float = 0.30
    min_confidence: float = 0.01
    band_keys: tuple[str, ...] = field(default=bands.RGB_NIR)
    tech_keys: tuple[str, ...] = ("scl",)

    def resolved_end(self) -> datetime:
        return self.end or datetime.now()

    def resolved_start(self) -> datetime:
        return self.start or self.resolved_end() - timedelta(days=self.look_back_days)


def top_scenes(items: DataFrame, keys: list[str], k: int, ts: str = "ts", tie: str = "item_id") -> DataFrame:
    """The latest k of each location; missing times last."""
    order = W.partitionBy(*keys).orderBy(F.desc_nulls_last(ts), tie)
    return items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(catalog: DataFrame, locations: list[Location], cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Items whose box meets a location's and whose time is in range: the latest ``max_items`` found, of these
    ``keep_items``. Locations are given by the caller, a few literals, so each is one pushed-down filter. Edges count as
    met: bounds are sums of the decimals as they are written, and exact against decimal columns."""
    found, written = None, lambda x: Decimal(str(x))
    zoneless = dict(catalog.dtypes)["ts"] == "timestamp_ntz"
    at = lambda t: F.lit(t.isoformat(" ")).cast("timestamp_ntz") if zoneless and t.tzinfo is None else F.lit(t)
    for k, place in enumerate(locations):
        lon, lat, half = written(place.lon), written(place.lat), written(cfg.half)
        near = (F.col("max_lon") >= F.lit(lon - half)) & (F.col("min_lon") <= F.lit(lon + half)) & (F.col("max_lat") >= F.lit(lat - half)) & (F.col("min_lat") <= F.lit(lat + half))
        part = catalog.where(near & F.col("ts").between(at(cfg.resolved_start()), at(cfg.resolved_end()))).withColumns({"location_id": F.lit(k), "location": F.lit(place.name), "lon": F.lit(place.lon), "lat": F.lit(place.lat)})
        found = part if found is None else found.unionByName(part)
    return top_scenes(found, ["location_id"], min(cfg.max_items, cfg.keep_items)).drop("rank")
