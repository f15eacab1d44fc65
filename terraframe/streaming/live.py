"""The same operators on streams of scenes and events."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.stats import dataset_stats
from ..plans.stack import StackConfig, stack_timeseries


def running_stats(pixels: DataFrame, band: str = "band", value: str = "value") -> DataFrame:
    """Statistics of each band over all that came so far; for output mode ``complete`` or ``update``."""
    return dataset_stats(pixels, band, value)


def windowed_stats(pixels: DataFrame, ts: str = "ts", every: str = "1 day", late: str = "2 days", band: str = "band", value: str = "value") -> DataFrame:
    """By window of time and band; windows close when the watermark passes them."""
    w = pixels.withWatermark(ts, late).groupBy(F.window(ts, every), band)
    return w.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def activity(events: DataFrame, keys: list[str], ts: str = "ts", gap: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sessions of each key that gaps separate."""
    s = events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_accepted(scenes: DataFrame, pixels: DataFrame, path: str, cfg: StackConfig = StackConfig(), scl: DataFrame | None = None) -> DataStreamWriter:
    """Gate each batch of new scenes and append the pixels of those accepted; a batch that is repeated replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        # A batch may hold no scene that passes.
        stack = stack_timeseries(batch, pixels.join(batch.select("scene_id"), "scene_id", "left_semi"), replace(cfg, require_accepted=False, align=cfg.align and cfg.reference is not None), scl=scl)
        stack.pixels.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scenes.writeStream.foreachBatch(one)
