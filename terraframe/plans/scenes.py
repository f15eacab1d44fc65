"""From catalogue items to scenes: the gate at download time, alignment of bands, sharpening, and what is written.

All scenes are one plan; what goes wrong with one of them is a row, not an exception.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grids, quality
from ..sources import store


def download_gate(items: DataFrame, scl: DataFrame, threshold: float = 0.30, min_confidence: float = 0.01, key: str = "item_id") -> DataFrame:
    """One report per item. items: key, has_scl, shape_rows and shape_cols (of the catalogue, or NULL), scl_error (why the
    layer can't be read, or NULL); scl: key, row, col, scl of the clipped layers.

    In this order: without a layer an item passes with a warning; a shape in the catalogue that fails rejects it before
    anything is read; a layer that can't be read passes with its error; clipped layers are judged by their dimensions, then
    by their confidence. Classes tell nothing of radiometry, which passes."""
    clipped = scl.groupBy(key).agg((F.max("row") - F.min("row") + 1).alias("clip_rows"), (F.max("col") - F.min("col") + 1).alias("clip_cols"))
    found = quality.validate_scl(scl, [key], threshold=threshold).withColumnRenamed("issues", "scl_issues")
    j = items.select(key, "has_scl", "shape_rows", "shape_cols", "scl_error").join(clipped, key, "left").join(found, key, "left")
    c = F.col
    early = quality.dimension_issues(c("shape_rows"), c("shape_cols"))
    late = quality.dimension_issues(F.coalesce("clip_rows", F.lit(0)), F.coalesce("clip_cols", F.lit(0)))
    state = (
        F.when(~c("has_scl"), "none").when(c("shape_rows").isNotNull() & c("shape_cols").isNotNull() & (F.size(early) > 0), "early")
        .when(c("scl_error").isNotNull(), "error").when(F.size(late) > 0, "late").otherwise("read")
    )
    j = j.withColumn("state", state)
    of = lambda **by: F.coalesce(*[F.when(c("state") == s, e) for s, e in by.items()])
    read = lambda name: of(read=c(name)).alias(name)
    passes = F.coalesce(c("confidence_score"), F.lit(0.0)) >= min_confidence
    return j.select(
        key, F.when(c("state").isin("none", "error"), True).when(c("state") == "read", passes).otherwise(False).alias("passed"),
        of(none=F.lit(quality.NO_CLASSES)).alias("warning"), of(error=c("scl_error")).alias("error"),
        of(early=c("shape_rows"), late=F.coalesce("clip_rows", F.lit(0)), read=c("clip_rows")).alias("rows"), of(early=c("shape_cols"), late=F.coalesce("clip_cols", F.lit(0)), read=c("clip_cols")).alias("cols"),
        of(early=F.lit(False), late=F.lit(False), read=F.lit(True)).alias("dimension_pass"), of(early=early, late=late, read=c("scl_issues")).alias("issues"),
        read("confidence_score"), read("cloud_ratio"), read("snow_ratio"), read("water_excluded"), of(read=F.lit(True)).alias("radiometry_pass"),
    )


def align_bands(pixels: DataFrame, grids_of: DataFrame, band_order: list[str], key: str = "item_id") -> DataFrame:
    """Bands of a scene on the grid of its first band, in ``band_order``, by nearest neighbours. pixels: key, band, row, col,
    value; grids_of: key, band, n_rows, n_cols, x0, y0, dx, dy. A band without a grid stays as it is."""
    order = F.array_position(F.array(*map(F.lit, band_order)), F.col("band"))
    ref = grids_of.where(F.col("band").isin(*band_order)).groupBy(key).agg(F.min_by(F.struct("band", "n_rows", "n_cols", "x0", "y0", "dx", "dy"), order).alias("ref"))
    own = grids_of.select(key, "band", F.struct("n_rows", "n_cols", "x0", "y0", "dx", "dy").alias("own")).join(ref, key)
    joined = pixels.join(own, [key, "band"], "left")
    g, r = (lambda c: F.col(f"own.{c}")), (lambda c: F.col(f"ref.{c}"))
    stays = F.col("own").isNull() | (F.col("band") == r("band"))
    rows = F.when(stays, F.array("row")).otherwise(grids.nearest_cells(F.col("row"), r("y0"), r("dy"), g("y0"), g("dy"), g("n_rows"), r("n_rows")))
    cols = F.when(stays, F.array("col")).otherwise(grids.nearest_cells(F.col("col"), r("x0"), r("dx"), g("x0"), g("dx"), g("n_cols"), r("n_cols")))
    return grids.spread(joined, [key, "band"], rows, cols)


def sharpen_step(pixels: DataFrame, pan: DataFrame, bands: list[str], ms_shape: tuple[int, int], pan_shape: tuple[int, int], method: str = "gram_schmidt", key: str = "item_id") -> DataFrame:
    """Pixels (key, band, row, col, value), sharpened where their scene has PAN pixels (key, row, col, value) and the method can
    be applied; all others as they are."""
    known = pan.select(key).distinct()
    plain = pixels.join(known, key, "left_anti").select(key, "band", "row", "col", "value")
    try:
        up = grids.bilinear_upsample(pixels.join(known, key, "left_semi"), [key, "band"], ms_shape, pan_shape)
        wide = store.wide(up, [key, "row", "col"], bands).join(pan.select(key, "row", "col", F.col("value").alias("pan")), [key, "row", "col"])
        sharp = grids.pansharpen(wide, [key], bands, method, pan_shape)
    except ValueError:  # the method asks for other bands or sizes
        return pixels.select(key, "band", "row", "col", "value")
    long = sharp.unpivot([key, "row", "col"], bands, "band", "value").select(key, "band", "row", "col", "value")
    return plain.unionByName(long)


@dataclass(frozen=True)
class SceneConfig:
    bands: tuple[str, ...] = ("B02", "B03", "B04", "B08")
    validate: bool = True
    max_cloud: float = 0.30
    min_confidence: float = 0.01
    sharpen: str | None = None
    ms_shape: tuple[int, int] | None = None
    pan_shape: tuple[int, int] | None = None


class Scenes(NamedTuple):
    spectral: DataFrame  # item_id, band, row, col, value
    technical: DataFrame  # item_id, row, col, scl
    reports: DataFrame  # one row per item: the gate's report, missing bands, written

    def write(self, path: str, mode: str = "errorifexists") -> None:
        self.spectral.write.mode(mode).partitionBy("band").parquet(f"{path}/spectral")
        self.technical.write.mode(mode).parquet(f"{path}/technical")
        self.reports.write.mode(mode).json(f"{path}/reports")


def materialise_scenes(items: DataFrame, pixels: DataFrame, grids_of: DataFrame, scl: DataFrame, cfg: SceneConfig = SceneConfig(), pan: DataFrame | None = None) -> Scenes:
    """Gate items, bring the bands of those that pass to one grid, sharpen, and give what is to be written. Items that are
    rejected, or have none of the bands, have their report only. pixels: item_id, band, row, col, value."""
    own = store.canonical(pixels).where(F.col("band").isin(*cfg.bands))
    if cfg.validate:
        reports = download_gate(items, scl, cfg.max_cloud, cfg.min_confidence)
    else:
        reports = items.select("item_id", F.lit(True).alias("passed"))
    lacks = quality.missing_required(own, ["item_id"], list(cfg.bands))
    reports = reports.join(lacks, "item_id", "left").withColumn("missing", F.coalesce("missing", F.array(*map(F.lit, cfg.bands))))
    reports = reports.withColumn("written", F.col("passed") & (F.size("missing") < len(cfg.bands)))
    good = reports.where("written").select("item_id")
    spectral = align_bands(own.join(good, "item_id", "left_semi"), store.canonical(grids_of), list(cfg.bands))
    if cfg.sharpen is not None and pan is not None and cfg.ms_shape and cfg.pan_shape:
        spectral = sharpen_step(spectral, pan.join(good, "item_id", "left_semi"), list(cfg.bands), cfg.ms_shape, cfg.pan_shape, cfg.sharpen)
    return Scenes(spectral, scl.join(good, "item_id", "left_semi").select("item_id", "row", "col", "scl"), reports)
