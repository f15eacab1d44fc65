"""Stacking scenes over time behind their quality gates."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import grids, quality
from ..sources.store import canonical


@dataclass(frozen=True)
class StackConfig:
    """Limits of the gate, and what is made of the scenes.

    align brings scenes of another shape to the grid of the reference: a scene by its id, or the earliest. nodata is the
    value of rejected scenes' planes, NULL by default. With save_dir the stack is written there, by band or by ts.
    Without require_accepted a stack of no scene is empty instead of an error."""

    max_cloud: float = 0.30
    min_confidence: float = 0.01
    max_snow: float = 1.0
    require_bands: tuple[str, ...] = ()
    use_sidecars: bool = True
    run_radiometry_check: bool = True
    fill_rejected: bool = False
    nodata: float | None = None
    align: bool = True
    reference: object | None = None
    save_dir: str | None = None
    save_by: str = "band"
    require_accepted: bool = True


class Stack(NamedTuple):
    pixels: DataFrame  # scene_id, ts, t_idx, band, row, col, value
    scenes: DataFrame  # with report_source, reject_reason, accepted

    def counts(self) -> DataFrame:
        return self.scenes.agg(F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_rejected"))

    def summary(self) -> DataFrame:
        return self.scenes.select(F.format_string("%s  %s  %s", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("accepted"), "accepted").otherwise("rejected"), F.col("reject_reason")).alias("line")).orderBy("line")

    def save(self, path: str, by: str = "band") -> None:
        if by not in ("band", "ts"):
            raise ValueError("a stack is saved by band or by ts")
        self.pixels.write.mode("overwrite").partitionBy(by).parquet(f"{path}/pixels")
        self.scenes.write.mode("overwrite").json(f"{path}/scenes")


GRID = ("n_rows", "n_cols", "x0", "y0", "dx", "dy")


def _reference(scenes: DataFrame, cfg: StackConfig):
    """The reference scene's row: of an id, or the earliest."""
    own = scenes.where(F.col("scene_id") == F.lit(cfg.reference)) if cfg.reference is not None else scenes
    row = own.orderBy("ts", "scene_id").select(*[c for c in GRID if c in scenes.columns]).first()
    if row is None:
        raise ValueError("there is no reference scene")
    return row


def _aligned(scenes: DataFrame, pixels: DataFrame, cfg: StackConfig) -> tuple[DataFrame, DataFrame]:
    """Scenes by their shapes in the stack, and pixels on the reference grid; only scenes that say their grid can be aligned."""
    if not cfg.align or not {"n_rows", "n_cols"} <= set(scenes.columns):
        return scenes, pixels
    ref = _reference(scenes, cfg)
    if not set(GRID) <= set(scenes.columns):
        return scenes, pixels
    known = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("dx").isNotNull() & F.col("dy").isNotNull()
    grid, shape = (ref["x0"], ref["y0"], ref["dx"], ref["dy"]), (ref["n_rows"], ref["n_cols"])
    if None in grid:
        return scenes, pixels
    # A scene that does not say its grid keeps its own shape.
    plain = lambda c, k: F.when(known, F.lit(shape[k])).otherwise(F.col(c))
    placed = scenes.select("scene_id", *[F.when(known, F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in zip(GRID, (*shape, *grid))])
    return scenes.withColumns({"n_rows": plain("n_rows", 0), "n_cols": plain("n_cols", 1)}), grids.align_scenes(pixels, placed, grid, shape)


def _checked(accepted: DataFrame) -> None:
    """accepted: the accepted scenes. Raises if there are none, or if their shapes differ."""
    shapes = [c for c in ("n_rows", "n_cols") if c in accepted.columns]
    row = accepted.agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set(F.struct(*shapes))) if shapes else F.array(F.lit(0)), 1, 10).alias("shapes")).first()
    if not row["n"]:
        raise ValueError("no scene passed the quality gate; relax its limits or look at the reports")
    if len(row["shapes"]) > 1:
        raise ValueError(f"accepted scenes have inconsistent shapes: {[tuple(x) for x in row['shapes']]}; align them or name a reference")


def stack_timeseries(scenes: DataFrame, pixels: DataFrame, cfg: StackConfig = StackConfig(), sidecars: DataFrame | None = None, scl: DataFrame | None = None, unreadable: DataFrame | None = None) -> Stack:
    """scenes: scene_id, ts, n_rows, n_cols and, to be aligned, x0, y0, dx, dy; pixels: scene_id, band, row, col, value;
    sidecars: scene_id and report columns; scl: scene_id, scl; unreadable: scene_id of class layers that can't be read.
    The gate joins small tables first; pixels are then cut to accepted scenes."""
    empty = scenes.select("scene_id").limit(0)
    computed = quality.stack_metrics(scenes, scl, cfg.max_cloud, unreadable) if scl is not None else empty
    if scl is not None and not cfg.run_radiometry_check:
        computed = computed.withColumn("radiometry_pass", F.lit(True))
    known = quality.with_reports(scenes, sidecars if cfg.use_sidecars and sidecars is not None else empty, computed)
    reason = quality.reject_reason(F.col("dimension_pass"), F.col("radiometry_pass"), F.col("cloud_ratio"), F.col("snow_ratio"), F.col("confidence_score"), cfg.max_cloud, cfg.max_snow, cfg.min_confidence)
    gated = known.withColumn("reject_reason", reason)
    pixels = canonical(pixels)
    if cfg.require_bands:
        lacks = quality.missing_required(pixels, ["scene_id"], list(cfg.require_bands))
        listed = F.concat(F.lit("missing bands: ['"), F.array_join("missing", "', '"), F.lit("']"))
        gated = gated.join(lacks, "scene_id", "left").withColumn("reject_reason", F.when((F.col("reject_reason") == "") & (F.size("missing") > 0), listed).otherwise(F.col("reject_reason"))).drop("missing")
    gated = gated.withColumn("accepted", F.col("reject_reason") == "")
    shaped, pixels = _aligned(gated, pixels, cfg)
    if cfg.require_accepted:
        _checked(shaped.where("accepted"))
    own = gated.where("accepted OR " + str(cfg.fill_rejected).lower())
    times = own.select("scene_id", "ts", "accepted", (F.dense_rank().over(W.orderBy("ts", "scene_id")) - 1).alias("t_idx"))  # one row per scene
    out = pixels.join(times.where("accepted"), "scene_id").select("scene_id", "ts", "t_idx", "band", "row", "col", "value")
    if cfg.fill_rejected:
        # Every cell of the stack once for each rejected scene: as many rows as the planes that are asked for.
        cells = out.select("band", "row", "col").distinct()
        gone = times.where("NOT accepted").select("scene_id", "ts", "t_idx")
        out = out.unionByName(cells.crossJoin(gone).select("scene_id", "ts", "t_idx", "band", "row", "col", F.lit(cfg.nodata).cast("double").alias("value")))
    stack = Stack(out, gated)
    if cfg.save_dir is not None:
        stack.save(cfg.save_dir, cfg.save_by)
    return stack
