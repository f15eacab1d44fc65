"""Resampling, sharpening, and cutting into overlapping tiles, on (keys, row, col, value).

Resampling goes from source pixels to the destination cells that they fill, which are a short range by row and by
column; nothing is joined, and nearest neighbours exchange nothing. Cells whose source pixel has no row have none.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.frames import fresh, with_stats


def nearest_index(i: Column, origin_d: Column, size_d: Column, origin_s: Column, size_s: Column, n: Column) -> Column:
    """The 0-based source index nearest to cell ``i`` of a destination axis; halves go away from zero, ends are clamped."""
    return F.greatest(F.lit(0), F.least(n - 1, F.round((origin_d + i * size_d - origin_s) / size_s).cast("int")))


def ratio_index(i: Column, n_src: Column, n_dst: Column) -> Column:
    """The source index in proportion, truncated."""
    return F.least(n_src - 1, (i * n_src / n_dst).cast("int"))


def _cells(at: Column, lo: Column, hi: Column, n_dst: Column, index) -> Column:
    """The destination indices, between two bounds that are generous, whose source index is ``at``."""
    bound = lambda x: F.greatest(F.lit(0), F.least(n_dst - 1, x.cast("int")))
    return F.filter(F.sequence(bound(lo), bound(hi)), lambda i: index(i) == at)


def nearest_cells(at: Column, origin_d: Column, size_d: Column, origin_s: Column, size_s: Column, n_src: Column, n_dst: Column) -> Column:
    """The cells of a destination axis whose nearest source index is ``at``; those at the ends also take what lies beyond."""
    edge = lambda half: ((at + half) * size_s + origin_s - origin_d) / size_d
    lo, hi = F.least(edge(-0.5), edge(0.5)), F.greatest(edge(-0.5), edge(0.5))
    outer = (at <= 0) | (at >= n_src - 1)
    lo, hi = F.when(outer, F.lit(0)).otherwise(F.floor(lo) - 1), F.when(outer, n_dst - 1).otherwise(F.ceil(hi) + 1)
    return _cells(at, lo, hi, n_dst, lambda i: nearest_index(i, origin_d, size_d, origin_s, size_s, n_src))


def ratio_cells(at: Column, n_src: Column, n_dst: Column) -> Column:
    return _cells(at, F.floor(at * n_dst / n_src) - 1, F.ceil((at + 1) * n_dst / n_src) + 1, n_dst, lambda i: ratio_index(i, n_src, n_dst))


def spread(df: DataFrame, keys: list[str], rows: Column, cols: Column, value: str = "value") -> DataFrame:
    """Each source pixel at all destination rows and columns that two arrays name."""
    r, c = fresh(df, "r", "c")
    out = df.withColumn(r, F.explode(rows)).withColumn(c, F.explode(cols))
    return out.select(*keys, F.col(r).alias("row"), F.col(c).alias("col"), value)


def reproject_nearest(df: DataFrame, keys: list[str], src: tuple[float, float, float, float], src_shape: tuple[int, int], dst: tuple[float, float, float, float], dst_shape: tuple[int, int], value: str = "value") -> DataFrame:
    """Between two affine grids (origin x, origin y, pixel width, pixel height)."""
    lit = F.lit
    r = nearest_cells(F.col("row"), lit(dst[1]), lit(dst[3]), lit(src[1]), lit(src[3]), lit(src_shape[0]), lit(dst_shape[0]))
    c = nearest_cells(F.col("col"), lit(dst[0]), lit(dst[2]), lit(src[0]), lit(src[2]), lit(src_shape[1]), lit(dst_shape[1]))
    return spread(df, keys, r, c, value)


def resample_nearest(df: DataFrame, keys: list[str], src_shape: tuple[int, int], dst_shape: tuple[int, int], value: str = "value") -> DataFrame:
    r, c = (ratio_cells(F.col(x), F.lit(s), F.lit(d)) for x, s, d in zip(("row", "col"), src_shape, dst_shape))
    return spread(df, keys, r, c, value)


def align(df: DataFrame, keys: list[str], src, src_shape, ref, ref_shape, value: str = "value", strict: bool = False) -> DataFrame:
    """To a reference grid; images of its shape stay as they are, unless ``strict`` and their grid differs."""
    if tuple(src_shape) == tuple(ref_shape) and not (strict and tuple(src) != tuple(ref)):
        return df
    return reproject_nearest(df, keys, src, src_shape, ref, ref_shape, value)


def align_scenes(pixels: DataFrame, scenes: DataFrame, ref: tuple[float, float, float, float], ref_shape: tuple[int, int], key: str = "scene_id", value: str = "value") -> DataFrame:
    """Pixels of scenes with grids of their own on one reference grid. scenes: key, n_rows, n_cols and the grid x0, y0, dx,
    dy. A scene of the reference's shape stays as it is, even if its grid differs."""
    own = scenes.select(key, *[F.col(c).alias(f"scene_{c}") for c in ("n_rows", "n_cols", "x0", "y0", "dx", "dy")])
    joined = pixels.join(own, key)
    lit, g = F.lit, lambda c: F.col(f"scene_{c}")
    same = (g("n_rows") == ref_shape[0]) & (g("n_cols") == ref_shape[1])
    r = F.when(same, F.array("row")).otherwise(nearest_cells(F.col("row"), lit(ref[1]), lit(ref[3]), g("y0"), g("dy"), g("n_rows"), lit(ref_shape[0])))
    c = F.when(same, F.array("col")).otherwise(nearest_cells(F.col("col"), lit(ref[0]), lit(ref[2]), g("x0"), g("dx"), g("n_cols"), lit(ref_shape[1])))
    keys = [x for x in pixels.columns if x not in ("row", "col", value)]
    return spread(joined, keys, r, c, value).select(*pixels.columns)


def bilinear_upsample(df: DataFrame, keys: list[str], src_shape: tuple[int, int], dst_shape: tuple[int, int], value: str = "value") -> DataFrame:
    """Corners aligned. Each source pixel goes, with its weight, to the destination cells that it is a neighbour of; missing
    neighbours are left out."""

    def reached(x: str, s: int, d: int) -> Column:
        at, step = F.col(x), max(d - 1, 1) / max(s - 1, 1)
        cells = F.sequence(F.greatest(F.lit(0), (F.floor((at - 1) * step) - 1).cast("int")), F.least(F.lit(d - 1), (F.ceil((at + 1) * step) + 1).cast("int"))) if s > 1 else F.sequence(F.lit(0), F.lit(d - 1))

        def weigh(i: Column) -> Column:
            y = i * ((s - 1) / max(d - 1, 1))
            low, part = F.floor(y).cast("int"), y - F.floor(y)
            return F.struct(i.alias("at"), (F.when(low == at, 1 - part).otherwise(0.0) + F.when(F.least(low + 1, F.lit(s - 1)) == at, part).otherwise(0.0)).alias("w"))

        return F.filter(F.transform(cells, weigh), lambda c: c["w"] > 0)

    a, b = fresh(df, "a", "b")
    out = df.withColumn(a, F.explode(reached("row", src_shape[0], dst_shape[0]))).withColumn(b, F.explode(reached("col", src_shape[1], dst_shape[1])))
    placed = out.select(*keys, F.col(f"{a}.at").alias("row"), F.col(f"{b}.at").alias("col"), (F.col(f"{a}.w") * F.col(f"{b}.w") * F.col(value)).alias(value))
    return placed.groupBy(*keys, "row", "col").agg(F.sum(value).alias(value))


def _sharpening(df: DataFrame, keys: list[str], bands: list[str], pan: str, **more: Column) -> tuple[DataFrame, dict[str, str], str, Column]:
    """The rows with their image's sums, from one aggregate; the mean of the bands; and what PAN, brought to its mean and
    deviation, has more than it."""
    (syn,) = fresh(df, "syn")
    df = df.withColumn(syn, sum((F.col(b) for b in bands[1:]), F.col(bands[0])) / len(bands))
    std = lambda c: F.sqrt(F.var_pop(c) + 1e-12)
    joined, own = with_stats(df, keys, pan_mean=F.avg(pan), pan_std=std(pan), syn_mean=F.avg(syn), syn_std=std(syn), power=F.sum(F.col(syn) * F.col(syn)) + 1e-12, **{k: F.sum(c * F.col(syn)) for k, c in more.items()})
    matched = (F.col(pan) - F.col(own["pan_mean"])) / F.col(own["pan_std"]) * F.col(own["syn_std"]) + F.col(own["syn_mean"])
    return joined, own, syn, matched - F.col(syn)


def sharpen_gram_schmidt(df: DataFrame, keys: list[str], bands: list[str], pan: str = "pan") -> DataFrame:
    """Bands, at the size of PAN, with what PAN has more than their mean, by each band's share in it."""
    joined, own, _, extra = _sharpening(df, keys, bands, pan, **{f"dot_{k}": F.col(b) for k, b in enumerate(bands)})
    return joined.select(*keys, "row", "col", *[(F.col(b) + F.col(own[f"dot_{k}"]) / F.col(own["power"]) * extra).alias(b) for k, b in enumerate(bands)])


def sharpen_ihs(df: DataFrame, keys: list[str], bands: list[str], pan: str = "pan") -> DataFrame:
    if len(bands) != 3:
        raise ValueError("IHS needs three bands")
    joined, _, _, extra = _sharpening(df, keys, bands, pan)
    return joined.select(*keys, "row", "col", *[(F.col(b) + extra).alias(b) for b in bands])


def sharpen_wavelet(df: DataFrame, keys: list[str], bands: list[str], shape: tuple[int, int], pan: str = "pan") -> DataFrame:
    """Means of 2 x 2 blocks from PAN, details from the bands. Odd sizes have no such blocks and raise."""
    if shape[0] % 2 or shape[1] % 2:
        raise ValueError("wavelet sharpening needs even sizes")
    w = W.partitionBy(*keys, F.floor(F.col("row") / 2), F.floor(F.col("col") / 2))
    return df.select(*keys, "row", "col", *[(F.col(b) + F.avg(pan).over(w) - F.avg(b).over(w)).alias(b) for b in bands])


def pansharpen(df: DataFrame, keys: list[str], bands: list[str], method: str = "gram_schmidt", shape: tuple[int, int] | None = None, pan: str = "pan") -> DataFrame:
    if method == "gram_schmidt":
        return sharpen_gram_schmidt(df, keys, bands, pan)
    if method == "ihs":
        return sharpen_ihs(df, keys, bands, pan)
    if method == "wavelet" and shape is not None:
        return sharpen_wavelet(df, keys, bands, shape, pan)
    raise ValueError(f"unknown method {method!r}, or no shape for wavelet; known: gram_schmidt, ihs, wavelet")


def centre_crop(df: DataFrame, rows: int, cols: int, size: int = 64) -> DataFrame:
    """The middle ``size`` x ``size`` pixels, with row and col from 0 again; a smaller side stays whole."""
    r, c = max(0, (rows - size) // 2), max(0, (cols - size) // 2)
    own = df.where(F.col("row").between(r, r + min(size, rows) - 1) & F.col("col").between(c, c + min(size, cols) - 1))
    return own.withColumns({"row": F.col("row") - r, "col": F.col("col") - c})


class TileMeta(NamedTuple):
    rows: int
    cols: int
    tile_size: int
    overlap: int
    stride: int
    grid_rows: int
    grid_cols: int


def _steps(n: int, tile: int, stride: int) -> int:
    return 1 if n <= tile else math.ceil((n - tile) / stride) + 1


def tile_meta(rows: int, cols: int, tile_size: int = 256, overlap: int = 32) -> TileMeta:
    if tile_size <= 0 or overlap < 0 or tile_size <= 2 * overlap:
        raise ValueError("tile_size must be positive and more than twice the overlap")
    stride = tile_size - overlap
    return TileMeta(rows, cols, tile_size, overlap, stride, _steps(rows, tile_size, stride), _steps(cols, tile_size, stride))


def tile_grid_shape(rows: int, cols: int, tile_size: int = 256, overlap: int = 32) -> tuple[int, int, int]:
    m = tile_meta(rows, cols, tile_size, overlap)
    return m.grid_rows * m.grid_cols, m.grid_rows, m.grid_cols


def tile_grid_columns(rows: Column, cols: Column, tile_size: int = 256, overlap: int = 32) -> Column:
    """``tile_grid_shape`` of images whose sizes are columns: a struct of n, grid_rows and grid_cols."""
    stride = tile_meta(1, 1, tile_size, overlap).stride
    steps = lambda n: F.when(n <= tile_size, 1).otherwise(F.ceil((n - tile_size) / stride) + 1).cast("int")
    return F.struct((steps(rows) * steps(cols)).alias("n"), steps(rows).alias("grid_rows"), steps(cols).alias("grid_cols"))


def _places(at: Column, n: int, count: int, m: TileMeta) -> Column:
    """Every (tile, position in it) where one source row or column stands: itself, and its reflections in the padding at the end."""
    padded = (count - 1) * m.stride + m.tile_size
    period = max(1, 2 * (n - 1))
    seen = F.filter(F.concat(F.sequence(at, F.lit(padded + period), F.lit(period)), F.sequence(F.lit(period) - at, F.lit(padded + 2 * period), F.lit(period))), lambda p: p < padded)
    tiles = lambda p: F.transform(F.filter(F.sequence(F.greatest(F.lit(0), F.ceil((p - m.tile_size + 1) / m.stride).cast("int")), F.least(F.lit(count - 1), F.floor(p / m.stride).cast("int"))), lambda k: k * m.stride <= p), lambda k: F.struct(k.alias("tile"), (p - k * m.stride).alias("at")))
    return F.explode(F.flatten(F.transform(F.array_distinct(seen), tiles)))


def extract_tiles(df: DataFrame, keys: list[str], rows: int, cols: int, tile_size: int = 256, overlap: int = 32, value: str = "value") -> tuple[DataFrame, TileMeta]:
    """(keys, tile_id, tile_r, tile_c, row, col, value), tiles in row-major order, the padding at bottom and right reflected."""
    m = tile_meta(rows, cols, tile_size, overlap)
    a, b = fresh(df, "a", "b")
    out = df.withColumn(a, _places(F.col("row"), rows, m.grid_rows, m)).withColumn(b, _places(F.col("col"), cols, m.grid_cols, m))
    r, c = F.col(f"{a}.tile"), F.col(f"{b}.tile")
    return out.select(*keys, (r * m.grid_cols + c).alias("tile_id"), r.alias("tile_r"), c.alias("tile_c"), F.col(f"{a}.at").alias("row"), F.col(f"{b}.at").alias("col"), value), m


def _fade(at: Column, m: TileMeta) -> Column:
    near = F.least(at, m.tile_size - 1 - at)
    return F.when(near < m.overlap, 0.5 * (1.0 - F.cos(math.pi * near / m.overlap))).otherwise(1.0) if m.overlap else F.lit(1.0)


def stitch_tiles(tiles: DataFrame, m: TileMeta, keys: list[str], blend: bool = True, value: str = "value") -> DataFrame:
    """(keys, row, col, value): mean of the tiles weighted by cosine ramps over the overlap, or alike without ``blend``; the padding is cut off."""
    w = F.greatest(F.lit(1e-6), _fade(F.col("row"), m) * _fade(F.col("col"), m)) if blend and m.overlap else F.lit(1.0)
    placed = tiles.select(*keys, (F.col("tile_r") * m.stride + F.col("row")).alias("row"), (F.col("tile_c") * m.stride + F.col("col")).alias("col"), w.alias("_w"), value)
    placed = placed.where((F.col("row") < m.rows) & (F.col("col") < m.cols))
    return placed.groupBy(*keys, "row", "col").agg((F.sum(F.col("_w") * F.col(value)) / F.sum(F.when(F.col(value).isNotNull(), F.col("_w")))).alias(value))
