"""Numeric kernels over tiles and series, batched with numpy.

A tile is a row with ``data ARRAY<DOUBLE>`` in row-major order and its shape; a series is a row with ``values``.
Tiles of a batch with one shape are one three-dimensional array, so that a kernel runs once per batch and
shape. Columns besides the result pass through. Missing values are NULL, NaN inside a kernel.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import fresh

ROOT = str(Path(__file__).resolve().parents[2])


def python_ready(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)


def _array(lists: list[np.ndarray | None]) -> pa.Array:
    flat = np.concatenate([np.empty(0), *(x for x in lists if x is not None)])
    values = pa.array(flat, pa.float64(), from_pandas=True)  # NaN becomes NULL
    offsets = np.concatenate(([0], np.cumsum([0 if x is None else len(x) for x in lists]))).astype(np.int32)
    gone = pa.array([*(x is None for x in lists), False])
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.array(gone.to_pylist(), bool)), values)


def _groups(shapes: list[tuple]) -> dict[tuple, list[int]]:
    out: dict[tuple, list[int]] = {}
    for k, s in enumerate(shapes):
        out.setdefault(s, []).append(k)
    return out


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values with NaN for NULL, and offsets."""
    offsets = column.offsets.to_numpy()
    return column.values.cast(pa.float64()).to_numpy(zero_copy_only=False), offsets


def map_tiles(df: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray] | np.ndarray], out: list[str] | str = "data", data: str = "data", rows: str = "n_rows", cols: str = "n_cols") -> DataFrame:
    """Apply a kernel on (tiles, rows, cols). It gives the new data, or a dictionary with an array for each name in ``out``.
    A NULL tile stays NULL; one whose values are not as many as its shape says raises."""
    python_ready(df.sparkSession)
    names = [out] if isinstance(out, str) else list(out)
    kept = [c for c in df.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _read(batch.column(data))
            there = batch.column(data).is_valid().to_pylist()
            shapes = list(zip(batch.column(rows).to_pylist(), batch.column(cols).to_pylist()))
            found: dict[str, list] = {n: [None] * batch.num_rows for n in names}
            for shape, at in _groups(shapes).items():
                at = [k for k in at if there[k]]
                for k in at:
                    if None in shape or offsets[k + 1] - offsets[k] != shape[0] * shape[1]:
                        raise ValueError(f"{offsets[k + 1] - offsets[k]} values are no tile of {shape[0]} x {shape[1]}")
                if not at:
                    continue
                stack = np.stack([flat[offsets[k] : offsets[k + 1]] for k in at]).reshape(len(at), *shape)
                got = kernel(stack)
                for n in names:
                    for k, x in zip(at, (got if isinstance(got, np.ndarray) else got[n]).reshape(len(at), -1)):
                        found[n][k] = x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(_array(found[n]) for n in names)], names=[*kept, *names])

    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names])
    return df.mapInArrow(run, schema)


def map_series(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], values: str = "values", out: str = "filled") -> DataFrame:
    """Apply a kernel on (pixels, times); series of one length are one array. A NULL or empty series stays."""
    r, c = fresh(df, "r", "c")
    shaped = df.withColumn(r, F.lit(1)).withColumn(c, F.coalesce(F.size(values), F.lit(0)))
    return map_tiles(shaped, lambda x: kernel(x[:, 0, :]) if x.size else x, out, values, r, c).drop(r, c)


def map_pairs(df: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], x: str, y: str, out: list[str]) -> DataFrame:
    """Apply a kernel on two series of each row, (rows, length) each; it gives a double for each row and name in ``out``.
    The two columns are gone from the result."""
    python_ready(df.sparkSession)
    kept = [c for c in df.columns if c not in (x, y, *out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, at), (b, bt) = _read(batch.column(x)), _read(batch.column(y))
            found = {n: np.full(batch.num_rows, np.nan) for n in out}
            for n, rows in _groups(np.diff(at).tolist()).items():
                got = kernel(*(np.stack([flat[o[k] : o[k] + n] for k in rows]) for flat, o in ((a, at), (b, bt))))
                for name in out:
                    found[name][rows] = got[name]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(found[n], pa.float64(), from_pandas=True) for n in out)], names=[*kept, *out])

    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in out])
    return df.mapInArrow(run, schema)


def to_series(df: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """One row per pixel with its values in order, NULL where missing."""
    both = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(both, lambda x: x["v"]).alias("values"))


def _scattered(df: DataFrame, cells: str, rows: str, cols: str) -> DataFrame:
    """``data`` from a list of (at, v), cells by their place in row-major order; the others are NULL."""
    python_ready(df.sparkSession)
    kept = [c for c in df.columns if c != cells]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(cells).offsets.to_numpy()
            at, v = (batch.column(cells).values.field(k) for k in (0, 1))
            at, v = at.to_numpy(zero_copy_only=False), v.cast(pa.float64()).to_numpy(zero_copy_only=False)
            out = []
            for k, (r, c) in enumerate(zip(batch.column(rows).to_pylist(), batch.column(cols).to_pylist())):
                own = np.full(r * c, np.nan)
                own[at[offsets[k] : offsets[k + 1]]] = v[offsets[k] : offsets[k + 1]]
                out.append(own)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _array(out)], names=[*kept, "data"])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in kept] + [T.StructField("data", T.ArrayType(T.DoubleType()))]))


def to_tiles(df: DataFrame, keys: list[str], n_rows: int, n_cols: int, value: str = "value") -> DataFrame:
    """Whole images of a known shape from (keys, row, col, value); pixels without a row, or beyond the shape, are NULL, or left out."""
    own = df.where(F.col("row").between(0, n_rows - 1) & F.col("col").between(0, n_cols - 1))
    cells = F.collect_list(F.struct((F.col("row") * n_cols + F.col("col")).cast("long").alias("at"), F.col(value).cast("double").alias("v")))
    g = own.groupBy(*keys).agg(cells.alias("cells")).withColumn("n_rows", F.lit(n_rows)).withColumn("n_cols", F.lit(n_cols))
    return _scattered(g, "cells", "n_rows", "n_cols").select(*keys, "data", "n_rows", "n_cols")


def blocks_with_halo(df: DataFrame, keys: list[str], size: int, halo: int, value: str = "value") -> DataFrame:
    """Square blocks of a large image with ``halo`` more pixels on each side that has any: (keys, block_r, block_c, row0,
    col0, n_rows, n_cols, data). A pixel goes to the few blocks that see it; kernels of radius ``halo`` are exact inside a block."""
    def seen(c: str):
        lo = F.floor((F.col(c) - halo) / size)
        return F.explode(F.sequence(F.greatest(F.lit(0), lo), F.floor((F.col(c) + halo) / size)))

    each = df.withColumn("block_r", seen("row")).withColumn("block_c", seen("col"))
    cells = F.collect_list(F.struct("row", "col", F.col(value).cast("double").alias("v")))
    g = each.groupBy(*keys, "block_r", "block_c").agg(
        cells.alias("cells"), F.min("row").alias("row0"), F.min("col").alias("col0"), (F.max("row") - F.min("row") + 1).alias("n_rows"), (F.max("col") - F.min("col") + 1).alias("n_cols")
    )
    g = g.where((F.col("row0") + F.col("n_rows") > F.col("block_r") * size) & (F.col("col0") + F.col("n_cols") > F.col("block_c") * size))  # one that only a halo reaches has no pixel of its own
    placed = F.transform("cells", lambda x: F.struct(((x["row"] - F.col("row0")) * F.col("n_cols") + x["col"] - F.col("col0")).cast("long").alias("at"), x["v"].alias("v")))
    return _scattered(g.withColumn("cells", placed), "cells", "n_rows", "n_cols").select(*keys, "block_r", "block_c", "row0", "col0", "n_rows", "n_cols", "data")


def from_tiles(df: DataFrame, keys: list[str], data: str = "data", cols: str = "n_cols", out: str = "value") -> DataFrame:
    """Back to (keys, row, col, value)."""
    w, i = fresh(df, "w", "i")
    each = df.select(*keys, F.col(cols).alias(w), F.posexplode(data).alias(i, out))
    return each.select(*keys, F.expr(f"`{i}` div `{w}`").cast("int").alias("row"), (F.col(i) % F.col(w)).cast("int").alias("col"), out)
