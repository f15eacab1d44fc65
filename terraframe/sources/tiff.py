"""Reading and writing of plain GeoTIFF rasters, without a raster library.

Baseline TIFF in either byte order: strips or tiles, uncompressed or deflated (with or without horizontal
differencing), integers and floats of 8 to 64 bits, pixels or planes, the affine grid of ModelPixelScale and
ModelTiepoint, and the nodata tag. Files are read through Spark as binary rows, so from any file system; other
layouts raise. Files are written by tasks into a folder that all executors mount.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scaling import NODATA, from_nodata
from ..operators.tiles import python_ready
from .bands import timestamp_from_path

# Tags and types of the format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_SIZE, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, NODATA_TAG = 33550, 33922, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q"}
DEFLATE = (8, 32946)


class Raster(NamedTuple):
    data: np.ndarray  # bands, rows, cols
    grid: tuple[float, float, float, float] | None  # x0, y0, dx, dy
    nodata: float | None


def encode(data: np.ndarray, grid: tuple[float, float, float, float] | None = None, nodata: float | None = NODATA, strip_rows: int = 64) -> bytes:
    """A deflated little-endian file of (bands, rows, cols), one plane for each band."""
    data = np.ascontiguousarray(data if data.ndim == 3 else data[None])
    bands, rows, cols = data.shape
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    chunks = [zlib.compress(data[b, r : r + strip_rows].astype(data.dtype.newbyteorder("<")).tobytes()) for b in range(bands) for r in range(0, rows, strip_rows)]
    at = 8 + np.concatenate(([0], np.cumsum([len(c) for c in chunks])))
    tags: dict[int, tuple[int, list]] = {
        WIDTH: (4, [cols]), LENGTH: (4, [rows]), BITS: (3, [8 * data.dtype.itemsize] * bands), COMPRESSION: (3, [8]), PHOTOMETRIC: (3, [1]), STRIP_AT: (4, at[:-1].tolist()), SAMPLES: (3, [bands]),
        ROWS_PER_STRIP: (4, [strip_rows]), STRIP_SIZE: (4, [len(c) for c in chunks]), PLANAR: (3, [2 if bands > 1 else 1]), SAMPLE_FORMAT: (3, [kind] * bands),
    }
    if grid is not None:
        # Rows of a file go down; a grid that goes up is told by a negative scale.
        tags |= {PIXEL_SCALE: (12, [grid[2], -grid[3], 0.0]), TIE_POINT: (12, [0.0, 0.0, 0.0, grid[0], grid[1], 0.0])}
    if nodata is not None:
        tags[NODATA_TAG] = (2, [bytes([c]) for c in f"{nodata:g}".encode() + b"\0"])
    entry, more = int(at[-1]), b""
    behind = entry + 2 + 12 * len(tags) + 4
    table = struct.pack("<H", len(tags))
    for tag, (kind, values) in sorted(tags.items()):
        raw = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        if len(raw) > 4:
            place, more = behind + len(more), more + raw + b"\0" * (len(raw) % 2)
            raw = struct.pack("<I", place)
        table += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, entry) + b"".join(chunks) + table + struct.pack("<I", 0) + more


def _tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("no TIFF file")
    at = struct.unpack(order + "I", raw[4:8])[0]
    out = {}
    for k in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind in TYPES:
            form = f"{order}{n * len(TYPES[kind])}{TYPES[kind][0]}"
            size, place = struct.calcsize(form), at + 10 + 12 * k
            if size > 4:
                place = struct.unpack(order + "I", raw[place : place + 4])[0]
            out[tag] = struct.unpack(form, raw[place : place + size])
    return order, out


def decode(raw: bytes) -> Raster:
    order, tags = _tags(raw)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    rows, cols, bands = one(LENGTH), one(WIDTH), one(SAMPLES, 1)
    compression, planar, predictor = one(COMPRESSION, 1), one(PLANAR, 1), one(PREDICTOR, 1)
    if compression not in (1, *DEFLATE) or predictor not in (1, 2) or len(set(tags[BITS])) > 1 or one(BITS) not in (8, 16, 32, 64):
        raise ValueError(f"layout not known: compression {compression}, predictor {predictor}, bits {tags[BITS]}")
    kind = np.dtype(f"{order}{'uif'[one(SAMPLE_FORMAT, 1) - 1]}{one(BITS) // 8}")
    tiled = TILE_AT in tags
    high, wide = (one(TILE_LENGTH), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, rows), rows), cols)
    at, sizes = (tags[TILE_AT], tags[TILE_SIZE]) if tiled else (tags[STRIP_AT], tags[STRIP_SIZE])
    down, across = -(-rows // high), -(-cols // wide)
    inside = 1 if planar == 2 else bands
    out = np.zeros((bands, rows, cols), kind.newbyteorder("="))
    for k, (lo, size) in enumerate(zip(at, sizes)):
        chunk = raw[lo : lo + size]
        chunk = zlib.decompress(chunk) if compression in DEFLATE else chunk
        plane, rest = divmod(k, down * across)
        r, c = rest // across * high, rest % across * wide
        n = high if tiled else min(high, rows - r)
        block = np.frombuffer(chunk, kind, n * wide * inside).reshape(n, wide, inside).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, 1, dtype=out.dtype)
        block = block[: rows - r, : cols - c]
        first = plane if planar == 2 else 0
        out[first : first + inside, r : r + block.shape[0], c : c + block.shape[1]] = block.transpose(2, 0, 1)
    grid = None
    if PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy, _), (i, j, _, x, y, _) = tags[PIXEL_SCALE][:3], tags[TIE_POINT][:6]
        grid = (x - i * sx, y + j * sy, sx, -sy)
    text = b"".join(tags[NODATA_TAG]).split(b"\0")[0].strip() if NODATA_TAG in tags else b""
    return Raster(out, grid, float(text) if text else None)


ROWS = 1 << 16
_SCHEMA = "path string, modified timestamp, error string, n_rows int, n_cols int, x0 double, y0 double, dx double, dy double, nodata double, band_idx int, row int, col int, value double"


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for batch in batches:
        for path, modified, raw in zip(batch.column("path"), batch.column("modificationTime"), batch.column("content")):
            try:
                image, error = decode(raw.as_py()), None
            except Exception as exc:  # a file that can't be read is a row that says why
                image, error = Raster(np.empty((0, 0, 0)), None, None), str(exc) or type(exc).__name__
            n_bands, rows, cols = image.data.shape
            grid = image.grid or (None,) * 4
            flat = image.data.astype(np.float64).reshape(-1)
            total = len(flat) if error is None else 1
            for lo in range(0, max(total, 1), ROWS):
                n = min(ROWS, total - lo)
                at = np.arange(lo, lo + n)
                same = lambda v, t: pa.array([v], t).take(pa.array(np.zeros(n, np.int64)))  # noqa: E731, B023
                head = [same(path.as_py(), pa.string()), pa.array([modified.as_py()] * n, batch.schema.field("modificationTime").type), same(error, pa.string()), *(same(v, pa.int32()) for v in (rows, cols)), *(same(v, pa.float64()) for v in (*grid, image.nodata))]
                if error is not None:
                    body = [same(None, pa.int32())] * 3 + [same(None, pa.float64())]
                else:
                    body = [pa.array((at // (rows * cols)).astype(np.int32)), pa.array((at // cols % rows).astype(np.int32)), pa.array((at % cols).astype(np.int32)), pa.array(flat[lo : lo + n])]
                yield pa.RecordBatch.from_arrays([*head, *body], names=names)


def read_rasters(spark: SparkSession, path: str, bands: list[str] | None = None) -> DataFrame:
    """One row for each pixel and band of all files: scene_id (the file's name), ts, path, error, n_rows, n_cols, x0, y0, dx, dy,
    band_idx (from 0), band (its name, or band_<idx>), row, col, value (NULL where nodata). A file that can't be read is one row with its error."""
    python_ready(spark)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(path).select("path", "modificationTime", "content")
    px = raw.mapInArrow(_decoded, _SCHEMA)
    name = F.regexp_extract("path", r"([^/]+)\.tiff?$", 1)
    label = F.concat(F.lit("band_"), F.col("band_idx").cast("string"))
    if bands:
        label = F.coalesce(F.get(F.array(*map(F.lit, bands)), F.col("band_idx")), label)
    value = F.when(F.col("nodata").isNull() | ~(F.abs(F.col("value") - F.col("nodata")) <= 1e-4), from_nodata(F.col("value")))
    return px.select(name.alias("scene_id"), timestamp_from_path(F.col("path"), F.col("modified")).alias("ts"), "path", "error", "n_rows", "n_cols", "x0", "y0", "dx", "dy", "band_idx", F.when(F.col("band_idx").isNotNull(), label).alias("band"), "row", "col", value.alias("value"))


def write_rasters(tiles: DataFrame, folder: str, name: str = "name", kind: str = "float32", nodata: float = NODATA) -> None:
    """Write one file for each row of (name, data, n_rows, n_cols and, if known, x0, y0, dx, dy). ``folder`` is mounted by all executors. A file appears under its name when it is complete, so a task that runs again does no harm."""
    python_ready(tiles.sparkSession)
    columns = tiles.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                data = np.array([nodata if v is None else v for v in row["data"]], kind).reshape(row["n_rows"], row["n_cols"])
                grid = tuple(row[c] for c in ("x0", "y0", "dx", "dy")) if {"x0", "y0", "dx", "dy"} <= set(columns) else None
                path = os.path.join(folder, f"{row[name]}.tif")
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(encode(data, grid if grid and None not in grid else None, nodata))
                os.replace(part, path)
                done.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])

    tiles.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
