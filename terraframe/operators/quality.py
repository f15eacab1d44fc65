"""Quality gates of scenes, spatial selection and class layers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.spectral import ALIASES

# Scene classes.
SCL_CLASSES = (
    (0, "No Data", "#000000"), (1, "Saturated / Defective", "#ff0000"), (2, "Dark Area", "#2f2f2f"), (3, "Cloud Shadow", "#643200"), (4, "Vegetation", "#00a000"), (5, "Bare Soil", "#ffe65a"),
    (6, "Water", "#0000ff"), (7, "Unclassified", "#808080"), (8, "Cloud (med.)", "#c0c0c0"), (9, "Cloud (high)", "#ffffff"), (10, "Thin Cirrus", "#64c8ff"), (11, "Snow / Ice", "#ff96ff"),
)
CLOUD, OUTSIDE, SNOW = (3, 8, 9, 10), (0, 6), 11
BAD_CLASSES = (0, 1, 3, 8, 9, 10)
SATURATED = 15000.0


# Texts of issues.
TOO_SMALL = "Scene too small: side below minimum threshold"
TOO_LARGE = "Scene too large: side exceeds maximum threshold"
DEGENERATE = "Degenerate shape: aspect ratio exceeds limit"
NO_VALID = "No valid pixels after filtering"
HIGH_CLOUD = "High cloud cover"
MUCH_SNOW = "Excessive snow/ice"
NO_CLASSES = "SCL asset missing; validation skipped"


def dimension_issues(rows: Column, cols: Column) -> Column:
    least, most = F.least(rows, cols), F.greatest(rows, cols)
    checks = F.array(
        F.when(least < 32, F.lit(TOO_SMALL)), F.when(most > 10980, F.lit(TOO_LARGE)), F.when((least > 0) & (most > 4.0 * least), F.lit(DEGENERATE))
    )
    return F.filter(checks, lambda x: x.isNotNull())


def check_dimensions(df: DataFrame, rows: str = "n_rows", cols: str = "n_cols") -> DataFrame:
    issues = dimension_issues(F.col(rows), F.col(cols))
    return df.withColumn("issues", issues).withColumn("dimension_pass", F.size("issues") == 0)


def confidence(valid: Column, cloud: Column, snow: Column, threshold: float = 0.30) -> Column:
    return F.when(valid == 0, 0.0).when(snow > 0.5, 0.0).when(cloud > threshold, 0.0).when(cloud < 0.1, 1.0).when(cloud < 0.3, 0.75).when(cloud < 0.4, 0.5).otherwise(0.0)


def validate_scl(df: DataFrame, keys: list[str], scl: str = "scl", threshold: float = 0.30) -> DataFrame:
    """One row per scene: confidence_score, cloud_ratio, snow_ratio, water_excluded (always true: water never counts),
    n_excluded (pixels without data or of water) and issues."""
    c = F.col(scl)
    agg = df.groupBy(*keys).agg(
        F.count_if(~c.isin(*OUTSIDE)).alias("valid"), F.count_if(c.isin(*CLOUD)).alias("cloud"), F.count_if(c == SNOW).alias("snow"), F.count_if(c.isin(*OUTSIDE)).alias("n_excluded")
    )
    share = lambda x: F.coalesce(F.col(x) / F.when(F.col("valid") > 0, F.col("valid")), F.lit(0.0))
    agg = agg.withColumn("cloud_ratio", share("cloud")).withColumn("snow_ratio", share("snow"))
    issues = F.filter(
        F.array(F.when(F.col("valid") == 0, NO_VALID), F.when(F.col("cloud_ratio") > 0.3, HIGH_CLOUD), F.when(F.col("snow_ratio") > 0.5, MUCH_SNOW)), lambda x: x.isNotNull()
    )
    score = confidence(F.col("valid"), F.col("cloud_ratio"), F.col("snow_ratio"), threshold)
    return agg.select(*keys, score.alias("confidence_score"), "cloud_ratio", "snow_ratio", F.lit(True).alias("water_excluded"), "n_excluded", issues.alias("issues"))


def validate_files(files: DataFrame, scl: DataFrame, key: str = "file", threshold: float = 0.30, min_confidence: float = 0.50) -> DataFrame:
    """One row per class layer. files: key and error (why it can't be read, NULL if it can); scl: key, scl. A layer that
    can't be read fails with its error; others pass by their confidence. Classes tell nothing of radiometry, which passes."""
    found = files.select(key, "error").join(validate_scl(scl, [key], threshold=threshold), key, "left")
    bad = F.col("error").isNotNull()
    none = F.col("confidence_score").isNull()  # readable, but without a pixel
    of = lambda c, x: F.when(~bad, F.coalesce(F.col(c), F.lit(x)))
    return found.select(
        key, "error", of("confidence_score", 0.0).alias("confidence_score"), of("cloud_ratio", 0.0).alias("cloud_ratio"), of("snow_ratio", 0.0).alias("snow_ratio"), F.when(~bad, F.lit(True)).alias("water_excluded"),
        F.when(~bad, F.when(none, F.array(F.lit(NO_VALID))).otherwise(F.col("issues"))).alias("issues"), F.when(~bad, F.lit(True)).alias("radiometry_pass"),
        F.when(bad, F.lit(False)).otherwise(F.coalesce("confidence_score", F.lit(0.0)) >= min_confidence).alias("passed"),
    )


def check_radiometry(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Fewer than 1 % of a scene's pixels may be saturated; a scene without any fails."""
    ok = F.count_if(F.col(value) > SATURATED) / F.when(F.count(value) > 0, F.count(value)) < 0.01
    return df.groupBy(*keys).agg(F.coalesce(ok, F.lit(False)).alias("radiometry_pass"))


def _fixed(x: Column, digits: int) -> Column:
    """A number with so many digits, rounded by its exact binary value and half to even, as printf of C does;
    ``format_string`` rounds its shortest decimal form half up."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits))


def reject_reason(dimension: Column, radiometry: Column, cloud: Column, snow: Column, conf: Column, max_cloud: float = 0.30, max_snow: float = 1.0, min_confidence: float = 0.01) -> Column:
    """The first reason that holds, or the empty text."""
    return (
        F.when(~dimension, F.lit("dimension check failed"))
        .when(~radiometry, F.lit("radiometry check failed"))
        .when(cloud > max_cloud, F.concat(F.lit("cloud "), _fixed(cloud * 100, 1), F.lit(f"% > {max_cloud * 100:.1f}%")))
        .when(snow > max_snow, F.concat(F.lit("snow "), _fixed(snow * 100, 1), F.lit(f"% > {max_snow * 100:.1f}%")))
        .when(conf < min_confidence, F.concat(F.lit("confidence "), _fixed(conf, 2), F.lit(f" < {min_confidence:.2f}")))
        .otherwise(F.lit(""))
    )


def scene_gate(scenes: DataFrame, metrics: DataFrame, key: str = "scene_id", **limits) -> DataFrame:
    """Scenes with their metrics; what no metrics say passes. Adds reject_reason and accepted."""
    joined = scenes.join(metrics, key, "left")
    get = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in joined.columns else F.lit(d)
    reason = reject_reason(get("dimension_pass", True), get("radiometry_pass", True), get("cloud_ratio", 0.0), get("snow_ratio", 0.0), get("confidence_score", 1.0), **limits)
    return joined.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason") == "")


METRICS = {"cloud_ratio": 0.0, "snow_ratio": 0.0, "confidence_score": 1.0, "dimension_pass": True, "radiometry_pass": True}


def stack_metrics(scenes: DataFrame, scl: DataFrame, threshold: float = 0.30, unreadable: DataFrame | None = None, key: str = "scene_id") -> DataFrame:
    """What class layers say of scenes when they are stacked: key and the metrics. A layer of wrong dimensions (n_rows, n_cols
    of scenes) has ratios and confidence 0 and fails both checks; one that can't be read (``unreadable``: key) passes all."""
    found = validate_scl(scl, [key], threshold=threshold).select(key, "confidence_score", "cloud_ratio", "snow_ratio")
    found = found.join(check_dimensions(scenes).select(key, "dimension_pass"), key, "left").withColumn("dimension_pass", F.coalesce("dimension_pass", F.lit(True)))
    ok = F.col("dimension_pass")
    zero = lambda c: F.when(ok, F.col(c)).otherwise(0.0).alias(c)
    out = found.select(key, zero("confidence_score"), zero("cloud_ratio"), zero("snow_ratio"), "dimension_pass", ok.alias("radiometry_pass"))
    if unreadable is None:
        return out
    gone = unreadable.select(key).distinct()
    return out.join(gone, key, "left_anti").unionByName(gone.select(key, *[F.lit(d).alias(m) for m, d in METRICS.items()]))


def with_reports(scenes: DataFrame, sidecars: DataFrame, computed: DataFrame, key: str = "scene_id") -> DataFrame:
    """Each scene's report: its sidecar, else what was computed from its classes, else defaults that pass. ``report_source`` says which."""
    pick = lambda df, tag: df.select(key, F.lit(True).alias(tag), *[(F.col(m) if m in df.columns else F.lit(None)).alias(f"{tag}_{m}") for m in METRICS])
    joined = scenes.join(pick(sidecars, "side"), key, "left").join(pick(computed, "scl"), key, "left")
    source = F.when(F.col("side"), "sidecar_json").when(F.col("scl"), "scl_computed").otherwise("none")
    # A sidecar that lacks a key passes by it.
    values = [F.when(F.col("side"), F.coalesce(F.col(f"side_{m}"), F.lit(d))).otherwise(F.coalesce(F.col(f"scl_{m}"), F.lit(d))).alias(m) for m, d in METRICS.items()]
    return joined.select(*scenes.columns, *values, source.alias("report_source"))


def missing_required(df: DataFrame, keys: list[str], required: list[str], band: str = "band") -> DataFrame:
    """Scenes with the required bands they lack, in the order in which they are required."""
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    own = F.collect_set(F.coalesce(names[F.col(band)], F.col(band)))
    want = F.array(*[F.lit(ALIASES.get(b, b)) for b in required])
    return df.groupBy(*keys).agg(F.array_except(want, own).alias("missing"))


def clip(df: DataFrame, lon: float, lat: float, half: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.where(F.col(x).between(lon - half, lon + half) & F.col(y).between(lat - half, lat + half))


def clip_box_indices(ox: Column, oy: Column, pw: Column, ph: Column, rows: Column, cols: Column, min_lon: Column, max_lon: Column, min_lat: Column, max_lat: Column) -> Column:
    """1-based first and last row and column of a box, as a struct."""
    top = F.when(ph < 0, max_lat).otherwise(min_lat)
    bottom = F.when(ph < 0, min_lat).otherwise(max_lat)
    bound = lambda v, n: F.greatest(F.lit(1), F.least(n, v))
    at = lambda edge, o, p: ((edge - o) / p).cast("int") + 1
    return F.struct(
        bound(at(top, oy, ph), rows).alias("r0"), bound(at(bottom, oy, ph), rows).alias("r1"), bound(at(min_lon, ox, pw), cols).alias("c0"), bound(at(max_lon, ox, pw), cols).alias("c1")
    )


def utm(lon: float, lat: float, zone: int, south: bool = False) -> tuple[float, float]:
    """Easting and northing of a point in a UTM zone (WGS 84), by the Krueger series; good to millimetres within a zone."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam, e = math.radians(lat), math.radians(lon - (6 * zone - 183)), 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.hypot(1, t))
    x = eta + sum(c * math.cos(2 * k * xi) * math.sinh(2 * k * eta) for k, c in enumerate(series, 1))
    y = xi + sum(c * math.sin(2 * k * xi) * math.cosh(2 * k * eta) for k, c in enumerate(series, 1))
    return 500000 + 0.9996 * radius * x, (10_000_000 if south else 0) + 0.9996 * radius * y


def native_point(lon: float, lat: float, epsg: int | None = None) -> tuple[float, float]:
    """A point in the reference system of the pixels: UTM zones by number; degrees, and systems that are not known, as it is."""
    if epsg is not None and (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        return utm(lon, lat, epsg % 100, epsg >= 32701)
    return lon, lat


def _distance(lon: float, lat: float, x: str, y: str) -> Column:
    return F.struct(F.abs(F.col(x) - lon) + F.abs(F.col(y) - lat), F.col(y), F.col(x))


def nearest_pixel(df: DataFrame, keys: list[str], lon: float, lat: float, value: str = "value", x: str = "x", y: str = "y", epsg: int | None = None) -> DataFrame:
    """The value nearest to a point, by partial minima of the distance. ``epsg``: the system of x and y, if not degrees."""
    lon, lat = native_point(lon, lat, epsg)
    return df.groupBy(*keys).agg(F.min_by(value, _distance(lon, lat, x, y)).alias("value"))


def grid_pixel(df: DataFrame, lon: float, lat: float, grid: tuple[float, float, float, float], shape: tuple[int, int], epsg: int | None = None) -> DataFrame:
    """The pixels nearest to a point on a known grid (origin x, origin y, pixel width, height): a filter on row and col, which reaches the scan."""
    lon, lat = native_point(lon, lat, epsg)
    at = lambda v, o, p, n: max(0, min(n - 1, math.floor((v - o) / p + 0.5)))
    return df.where((F.col("row") == at(lat, grid[1], grid[3], shape[0])) & (F.col("col") == at(lon, grid[0], grid[2], shape[1])))


def bbox_mean(df: DataFrame, keys: list[str], lon: float, lat: float, half: float, value: str = "value", x: str = "x", y: str = "y") -> DataFrame:
    """The mean of a box's valid pixels: NULL if none of its pixels is valid, the pixel nearest to its middle if it has no pixel."""
    inside = F.col(x).between(lon - half, lon + half) & F.col(y).between(lat - half, lat + half)
    g = df.groupBy(*keys).agg(F.count_if(inside).alias("n"), F.avg(F.when(inside, F.col(value))).alias("mean"), F.min_by(value, _distance(lon, lat, x, y)).alias("near"))
    return g.select(*keys, F.when(F.col("n") > 0, F.col("mean")).otherwise(F.col("near")).alias("value"))


def scl_mask(scl: Column, bad=BAD_CLASSES) -> Column:
    return scl.isin(*bad)


def scl_histogram(df: DataFrame, keys: list[str], scl: str = "scl", bad=BAD_CLASSES) -> DataFrame:
    """Counts and shares of classes with their labels, and each scene's share of bad and of clear pixels."""
    names = F.create_map(*[F.lit(x) for k, label, _ in SCL_CLASSES for x in (k, label)])
    w = W.partitionBy(*keys)
    n = df.groupBy(*keys, scl).agg(F.count(F.lit(1)).alias("n"))
    pct = lambda x: 100.0 * x / F.sum("n").over(w)
    bad_pct = pct(F.sum(F.when(F.col(scl).isin(*bad), F.col("n")).otherwise(0)).over(w))
    label = F.coalesce(names[F.col(scl)], F.concat(F.lit("SCL "), F.col(scl).cast("string")))
    return n.select(*keys, scl, label.alias("label"), "n", pct(F.col("n")).alias("pct"), bad_pct.alias("bad_pct"), (100.0 - bad_pct).alias("clear_pct"))
