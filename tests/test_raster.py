"""Closed forms, edge rules and invariants of the raster and time-series operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraframe.functions import frames, scaling, spectral
from terraframe.operators import filters, gapfill, grids, quality, stats, texture, tiles, trends, wavelets
from terraframe.plans import plots, scenes as scene_plans
from terraframe.plans.stack import StackConfig, stack_timeseries
from terraframe.sources import bands, catalog, store, tiff
from terraframe.streaming import live


def one(df):
    return df.collect()[0]


def test_indices_and_guards(spark):
    df = spark.createDataFrame([(1, 0.8, 0.2, 0.1, 0.3), (2, 0.0, 0.0, 0.0, 0.0), (3, None, 0.2, 0.1, 0.3)], "id int, nir double, red double, blue double, green double")
    r = {x["id"]: x for x in spectral.compute_indices(df, ["NDVI ", "evi", "cig", "arvi", "savi"]).collect()}
    assert math.isclose(r[1]["ndvi"], 0.6) and math.isclose(r[1]["cig"], 0.8 / 0.3 - 1)
    assert math.isclose(r[1]["evi"], 2.5 * 0.6 / (0.8 + 1.2 - 0.75 + 1))
    assert r[2]["ndvi"] == 0 and r[2]["cig"] == 0 and r[3]["ndvi"] is None and r[3]["cig"] is None
    with pytest.warns(UserWarning):
        assert "nbr" not in spectral.compute_indices(df, ["ndvi", "nbr"]).columns
    for bad in ([], ["nope"]):
        with pytest.raises(ValueError):
            spectral.compute_indices(df, bad)
    assert spectral.missing_bands(["blue", "B8A"], ["B02", "nir08", "nir"]) == ["B08"]
    assert len(spectral.ALIASES) == 37 and spectral.AVAILABLE_INDICES == sorted(spectral.list_indices())


def test_scaling_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0), ("c", None)], "band string, value double")
    r = scaling.minmax_band(df, ["band"]).collect()
    assert {(x["band"], x["minmax"], x["vmin"]) for x in r} == {("a", 0.0, 1.0), ("a", 1.0, 1.0), ("a", None, 1.0), ("b", 0.5, 5.0), ("c", None, 0.0)}
    assert {x["normalized"] for x in scaling.normalize_band(df, ["band"], out_min=2, out_max=4).where("value IS NOT NULL").collect()} == {2.0, 4.0}
    known = spark.createDataFrame([("B04", 1314.56 + 1347.54)], "band string, value double")
    assert math.isclose(one(scaling.normalize_for_dl(known, "sentinel2_all", []))["normalized"], 1.0)
    with pytest.raises(Exception, match="no statistics for band"):
        scaling.normalize_for_dl(df, "sentinel2_rgb", []).collect()
    with pytest.raises(ValueError):
        scaling.normalize_for_dl(df, "nope", [])
    raw = spark.createDataFrame([(-9999.0,), (float("nan"),), (1.5,), (None,)], "value double")
    assert [x["value"] for x in store.ingest(raw).collect()] == [None, None, 1.5, None]
    assert {x["stretched"] for x in scaling.percentile_stretch(df.where("band <> 'a'"), ["band"]).collect()} == {0.0, None}
    assert scaling.preset_bands("sentinel2_rgb") == ["B04", "B03", "B02"]


def test_quality_ladders(spark):
    sides = [(32, 32, ""), (31, 32, quality.TOO_SMALL), (10980, 10980, ""), (10981, 10980, quality.TOO_LARGE), (512, 128, ""), (513, 128, quality.DEGENERATE), (20, 100, f"{quality.TOO_SMALL},{quality.DEGENERATE}"), (0, 100, quality.TOO_SMALL)]
    df = spark.createDataFrame(sides, "n_rows int, n_cols int, want string")
    assert all(",".join(x["issues"]) == x["want"] and x["dimension_pass"] == (x["want"] == "") for x in quality.check_dimensions(df).collect())
    rows = []
    for scene, (cloud, snow, water) in enumerate([(5, 0, 0), (20, 0, 10), (35, 0, 0), (0, 60, 0), (0, 0, 100)]):
        rows += [(scene, 8)] * cloud + [(scene, 11)] * snow + [(scene, 6)] * water + [(scene, 4)] * (100 - cloud - snow - water)
    df = spark.createDataFrame(rows, "scene_id int, scl int")
    got = {x["scene_id"]: x for x in quality.validate_scl(df, ["scene_id"]).collect()}
    assert [got[k]["confidence_score"] for k in range(5)] == [1.0, 0.75, 0.0, 0.0, 0.0]
    assert {x["scene_id"]: x["confidence_score"] for x in quality.validate_scl(df, ["scene_id"], threshold=0.5).collect()}[2] == 0.5
    assert got[4]["issues"] == ["No valid pixels after filtering"] and got[3]["issues"] == ["Excessive snow/ice"] and got[2]["issues"] == ["High cloud cover"] and got[1]["n_excluded"] == 10 and got[1]["water_excluded"] is True
    px = spark.createDataFrame([(0, 20000.0 if k < 10 else 1.0) for k in range(1000)] + [(1, 20000.0 if k < 9 else 1.0) for k in range(1000)] + [(2, None)], "s int, value double")
    assert {x["s"]: x["radiometry_pass"] for x in quality.check_radiometry(px, ["s"]).collect()} == {0: False, 1: True, 2: False}
    h = quality.scl_histogram(spark.createDataFrame([(1, 8), (1, 4), (1, 99), (1, 4)], "s int, scl int"), ["s"]).collect()
    assert {(x["label"], x["n"], x["bad_pct"]) for x in h} == {("Cloud (med.)", 1, 25.0), ("Vegetation", 2, 25.0), ("SCL 99", 1, 25.0)}


def series(spark, values, step=16):
    return spark.createDataFrame([(1, k, float(k * step), None if v is None else float(v)) for k, v in enumerate(values)], "p int, t int, day double, value double")


def test_statistics_over_time(spark):
    s = series(spark, [1, None, 3, 4, 5])
    assert tuple(one(stats.valid_obs_count(s, ["p"])))[1:] == (4, 0.8)
    assert tuple(one(stats.temporal_gap_stats(s, ["p"])))[1:] == (32.0, 64 / 3)
    assert tuple(one(stats.pixel_quantiles(series(spark, [7]), ["p"])))[1:] == (7.0,) * 5
    assert one(stats.pixel_iqr(series(spark, [7]), ["p"]))["iqr"] is None
    assert tuple(one(stats.pixel_regression(series(spark, [2, 4, 6]), ["p"], "t", "value")))[1:] == (2.0, 2.0, 1.0)
    assert tuple(one(stats.pixel_regression(series(spark, [5, 5, 5]), ["p"], "t", "value")))[1:] == (0.0, 5.0, 0.0)
    assert one(stats.pixel_regression(series(spark, [5]), ["p"], "t", "value"))["slope"] is None
    assert one(stats.time_window_stats(series(spark, [5]), ["p"]))["std"] == 0
    assert one(stats.time_window_stats(series(spark, [None]), ["p"]))["mean"] is None
    with pytest.raises(ValueError):
        stats.time_window_stats(s, ["p"], window_days=0)
    flat = series(spark, [1, 2, 3]).withColumn("b", F.lit(4.0))
    assert one(stats.pearson(flat, ["p"], "value", "b"))["r"] == 0 and one(stats.pearson(flat.limit(2), ["p"], "value", "b"))["r"] is None
    zs = stats.anomaly_zscore(series(spark, [1, 2, 3, 4]), ["p"], window_days=400).orderBy("t").collect()
    assert math.isclose(zs[0]["zscore"], -1.5 / np.std([1, 2, 3, 4], ddof=1))
    x = np.random.default_rng(1).normal(size=(50, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = {(r["band_a"], r["band_b"]): r["cov"] for r in stats.band_covariance(df, ["a", "b", "c"]).collect()}
    assert np.allclose([[got[i, j] for j in "abc"] for i in "abc"], np.cov(x.T), atol=1e-10)
    pc = np.array([tuple(r)[3:] for r in stats.principal_components(df, ["a", "b", "c"], 2).collect()])
    assert np.allclose(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2], pc.var(0, ddof=1))
    m = [r["mahalanobis"] ** 2 for r in stats.mahalanobis(df, ["a", "b", "c"]).collect()]
    assert math.isclose(sum(m), 3 * 49)
    assert one(stats.dataset_stats(spark.createDataFrame([("x", None)], "band string, value double")))["std"] == 1


def test_trends(spark):
    line = [3 + 2 * k for k in range(8)]
    assert tuple(one(trends.theil_sen(series(spark, line, 1), ["p"])))[1:] == (2.0, 3.0)
    assert tuple(one(trends.theil_sen(series(spark, [4]), ["p"])))[1:] == (0.0, 4.0)
    assert one(trends.theil_sen(series(spark, [None]), ["p"]))["slope"] is None
    mk = one(trends.mann_kendall(series(spark, line), ["p"]))
    assert mk["S"] == 28 and mk["trend"] == 1 and one(trends.mann_kendall(series(spark, [1, 2, 3]), ["p"]))["S"] is None
    assert one(trends.mann_kendall(series(spark, [2, 2, 2, 2]), ["p"]))["Z"] == 0
    b = one(trends.breakpoint_scan(series(spark, [0, 0, 0, 0, 10, 10, 10, 10], 1), ["p"]))
    assert b["break_day"] == 3 and math.isclose(b["magnitude"], 10) and b["rss_ratio"] < 1e-9
    assert one(trends.breakpoint_scan(series(spark, [1, 2, 3, 4, 5]), ["p"]))["break_day"] is None
    bell = one(trends.phenology(series(spark, [0, 0, 5, 10, 5, 0], 10), ["p"]))
    assert (bell["sos"], bell["pos"], bell["eos"], bell["peak_val"]) == (14.0, 30.0, 46.0, 10.0)
    assert one(trends.phenology(series(spark, [1, 1, 1, 1]), ["p"]))["pos"] is None
    first = one(trends.phenology(series(spark, [0, 9, 3, 9, 0], 1), ["p"]))
    assert first["pos"] == 1.0


def slow_pchip(y):
    t = [k for k, v in enumerate(y) if not np.isnan(v)]
    n = len(t)
    if n < 2:
        return np.full(len(y), y[t[0]]) if n else y
    v = [y[k] for k in t]
    h = [float(b - a) for a, b in zip(t, t[1:])]
    s = [(b - a) / w for a, b, w in zip(v, v[1:], h)]
    d = [*s, s[-1]]
    for k in range(1, n - 1):
        w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
        d[k] = (w1 * d[k - 1] + w2 * d[k]) / (w1 + w2)
    for k in range(n - 1):
        if abs(s[k]) < 1e-14:
            d[k] = d[k + 1] = 0.0
        elif (a := d[k] / s[k]) ** 2 + (b := d[k + 1] / s[k]) ** 2 > 9:
            root = math.sqrt(a * a + b * b)
            d[k], d[k + 1] = 3 * s[k] * a / root, 3 * s[k] * b / root
    out = y.copy()
    for x in range(len(y)):
        if np.isnan(y[x]):
            if x < t[0] or x > t[-1]:
                out[x] = v[0] if x < t[0] else v[-1]
                continue
            k = max(i for i in range(n) if t[i] < x)
            u = (x - t[k]) / h[k]
            out[x] = (2 * u**3 - 3 * u**2 + 1) * v[k] + (u**3 - 2 * u**2 + u) * h[k] * d[k] + (3 * u**2 - 2 * u**3) * v[k + 1] + (u**3 - u**2) * h[k] * d[k + 1]
    return out


def slow_ets(y):
    t = [k for k, v in enumerate(y) if not np.isnan(v)]
    if len(t) <= 2:
        return gapfill.linear(y[None])[0]
    v = [y[k] for k in t]
    best = (math.inf, 0.3, 0.1)
    for a in gapfill.ALPHAS:
        for b in gapfill.BETAS:
            level, trend, e = v[0], (v[1] - v[0]) / max(t[1] - t[0], 1), 0.0
            for x in v[1:]:
                new = a * x + (1 - a) * (level + trend)
                level, trend = new, b * (new - level) + (1 - b) * trend
                e += (x - level) ** 2
            if e < best[0]:
                best = (e, a, b)
    _, a, b = best
    level, trend, out, seen = v[0], (v[1] - v[0]) / max(t[1] - t[0], 1), y.copy(), 0
    for k, x in enumerate(y):
        if np.isnan(x):
            out[k] = v[0] if k < t[0] else v[-1] if k > t[-1] else level + trend
        else:
            if seen:
                new = a * x + (1 - a) * (level + trend)
                level, trend = new, b * (new - level) + (1 - b) * trend
            seen += 1
    return out


def test_fills_against_loops():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 13)).cumsum(1)
    x[rng.random(x.shape) < 0.4] = np.nan
    x[0], x[1, 1:], x[2] = np.nan, np.nan, 5.0
    assert np.allclose(gapfill.pchip(x), [slow_pchip(r) for r in x], equal_nan=True)
    assert np.allclose(gapfill.ets(x), [slow_ets(r) for r in x], equal_nan=True)


@pytest.mark.parametrize("method", gapfill.METHODS)
def test_fill_contract(spark, method):
    rows = [(0, [1.0, 2.0, 3.0, 4.0, 5.0]), (1, [None] * 5), (2, [None, 7.0, None, None, None]), (3, [None, 2.0, None, 4.0, None])]
    got = {r["p"]: r["filled"] for r in gapfill.interpolate_gaps(spark.createDataFrame(rows, "p int, values array<double>"), method).collect()}
    assert got[0] == rows[0][1] and got[1] == [None] * 5 and np.allclose(got[2], 7.0)
    assert got[3][1] == 2.0 and got[3][3] == 4.0
    if method != "savgol" and method != "gauss":
        assert got[3][0] == 2.0 and got[3][4] == 4.0
    with pytest.raises(ValueError):
        gapfill.interpolate_gaps(spark.createDataFrame(rows, "p int, values array<double>"), "nope")


def tile(spark, x):
    return spark.createDataFrame([(0, [None if np.isnan(v) else float(v) for v in np.ravel(x)], x.shape[0], x.shape[1])], "id int, data array<double>, n_rows int, n_cols int")


def test_filters_on_tiles(spark):
    x = np.random.default_rng(3).random((9, 12))
    df = tile(spark, x)
    apply = lambda name, **kw: np.array(one(filters.apply_filter(df, name, **kw))["data"], float).reshape(x.shape)
    assert np.allclose(apply("ERODE", radius=2), -filters.morpho_dilate(-x[None], 2)[0])
    assert np.allclose(apply("convolve", kernel=[[1.0]]), x)
    assert np.allclose(filters.gaussian_blur(np.full((1, 5, 5), 3.0)), 3.0)
    assert np.allclose(filters.bilateral_filter(np.full((1, 5, 5), 3.0)), 3.0)
    ramp = np.tile(np.arange(6.0), (5, 1))[None]
    assert np.allclose(filters.sobel_magnitude(ramp)[0][:, 1:-1], 8) and np.allclose(filters.sobel_direction(ramp)[0][:, 1:-1], 0)
    assert (apply("open") <= x + 1e-12).all() and (apply("close") >= x - 1e-12).all() and (apply("top_hat_white") >= -1e-12).all()
    holes = x.copy()
    holes[4, 4] = np.nan
    for name, (_, params) in filters.FILTERS.items():
        own = {"kernel": np.ones((3, 3))} if name == "convolve" else {}
        out = np.array(one(filters.apply_filter(tile(spark, holes), name, **own))["data"], float).reshape(x.shape)
        assert np.isnan(out).sum() == 1 and np.isnan(out[4, 4]), name
    for name, kw in (("nope", {}), ("convolve", {}), ("laplacian", {"connectivity": 5}), ("median", {"size": 3})):
        with pytest.raises(ValueError):
            filters.apply_filter(df, name, **kw)
    assert filters.AVAILABLE_FILTERS == sorted(filters.list_filters())


def test_texture(spark):
    flat = texture.glcm(np.full((1, 9, 9), 2.0), 3)
    assert flat["energy"][0, 4, 4] == 1 and flat["contrast"][0, 4, 4] == 0 and flat["homogeneity"][0, 4, 4] == 1
    assert np.isnan(flat["energy"][0, 1, 4]) and not np.isnan(flat["energy"][0, 2, 2])
    x = np.random.default_rng(5).random((2, 10, 10))
    angles = [texture.glcm(x, 5, 1, a)["contrast"] for a in texture.STEPS]
    assert np.allclose(texture.glcm(x, 5)["contrast"], sum(angles) / 4, equal_nan=True)
    q = texture.quantise(x)
    cells = np.zeros((65, 65))
    for r in range(3, 8):
        for c in range(3, 8):
            i, j = q[0, r, c], q[0, r, c + 1]
            cells[i, j] += 1
            cells[j, i] += 1
    p = cells / cells.sum()
    assert math.isclose(texture.glcm(x, 5, 1, 0)["energy"][0, 5, 5], (p**2).sum())
    for kw in ({"window": 4}, {"window": 1}, {"angle": 30}):
        with pytest.raises(ValueError):
            texture.compute_glcm(tile(spark, x[0]), **kw)


def test_wavelets(spark):
    x = np.random.default_rng(6).normal(size=(3, 48, 48))
    for w in wavelets.WAVELETS:
        for levels in (1, 2, 3):
            assert np.allclose(wavelets.idwt2d(wavelets.dwt2d(x, levels, w), levels, w), x, atol=1e-9)
            assert math.isclose((wavelets.dwt2d(x, levels, w) ** 2).sum(), (x**2).sum(), rel_tol=1e-9)
    cube = np.random.default_rng(7).normal(size=(4, 16, 16))
    assert np.allclose(wavelets.idwt3d(wavelets.dwt3d(cube, 2, "sym4"), 2, "sym4"), cube, atol=1e-9)
    clean = np.outer(np.linspace(0, 4, 32), np.linspace(0, 4, 32))[None]
    noisy = clean + np.random.default_rng(8).normal(0, 0.3, clean.shape)
    assert ((wavelets.denoise(noisy, 2, "haar") - clean) ** 2).mean() < ((noisy - clean) ** 2).mean()
    for bad in (lambda: wavelets.dwt2d(x, 5), lambda: wavelets.taps("db99"), lambda: wavelets.dwt3d(cube[:3], 1), lambda: wavelets.threshold_coeffs(F.lit(1), F.lit("HH"), -1)):
        with pytest.raises(ValueError):
            bad()
    c = wavelets.coefficients(wavelets.transform(tile(spark, x[0]), 2), ["id"], 2).groupBy("level", "subband").count().collect()
    assert {(r["level"], r["subband"], r["count"]) for r in c} == {(2, b, 144) for b in ("LL", "LH", "HL", "HH")} | {(1, b, 576) for b in ("LH", "HL", "HH")}


def test_grids(spark):
    px = spark.createDataFrame([(0, r, c, float(10 * r + c)) for r in range(4) for c in range(6)], "id int, row int, col int, value double")
    assert grids.align(px, ["id"], (0, 0, 1, 1), (4, 6), (9, 9, 1, 1), (4, 6)) is px
    up = {(r["row"], r["col"]): r["value"] for r in grids.bilinear_upsample(px, ["id"], (4, 6), (7, 11)).collect()}
    assert len(up) == 77 and all(math.isclose(v, 10 * r * 0.5 + c * 0.5) for (r, c), v in up.items())
    shifted = {(r["row"], r["col"]): r["value"] for r in grids.reproject_nearest(px, ["id"], (0.0, 0.0, 1.0, 1.0), (4, 6), (0.5, -0.5, 1.0, 1.0), (2, 7)).collect()}
    assert shifted[0, 0] == 1.0 and shifted[1, 6] == 15.0 and len(shifted) == 14
    for size, overlap in ((3, 1), (5, 2), (8, 2)):
        t, m = grids.extract_tiles(px, ["id"], 4, 6, size, overlap)
        pad = np.pad(np.arange(4)[:, None] * 10.0 + np.arange(6), ((0, (m.grid_rows - 1) * m.stride + size - 4), (0, (m.grid_cols - 1) * m.stride + size - 6)), mode="reflect")
        got = t.collect()
        assert len(got) == m.grid_rows * m.grid_cols * size * size
        assert all(r["value"] == pad[r["tile_r"] * m.stride + r["row"], r["tile_c"] * m.stride + r["col"]] for r in got)
        back = grids.stitch_tiles(t, m, ["id"]).collect()
        assert len(back) == 24 and all(math.isclose(r["value"], 10 * r["row"] + r["col"], abs_tol=1e-9) for r in back)
    assert grids.tile_grid_shape(600, 256, 256, 32) == (3, 3, 1)
    with pytest.raises(ValueError):
        grids.tile_grid_shape(10, 10, 4, 2)
    ms = px.select("id", "row", "col", F.col("value").alias("a"), F.col("value").alias("b"), F.col("value").alias("c"), F.col("value").alias("pan"))
    for method in ("gram_schmidt", "ihs", "wavelet"):
        assert all(math.isclose(r["a"], 10 * r["row"] + r["col"], abs_tol=1e-6) for r in grids.pansharpen(ms, ["id"], ["a", "b", "c"], method, (4, 6)).collect())
    for bad in (lambda: grids.pansharpen(ms, ["id"], ["a", "b"], "ihs"), lambda: grids.pansharpen(ms, ["id"], ["a"], "wavelet", (3, 4)), lambda: grids.pansharpen(ms, ["id"], ["a"], "nope")):
        with pytest.raises(ValueError):
            bad()
    blocks = tiles.blocks_with_halo(px, ["id"], 3, 1)
    assert blocks.count() == 4 and blocks.where("size(data) = n_rows * n_cols").count() == 4


def test_sources_and_stack(spark, tmp_path):
    from datetime import datetime

    paths = spark.createDataFrame([("/a/budapest_20260503T101112.tif",), ("/a/none.tif",)], "path string")
    got = paths.select(bands.timestamp_from_path(F.col("path"), F.lit(datetime(2020, 1, 1))).alias("t")).collect()
    assert [r["t"] for r in got] == [datetime(2026, 5, 3, 10, 11, 12), datetime(2020, 1, 1)]
    cfg = catalog.SearchConfig(end=datetime(2024, 3, 1))
    assert cfg.resolved_start() == datetime(2024, 1, 31)
    px = spark.createDataFrame([("s1", "red", 0, 0, 1.0), ("s1", "nir", 0, 0, None), ("s2", "B04", 0, 0, 2.0), ("s3", "red", 0, 0, 3.0)], "scene_id string, band string, row int, col int, value double")
    store.write_pixels(px, str(tmp_path / "px"))
    back = store.read_pixels(spark, str(tmp_path / "px"), ["red"])
    assert sorted(r["value"] for r in back.collect()) == [1.0, 2.0, 3.0] and {r["band"] for r in back.collect()} == {"B04"}
    scenes = spark.createDataFrame([("s1", datetime(2024, 1, 2), 64, 64), ("s2", datetime(2024, 1, 1), 64, 64), ("s3", datetime(2024, 1, 3), 64, 64)], "scene_id string, ts timestamp, n_rows int, n_cols int")
    scl = spark.createDataFrame([("s3", 8), ("s3", 4)], "scene_id string, scl int")
    side = spark.createDataFrame([("s2", '{"cloud_ratio": 0.05}'), ("s1", "{broken")], "scene_id string, text string")
    reports = store.parse_reports(side, "text").select("scene_id", "report.*")
    stack = stack_timeseries(scenes, px, StackConfig(fill_rejected=True), sidecars=reports, scl=scl)
    state = {r["scene_id"]: (r["accepted"], r["report_source"], r["reject_reason"]) for r in stack.scenes.collect()}
    assert state["s2"] == (True, "sidecar_json", "") and state["s3"] == (False, "scl_computed", "cloud 50.0% > 30.0%") and state["s1"][0]
    got = sorted((r["t_idx"], r["scene_id"], r["band"], r["value"]) for r in stack.pixels.where("value IS NOT NULL").collect())
    assert got == [(0, "s2", "B04", 2.0), (1, "s1", "B04", 1.0)]
    assert stack.pixels.where("scene_id = 's3' AND value IS NULL").count() == 2
    need = stack_timeseries(scenes, px, StackConfig(require_bands=("nir",)))
    assert {r["scene_id"]: r["reject_reason"] for r in need.scenes.collect()} == {"s1": "", "s2": "missing bands: ['B08']", "s3": "missing bands: ['B08']"}
    assert one(need.counts())["n_rejected"] == 2 and need.summary().count() == 3
    need.save(str(tmp_path / "stack"), "ts")
    with pytest.raises(ValueError):
        need.save(str(tmp_path), "nope")
    st = stats.dataset_stats(px)
    store.save_stats(st, str(tmp_path / "st"))
    assert sorted(map(tuple, store.load_stats(spark, str(tmp_path / "st")).collect()), key=str) == sorted(map(tuple, st.collect()), key=str)
    with pytest.raises(ValueError):
        plots.grid_frame([])


def test_streams(spark, tmp_path):
    from datetime import datetime

    px = spark.createDataFrame([("s1", datetime(2024, 1, d), "red", float(d)) for d in range(1, 6)], "scene_id string, ts timestamp, band string, value double")
    px.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(px.schema).parquet(str(tmp_path / "in"))
    q = live.running_stats(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert one(spark.table("running"))["mean"] == 3.0
    q = live.windowed_stats(stream).writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").count() == 2
    scenes = spark.createDataFrame([("s1", datetime(2024, 1, 1), 64, 64)], "scene_id string, ts timestamp, n_rows int, n_cols int")
    scenes.write.parquet(str(tmp_path / "scenes"))
    pixels = spark.createDataFrame([("s1", "red", 0, 0, 1.0), ("s9", "red", 0, 0, 1.0)], "scene_id string, band string, row int, col int, value double")
    q = live.append_accepted(spark.readStream.schema(scenes.schema).parquet(str(tmp_path / "scenes")), pixels, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    s = live.activity(px, ["scene_id"], gap="30 hours").collect()
    assert len(s) == 1 and s[0]["n"] == 5


def test_stack_errors_and_alignment(spark):
    from datetime import datetime

    grid = "scene_id string, ts timestamp, n_rows int, n_cols int, x0 double, y0 double, dx double, dy double"
    two = spark.createDataFrame([("a", datetime(2024, 1, 1), 40, 40, 0.0, 0.0, 1.0, -1.0), ("b", datetime(2024, 1, 2), 80, 80, -0.25, 0.25, 0.5, -0.5)], grid)
    px = spark.createDataFrame([(s, "red", r, c, float(100 * r + c)) for s, n in (("a", 40), ("b", 80)) for r in range(n) for c in range(n)], "scene_id string, band string, row int, col int, value double")
    with pytest.raises(ValueError, match="inconsistent shapes"):
        stack_timeseries(two, px, StackConfig(align=False))
    with pytest.raises(ValueError, match="inconsistent shapes"):
        stack_timeseries(two.drop("x0"), px)
    with pytest.raises(ValueError, match="no scene passed"):
        stack_timeseries(two, px, StackConfig(min_confidence=2.0))
    with pytest.raises(ValueError, match="no reference"):
        stack_timeseries(two, px, StackConfig(reference="z"))
    out = {(r["scene_id"], r["row"], r["col"]): r["value"] for r in stack_timeseries(two, px).pixels.collect()}
    assert len(out) == 3200 and out["a", 3, 4] == 304 and out["b", 0, 0] == 101  # halves go away from zero
    assert all(out["b", r, c] == 100 * min(79, 2 * r + 1) + min(79, 2 * c + 1) for r in range(40) for c in range(40))
    finer = stack_timeseries(two, px, StackConfig(reference="b")).pixels.where("scene_id = 'a'")
    assert finer.count() == 6400
    scl = spark.createDataFrame([("a", 4), ("b", 4)], "scene_id string, scl int")
    small = two.withColumn("n_rows", F.lit(8)).withColumn("n_cols", F.lit(8))
    state = {r["scene_id"]: (r["accepted"], r["reject_reason"]) for r in stack_timeseries(small, px.where("row < 8 AND col < 8"), StackConfig(align=False), scl=scl.where("scene_id = 'a'")).scenes.collect()}
    assert state == {"a": (False, "dimension check failed"), "b": (True, "")}
    passes = stack_timeseries(small, px, StackConfig(align=False), scl=scl, unreadable=scl.select("scene_id")).scenes.collect()
    assert {(r["accepted"], r["report_source"]) for r in passes} == {(True, "scl_computed")}


def test_raster_files(spark, tmp_path):
    import struct
    import zlib

    rng = np.random.default_rng(9)
    for kind in ("uint8", "int16", "uint16", "float32", "float64"):
        x = (rng.random((3, 70, 41)) * 100).astype(kind)
        back = tiff.decode(tiff.encode(x, (19.0, 47.5, 0.01, -0.01), -1.0))
        assert back.data.dtype == kind and (back.data == x).all() and back.nodata == -1.0 and np.allclose(back.grid, (19.0, 47.5, 0.01, -0.01))
    # By hand: big-endian, tiles of 16 x 16 with horizontal differences, two interleaved bands.
    x = rng.integers(0, 60000, (20, 18, 2)).astype(">u2")
    padded = np.zeros((32, 32, 2), ">u2")
    padded[:20, :18] = x
    chunks = []
    for r in (0, 16):
        for c in (0, 16):
            block = padded[r : r + 16, c : c + 16].astype(np.uint16)
            block[:, 1:] -= block[:, :-1].copy()
            chunks.append(zlib.compress(block.astype(">u2").tobytes()))
    body, at = b"", []
    for c in chunks:
        at.append(8 + len(body))
        body += c
    body += b"\0" * (len(body) % 2)
    entry = 8 + len(body)
    more = struct.pack(">4I", *at) + struct.pack(">4I", *map(len, chunks))
    place = entry + 2 + 12 * 11 + 4
    short = lambda tag, *v: struct.pack(">HHI", tag, 3, len(v)) + struct.pack(f">{len(v)}H", *v).ljust(4, b"\0")
    tags = [short(256, 18), short(257, 20), short(258, 16, 16), short(259, 8), short(277, 2), short(284, 1), short(317, 2), short(322, 16), short(323, 16), struct.pack(">HHII", 324, 4, 4, place), struct.pack(">HHII", 325, 4, 4, place + 16)]
    raw = b"MM" + struct.pack(">HI", 42, entry) + body + struct.pack(">H", 11) + b"".join(tags) + struct.pack(">I", 0) + more
    assert (tiff.decode(raw).data == x.transpose(2, 0, 1)).all()
    for bad in (b"", b"II*\0", raw[:40]):
        with pytest.raises(Exception):
            tiff.decode(bad)

    rows = [("site_20240131T101112", [1.0, None, 3.0, 4.0, 5.0, 6.0], 2, 3, 19.0, 47.5, 0.1, -0.1), ("other", [7.0] * 4, 2, 2, None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, data array<double>, n_rows int, n_cols int, x0 double, y0 double, dx double, dy double")
    tiff.write_rasters(df, str(tmp_path / "r"))
    (tmp_path / "r" / "broken.tif").write_bytes(b"nothing")
    back = tiff.read_rasters(spark, f"file://{tmp_path}/r", ["red"])
    got = {(r["scene_id"], r["row"], r["col"]): (r["band"], r["value"]) for r in back.where("error IS NULL").collect()}
    assert len(got) == 10 and got["site_20240131T101112", 0, 1] == ("red", None) and got["site_20240131T101112", 1, 2] == ("red", 6.0)
    one_scene = one(back.where("scene_id LIKE 'site%'").select("ts", "x0", "dy", "n_cols").distinct())
    assert str(one_scene["ts"]) == "2024-01-31 10:11:12" and one_scene["x0"] == 19.0 and math.isclose(one_scene["dy"], -0.1) and one_scene["n_cols"] == 3
    assert "no TIFF" in one(back.where("error IS NOT NULL"))["error"]


def test_points_in_reference_systems():
    x, y = quality.utm(3.0, 45.0, 31)
    assert math.isclose(x, 500000, abs_tol=1e-6) and math.isclose(y, 4982950.400, abs_tol=2e-3)
    x, y = quality.utm(0.0, 0.0, 31)
    assert math.isclose(x, 166021.443, abs_tol=2e-3) and abs(y) < 1e-6
    assert quality.utm(3.0, -45.0, 31, True)[1] == 10_000_000 - quality.utm(3.0, 45.0, 31)[1]
    assert quality.native_point(19.0, 47.5) == quality.native_point(19.0, 47.5, 4326) == (19.0, 47.5)
    assert quality.native_point(3.0, 45.0, 32631) == quality.utm(3.0, 45.0, 31)


def test_kernels_take_nulls_and_check_shapes(spark):
    schema = "id int, data array<double>, n_rows int, n_cols int"
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0], 2, 2), (1, None, 2, 2), (2, None, None, None)], schema)
    out = {r["id"]: r["data"] for r in tiles.map_tiles(df, lambda x: x + 1).collect()}
    assert out == {0: [2.0, 3.0, 4.0, 5.0], 1: None, 2: None}
    with pytest.raises(Exception, match="no tile of 2 x 2"):
        tiles.map_tiles(spark.createDataFrame([(0, [1.0], 2, 2)], schema), lambda x: x).collect()
    series_ = spark.createDataFrame([(0, [1.0, None, 3.0]), (1, None), (2, [])], "id int, values array<double>")
    assert {r["id"]: r["filled"] for r in gapfill.interpolate_gaps(series_).collect()} == {0: [1.0, 2.0, 3.0], 1: None, 2: []}
    px = spark.createDataFrame([(0, 0, 1, 5.0), (0, 1, 0, 6.0), (0, 9, 9, 1.0)], "id int, row int, col int, value double")
    assert one(tiles.to_tiles(px, ["id"], 2, 2))["data"] == [None, 5.0, 6.0, None]
    block = one(tiles.blocks_with_halo(px.where("row < 2"), ["id"], 4, 1))
    assert block["data"] == [None, 5.0, 6.0, None] and (block["n_rows"], block["n_cols"]) == (2, 2)


def test_names_of_working_columns_do_not_clash(spark):
    df = series(spark, [1, None, 3, 4, 9]).withColumns({"_q": F.lit("x"), "_in": F.lit("x"), "_gap": F.lit("x"), "_t": F.lit("x"), "_a": F.lit("x"), "_b": F.lit("x"), "_mean": F.lit("x"), "_lo": F.lit("x"), "_k_p": F.lit("x"), "band": F.lit("r"), "row": F.lit(0), "col": F.col("t")})
    assert frames.fresh(df, "q", "Q", "new") == ["__q", "___Q", "_new"]
    for out in (stats.pixel_iqr(df, ["p"]), gapfill.fill_linear(df, ["p"], "t"), stats.anomaly_zscore(df, ["p"], window_days=400), scaling.minmax_band(df, ["p"]), scaling.percentile_stretch(df, ["p"]), scaling.normalize_for_dl(df, "zscore", ["p"])):
        assert out.count() == 5 and {r["_q"] for r in out.collect()} == {"x"} and set(df.columns) <= set(out.columns)
    assert one(stats.temporal_gap_stats(df, ["p"]))["max_gap"] == 32.0 and one(stats.time_window_stats(df, ["p"], window_days=400))["mean"] == 4.25
    assert grids.bilinear_upsample(df.withColumn("_a", F.lit(1)), ["p"], (1, 5), (1, 9)).count() == 9


def test_exact_percentiles_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(frames, "ACCURACY", 20)
    rng = np.random.default_rng(11)
    rows = [("a", float(x)) for x in rng.normal(size=3000)] + [("b", float(int(x * 3))) for x in rng.normal(size=2500)] + [("c", 1.0), ("c", 2.0), (None, 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(5)
    shares = [0.0, 0.02, 0.5, 0.777, 0.98, 1.0]
    got = {r["k"]: r["percentiles"] for r in frames.exact_percentiles(df, ["k"], "value", shares).collect()}
    for k in ("a", "b", "c", None):
        assert np.allclose(got[k], np.quantile([v for x, v in rows if x == k], shares)), k
    assert set(got) == {"a", "b", "c", None}


def test_trends_of_long_series(monkeypatch):
    rng = np.random.default_rng(12)
    x, y = np.sort(rng.choice(10_000, 301, replace=False)).astype(float)[None], rng.normal(size=(1, 301)).cumsum(1).round(1)
    whole = trends._theil_sen(x, y)
    monkeypatch.setattr(trends, "PAIRS", 1000)
    assert math.isclose(trends._theil_sen(x, y)["slope"][0], whole["slope"][0])
    i, j = np.triu_indices(301, 1)
    assert math.isclose(whole["slope"][0], np.median((y[0, j] - y[0, i]) / (x[0, j] - x[0, i])))
    mk = trends._mann_kendall(x, y)
    assert mk["S"][0] == np.sign(y[0, j] - y[0, i]).sum()
    same = trends._theil_sen(np.ones((2, 3)), np.array([[1.0, 2, 3], [4, 4, 4]]))
    assert same["slope"].tolist() == [0, 0] and same["intercept"].tolist() == [2, 4]


def test_bands_by_name_and_number(spark, tmp_path):
    px = spark.createDataFrame([("B04", 1.0), ("B08", 2.0)], "band string, value double")
    value = lambda which: one(store.pick_band(px, which, ["red", "nir"]))["value"]
    assert value("red") == value("B04") == value(0) == value("0") == 1.0 and value(1) == value("nir") == value(-1) == 2.0
    for bad in (None, 5, "x"):
        with pytest.raises(ValueError):
            store.pick_band(px, bad, ["red", "nir"])
    assert one(store.pick_band(px.where("band = 'B04'"), None, ["red"]))["value"] == 1.0
    with pytest.raises(FileNotFoundError):
        store.load_stats(spark, str(tmp_path / "none"))


def test_scenes_without_layers_and_sharpening_that_cannot_be(spark, tmp_path):
    items = spark.createDataFrame([(1, False, None, None, None)], "item_id int, has_scl boolean, shape_rows int, shape_cols int, scl_error string")
    none = spark.createDataFrame([], "item_id int, row int, col int, scl int")
    px = spark.createDataFrame([(1, "red", r, c, float(r + c)) for r in range(3) for c in range(3)], "item_id int, band string, row int, col int, value double")
    no_grid = spark.createDataFrame([], "item_id int, band string, n_rows int, n_cols int, x0 double, y0 double, dx double, dy double")
    pan = spark.createDataFrame([(1, r, c, 1.0) for r in range(3) for c in range(3)], "item_id int, row int, col int, value double")
    cfg = scene_plans.SceneConfig(bands=("B04", "B08"), sharpen="ihs", ms_shape=(3, 3), pan_shape=(3, 3))
    out = scene_plans.materialise_scenes(items, px, no_grid, none, cfg, pan)
    report = one(out.reports)
    assert report["written"] and report["missing"] == ["B08"] and report["warning"] == quality.NO_CLASSES
    assert sorted((r["row"], r["col"], r["value"]) for r in out.spectral.collect()) == sorted((r, c, float(r + c)) for r in range(3) for c in range(3))
    out.write(str(tmp_path / "scenes"))
    assert spark.read.parquet(str(tmp_path / "scenes/spectral")).count() == 9
    empty = scene_plans.materialise_scenes(items.limit(0), px, no_grid, none, cfg)
    assert empty.reports.count() == 0 and empty.spectral.count() == 0


def test_gate_rounds_percentages_as_printf(spark):
    shares = sorted({k / n for n in range(60, 161, 20) for k in range(n // 5 + 1, n)})
    m = spark.createDataFrame([(i, x, 0.0) for i, x in enumerate(shares)] + [(-1 - i, 0.0, x) for i, x in enumerate(shares)], "scene_id long, cloud_ratio double, snow_ratio double")
    got = {r[0]: r[1] for r in quality.scene_gate(m.select("scene_id"), m, max_cloud=0.2, max_snow=0.105).select("scene_id", "reject_reason").collect()}
    assert 33 / 80 in shares and "%.1f" % (33 / 80 * 100) == "41.2"
    for i, x in enumerate(shares):
        assert got[i] == "cloud %.1f%% > 20.0%%" % (x * 100) and got[-1 - i] == "snow %.1f%% > 10.5%%" % (x * 100)


def test_stack_log_of_the_sql(spark, tmp_path):
    import duckdb

    from terraframe.plans import queries

    # One scene of 80 pixels, 33 of them cloud, and one of 80 with 3; class 3 and 4 by the remainder of the order.
    cloudy, clear = [next(o for o in range(12) if (o * 7 + 1) % 12 == c) for c in (3, 4)]
    rows = [(12 * i + (cloudy if i < n else clear), 1, s) for s, n in ((4, 33), (8, 3)) for i in range(80)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long").withColumn("l_extendedprice", F.lit(1.0))
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(4,), (8,), (12,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLES["stack_log"]).fetchall())
    assert want == [(4, "scl_computed", "cloud 41.2% > 20.0%", False), (8, "scl_computed", "", True), (12, "none", "", True)]
    assert sorted(map(tuple, queries.QUERIES["stack_log"](spark, str(tmp_path)).collect())) == want


def test_catalog_search_meets_edges_as_its_sql(spark, tmp_path):
    from datetime import datetime

    import duckdb

    from terraframe.plans import queries

    # One item at each edge of the two boxes, or just beside it.
    first = datetime(1994, 1, 1)
    for name, box, lat in (("a", (14, 15, 16, 4, 5, 6, 24, 25, 26), 40), ("b", (64, 65, 66, 54, 55, 56, 74, 75, 76), 80), ("c", (20,) * 9, 0)):
        rows = [(i * 100 + (lat or (24, 25, 26, 35, 40, 44, 45, 46, 50)[i]), c, first) for i, c in enumerate(box)]
        where = tmp_path / name
        spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(str(where / "orders.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW orders AS SELECT * FROM '{where}/orders.parquet/*.parquet'")
        want = sorted(con.execute(queries.ORACLES["catalog_search"]).fetchall())
        assert sorted(map(tuple, queries.QUERIES["catalog_search"](spark, str(where)).collect())) == want and 0 < len(want) < 9


def test_phenology_metrics_of_the_sql(spark, tmp_path):
    """Values in tenths, so that many peaks, thresholds and halves of the last digit are met but for the last bit of sums."""
    from datetime import datetime, timedelta

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from terraframe.plans import queries

    rng, first = np.random.default_rng(8), datetime(2024, 1, 1)
    n = 132_000
    at = np.sort(rng.integers(0, 30 * 86400, n))
    events = pa.table({"event_id": np.arange(n), "ts": pa.array([first + timedelta(seconds=int(x)) for x in at], pa.timestamp("us")), "user_id": rng.integers(0, 2000, n), "value": rng.integers(1, 13, n) / 10})
    (tmp_path / "other" / "events.parquet").mkdir(parents=True)
    pq.write_table(events, tmp_path / "events.parquet")
    for k in range(3):
        pq.write_table(events.take(np.arange(n)[::-1][k::3]), tmp_path / "other" / "events.parquet" / f"{k}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(con.execute(queries.ORACLES["phenology_metrics"]).fetchall(), key=lambda r: r[0])
    for where in (tmp_path, tmp_path / "other"):
        got = sorted(map(tuple, queries.QUERIES["phenology_metrics"](spark, str(where)).collect()))
        assert [(g, w) for g, w in zip(got, want, strict=True) if g != w] == []


def test_scaled_rounding(spark):
    from terraframe.plans import queries

    x = [27.193749999999998, 7.293749999999999, 1.6437499999999998, 0.06624999999999975, -2.00005, None]
    got = queries.rounded_scaled(spark.createDataFrame(list(enumerate(x)), "i int, x double"), 4).orderBy("i").collect()
    assert [r["x"] for r in got] == [27.1938, 7.2938, 1.6438, 0.0662, -2.0001, None]


def test_stack_log_of_odd_scenes_as_its_sql(spark, tmp_path):
    import duckdb

    from terraframe.plans import queries

    # Classes by the order's remainder, as above. First a supplier without a key, and lines without one; then nothing but cloud, and a large key.
    cloudy, clear = [next(o for o in range(12) if (o * 7 + 1) % 12 == c) for c in (3, 4)]
    lines = [(cloudy, 1, 4), (clear, 1, 8), (clear, 1, None), (None, 1, 12), (clear, None, 12)]
    for name, suppliers, n in (("keys", [4, 8, 12, 16, None], 4), ("rejected", [4], 1), ("large", [8, 3_000_000_004], 2)):
        where = tmp_path / name
        spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long").withColumn("l_extendedprice", F.lit(1.0)).write.parquet(str(where / "lineitem.parquet"))
        spark.createDataFrame([(x,) for x in suppliers], "s_suppkey long").write.parquet(str(where / "supplier.parquet"))
        con = duckdb.connect()
        for t in ("lineitem", "supplier"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet/*.parquet'")
        want = sorted(con.execute(queries.ORACLES["stack_log"]).fetchall())
        assert len(want) == n and sorted(map(tuple, queries.QUERIES["stack_log"](spark, str(where)).collect()), key=str) == sorted(want, key=str)
