"""A made-up stack: monthly vegetation indices with a season, noise, and some times that are missing altogether."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIMES, SIDE, MISSING = 24, 32, (4, 10, 16)


def _uniform(*parts: Column) -> Column:
    """Between 0 and 1, neither included, by a hash: the same in every run and on every cluster."""
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 32)


def _normal(*parts: Column) -> Column:
    return F.sqrt(-2 * F.log(_uniform(F.lit("a"), *parts))) * F.cos(2 * math.pi * _uniform(F.lit("b"), *parts))


def synthetic_stack(spark: SparkSession, times: int = TIMES, side: int = SIDE, missing: tuple[int, ...] = MISSING, first_year: int = 2023) -> DataFrame:
    """(t_idx, ts, band, row, col, x, y, value): bands ndvi and evi, NULL at the missing times."""
    t, r, c = F.col("t_idx"), F.col("row"), F.col("col")
    cells = spark.range(times * side * side).select((F.col("id") / (side * side)).cast("int").alias("t_idx"), (F.col("id") / side).cast("long").alias("q"), (F.col("id") % side).cast("int").alias("col"))
    cells = cells.withColumn("row", (F.col("q") % side).cast("int")).drop("q")
    base = 0.3 + 0.45 * F.pow(F.sin(math.pi * (t % 12) / 11), F.lit(2.0))
    clip = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    cells = cells.withColumn("ndvi", clip(base + 0.03 * _normal(F.lit("ndvi"), t, r, c), 0.05, 0.9))
    cells = cells.withColumn("evi", clip(F.col("ndvi") * 0.8 + 0.02 * _normal(F.lit("evi"), t, r, c), 0.02, 0.7))
    ts = F.make_timestamp_ntz(F.lit(first_year) + (t / 12).cast("int"), t % 12 + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    at = lambda lo, hi, k: lo + (hi - lo) * k / (side - 1)
    cells = cells.select("t_idx", ts.alias("ts"), "row", "col", at(19.0, 19.1, c).alias("x"), at(47.44, 47.54, r).alias("y"), *[F.when(~t.isin(*missing), F.col(b)).alias(b) for b in ("ndvi", "evi")])
    return cells.unpivot(["t_idx", "ts", "row", "col", "x", "y"], ["ndvi", "evi"], "band", "value").select("t_idx", "ts", "band", "row", "col", "x", "y", "value")
