"""Reading and writing pixels, scenes, reports and statistics.

Pixels are Parquet by band, sorted inside, so that a filter on band prunes folders and one on scene, row or
column prunes row groups. Missing values are NULL inside and -9999 only where a writer is asked for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scaling import from_nodata, to_nodata
from ..functions.spectral import ALIASES

REPORT = "passed BOOLEAN, cloud_ratio DOUBLE, snow_ratio DOUBLE, confidence_score DOUBLE, dimension_pass BOOLEAN, radiometry_pass BOOLEAN, issues ARRAY<STRING>"
STATS = "band STRING, mean DOUBLE, std DOUBLE, min DOUBLE, max DOUBLE, n_pixels BIGINT"


def ingest(df: DataFrame, value: str = "value", nodata: float = -9999.0) -> DataFrame:
    return df.withColumn(value, from_nodata(F.col(value), nodata))


def canonical(df: DataFrame, band: str = "band", keep_unknown: bool = True) -> DataFrame:
    """Bands by their canonical names; others stay, or go."""
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    known = names[F.col(band)]
    return df.withColumn(band, F.coalesce(known, F.col(band)) if keep_unknown else known).where(F.lit(True) if keep_unknown else F.col(band).isNotNull())


def select_bands(df: DataFrame, wanted: list[str], band: str = "band") -> DataFrame:
    """Rows of the wanted bands, by any of their names; the filter reaches the scan."""
    own = {ALIASES.get(b, b) for b in wanted}
    spelled = sorted({a for a, c in ALIASES.items() if c in own} | own)
    return canonical(df.where(F.col(band).isin(*spelled)), band)


def pick_band(df: DataFrame, which: str | int | None, order: list[str], band: str = "band") -> DataFrame:
    """One band of several: by any of its names, by its number in ``order`` (also as text), or the only one."""
    if which is None:
        if len(order) != 1:
            raise ValueError(f"which of {order}?")
        return select_bands(df, order, band)
    if isinstance(which, str) and (which in order or which in ALIASES):
        return select_bands(df, [which], band)
    try:
        return select_bands(df, [order[int(which)]], band)
    except (ValueError, IndexError) as exc:
        raise ValueError(f"no band {which!r} in {order}") from exc


def wide(df: DataFrame, keys: list[str], bands: list[str], band: str = "band", value: str = "value") -> DataFrame:
    """One column for each band: pixels joined on their position by one aggregation."""
    return df.groupBy(*keys).pivot(band, bands).agg(F.first(value))


def read_pixels(spark: SparkSession, path: str, bands: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return select_bands(df, bands) if bands else df


def write_pixels(df: DataFrame, path: str, mode: str = "errorifexists", nodata: bool = False) -> None:
    out = df.withColumn("value", to_nodata(F.col("value"))) if nodata else df
    order = [c for c in ("scene_id", "row", "col") if c in out.columns]
    out.repartitionByRange("band", *order).sortWithinPartitions("band", *order).write.mode(mode).partitionBy("band").parquet(path)


def write_by(df: DataFrame, path: str, column: str, overwrite: bool = True) -> None:
    """One folder for each value of a column: times of a stack, indices, metrics. Without overwrite, what is there stays."""
    df.write.mode("overwrite" if overwrite else "ignore").partitionBy(column).parquet(path)


def indices_long(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.unpivot([F.col(k) for k in keys], [F.col(n).cast("float").alias(n) for n in names], "index", "value")


def phenology_long(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.unpivot([F.col(k) for k in keys], ["sos", "eos", "pos", "peak_val"], "metric", "value").withColumn("value", to_nodata(F.col("value")))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar reports; what can't be read is NULL."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", REPORT, {"mode": "PERMISSIVE"}).alias("r"))
    return text.select("path", "r.*")


def parse_reports(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("report", F.from_json(column, REPORT, {"mode": "PERMISSIVE"}))


def write_reports(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def save_stats(stats: DataFrame, path: str) -> None:
    stats.select("band", "mean", "std", "min", "max", "n_pixels").coalesce(1).write.mode("overwrite").json(path)  # a row for each band


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics that were saved; a path that does not exist raises FileNotFoundError."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    return spark.read.schema(STATS).json(path)
