"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_ready(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where that is unset, and everything runs on this machine, one of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + os.path.join(tempfile.gettempdir(), "terraframe-shared")
        spark.sparkContext.setCheckpointDir(known)
    return known


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later jobs, and retries after a lost
    executor, start from that table instead of from the lineage above it. Results read these tables lazily, so
    those a result still reads stay there until whoever owns the folder empties it; ``release`` frees the others."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/terraframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more: all that was made of them is materialized, collected or counted."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.materialized_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hash60(*cols: Column) -> Column:
    """The first 60 bits of an MD5 over the columns as text (null differs from every text), as a long.
    Chosen over xxhash64 because any SQL engine can compute it."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def bits_for(rows: int, per_bucket: int) -> int:
    """Bits of a hash that cut ``rows`` into buckets of about ``per_bucket``."""
    return max(0, math.ceil(math.log2(max(1, rows) / per_bucket))) if rows > per_bucket else 0
