"""Connected components by alternating star contraction, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: A round's table has about as many rows a file, or a file for every core if that is more files.
ROWS_PER_FILE = 250_000


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    rest = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """From (u, v), both of one ordered type: (node, root), root the least node of the component, without the roots themselves."""
    now = materialize(edges.where("u <> v").distinct())
    rows, state = now.count(), None
    while True:
        files = max(edges.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE))
        new = materialize(_small(_large(now)).coalesce(files))
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(now)
        if tuple(seen) == state:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, rows, state = new, seen[0], tuple(seen)
