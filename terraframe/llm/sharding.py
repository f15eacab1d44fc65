"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a document's hash. It starts with one bucket; a bucket whose
texts exceed the byte limit is split on the next bit, others stay. Bucket sizes come from pre-aggregated
hash cells, never from gathering a bucket's documents: each round counts the cells of one more range of
bits, and only cells that are still too large go on to the next round.

Defined results
    * A null text has 0 bytes. Null ids are hashed like any other value.
    * A document larger than the limit gets a shard of its own for each copy, with ``over_limit`` true.
    * Rows that repeat an id share its hash, so no bit separates them. If a bucket at the last bit is still
      too large, it gets overflow shards, filled in order; each stays within the limit.
    * An empty table gives an empty result. Extra columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import hash60, materialize, table

HASH_BITS = 60
LIMIT_BYTES = 1 << 20
#: Levels of the directory that are summed up at once.
LEVELS = 8


def _name(depth: Column, prefix: Column) -> Column:
    return F.concat(F.lit("b"), F.when(depth > 0, F.lpad(F.bin(prefix), depth, F.lit("0"))).otherwise(F.lit("")))


def _directory(cells: DataFrame, depth: int, limit: int) -> DataFrame:
    """For each cell of ``depth`` bits, the least number of bits whose bucket fits; null where none does.

    Buckets are summed up a few levels at a time, each time from the coarsest sums so far, so that cells are
    multiplied by ``LEVELS``, not by their depth."""
    sums, top, best = cells, depth, None
    while True:
        low = max(0, top - LEVELS)
        paths = sums.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(top))).alias("d")).select("cell", "bytes", "d", F.expr(f"shiftright(cell, {top} - d)").alias("prefix"))
        buckets = paths.groupBy("d", "prefix").agg(F.sum("bytes").alias("bucket_bytes"))
        fits = buckets.where(F.col("bucket_bytes") <= limit)
        found = paths.join(fits, ["d", "prefix"]).groupBy("cell").agg(F.min("d").alias("local_depth"))
        if best is None:
            best = cells.select("cell").join(found, "cell", "left")
        else:  # a coarser bucket that fits is preferred to the finer ones in it
            coarser = found.select(F.col("cell").alias("upper"), F.col("local_depth").alias("coarse"))
            best = best.withColumn("upper", F.expr(f"shiftright(cell, {depth - top})")).join(coarser, "upper", "left").select("cell", F.coalesce("coarse", "local_depth").alias("local_depth"))
        if low == 0:
            return best
        sums = materialize(buckets.where(F.col("d") == low).select(F.col("prefix").alias("cell"), F.col("bucket_bytes").alias("bytes")))
        # Where no sum is within the limit, no coarser one is.
        if sums.where(F.col("bytes") <= limit).isEmpty():
            return best
        top = low


def assign_shards(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_bytes long, shard string, depth int, over_limit boolean."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), size.alias("n_bytes"))
    # Equal rows become one with a count, so that an id which holds much of the input is one row.
    rows = rows.groupBy("id", "n_bytes").agg(F.count(F.lit(1)).alias("n")).withColumn("h", hash60(F.col("id")))
    rows = materialize(rows)
    total, most = rows.agg(F.sum(F.col("n") * F.col("n_bytes")), F.max("n_bytes")).first()
    total = total or 0

    large = rows.where(F.col("n_bytes") > limit_bytes)
    pending = rows.where(F.col("n_bytes") <= limit_bytes)
    done = []
    depth = min(HASH_BITS, max(1, math.ceil(math.log2(max(2, total) / limit_bytes)) + 4 if total > limit_bytes else 1))
    while True:
        cell = F.shiftright("h", HASH_BITS - depth).alias("cell")
        cells = pending.groupBy(cell).agg(F.sum(F.col("n") * F.col("n_bytes")).alias("bytes"))
        directory = materialize(_directory(cells, depth, limit_bytes))
        placed = pending.withColumn("cell", cell).join(directory, "cell")
        done.append(
            placed.where(F.col("local_depth").isNotNull()).select(
                "id", "n_bytes", "n", _name(F.col("local_depth"), F.expr(f"shiftright(h, {HASH_BITS} - local_depth)")).alias("shard"), F.col("local_depth").alias("depth")
            )
        )
        if directory.where(F.col("local_depth").isNull()).isEmpty():
            rest = None
            break
        rest = placed.where(F.col("local_depth").isNull()).drop("cell", "local_depth")
        if depth == HASH_BITS:
            break
        pending = materialize(rest)
        depth = min(HASH_BITS, depth + 8)

    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.select("id", "n_bytes", "shard", "depth", copies).select("id", "n_bytes", "shard", "depth", F.lit(False).alias("over_limit"))
    if most is not None and most > limit_bytes:
        alone = large.select("id", "n_bytes", "h", copies).select(
            "id", "n_bytes", F.concat(F.lit("d"), F.lpad(F.bin("h"), HASH_BITS, F.lit("0")), F.lit("-"), F.col("n_bytes").cast("string"), F.lit("-"), F.col("i").cast("string")).alias("shard"),
            F.lit(HASH_BITS).alias("depth"), F.lit(True).alias("over_limit"),
        )
        out = out.unionByName(alone)
    if rest is not None:
        # Distinct (id, size) pairs of one 60-bit hash: few, whatever the number of copies.
        bucket = W.partitionBy("h")
        before = bucket.orderBy("id", "n_bytes").rowsBetween(W.unboundedPreceding, -1)
        step = F.greatest(F.lit(1), F.lit(limit_bytes) - F.max("n_bytes").over(bucket))
        chained = rest.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("n_bytes")).over(before), F.lit(0))).withColumn("step", step)
        out = out.unionByName(
            chained.select("id", "n_bytes", "h", "start", "step", copies).select(
                "id", "n_bytes", F.concat(F.lit("b"), F.lpad(F.bin("h"), HASH_BITS, F.lit("0")), F.lit("-"), F.expr("(start + (i - 1) * n_bytes) div step").cast("string")).alias("shard"),
                F.lit(HASH_BITS).alias("depth"), F.lit(False).alias("over_limit"),
            )
        )
    return out.withColumnRenamed("id", id_col)


def write_shards(docs: DataFrame, assignment: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write each document into its shard's folder. Ids must be unique in ``docs``."""
    placed = docs.join(assignment.select(id_col, "shard"), id_col)
    placed.repartition("shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce('v' || doc_id::VARCHAR, 'n')), 1, 15))::BIGINT AS h
  FROM documents),
small AS (SELECT * FROM docs WHERE n_bytes <= {LIMIT_BYTES}),
paths AS (SELECT d, h >> ({HASH_BITS} - d) AS prefix, sum(n_bytes) AS bytes
          FROM small, range(0, {HASH_BITS} + 1) t(d) GROUP BY ALL),
leaf AS (SELECT s.doc_id, s.n_bytes, s.h, min(d) AS depth
         FROM small s, range(0, {HASH_BITS} + 1) t(d)
         JOIN paths p USING (d)
         WHERE p.prefix = s.h >> ({HASH_BITS} - d) AND p.bytes <= {LIMIT_BYTES}
         GROUP BY s.doc_id, s.n_bytes, s.h)
SELECT doc_id, n_bytes,
       'b' || CASE WHEN depth > 0 THEN lpad(bin(h >> ({HASH_BITS} - depth)), depth::INT, '0') ELSE '' END AS shard,
       depth::INT AS depth, false AS over_limit
FROM leaf
UNION ALL
SELECT doc_id, n_bytes,
       'd' || lpad(bin(h), {HASH_BITS}, '0') || '-' || n_bytes || '-' || row_number() OVER (PARTITION BY doc_id, n_bytes),
       {HASH_BITS}, true
FROM docs WHERE n_bytes > {LIMIT_BYTES}
"""
