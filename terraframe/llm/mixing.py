"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Every source has a weight schedule ``w * (1 + slope * (2t - 1))`` over training time t in [0, 1]; its
integral is ``w`` and its cumulative share ``t + slope * (t^2 - t)``. A source's target is its integrated
weight's share of all words, at most ``max_repeats`` times its own size; the excess is shared anew by weight
until no target is above its cap. Targets are met by passes over the source: whole passes, and a last one
over the documents whose middle lies before what is still missing. Each copy's middle in its source's stream
of words is a demand; inverting the cumulative demand gives the time at which it is trained on, and copies
are range-sorted by it.

Order within a source is by a hash of the id, and positions come from prefix sums over hash buckets and then
within one bucket, so a source that holds a third of all rows is spread over many tasks.

Defined results
    * A null or blank text has size 0 and is never taken; it still has its row.
    * A null source is a source of its own, last in order. Null ids are ordinary values.
    * Rows equal in (source, id, size) follow each other in the stream, ordered by a hash of all their columns, so
      reruns agree; rows equal in all of them are interchangeable.
    * An empty table gives an empty result. Extra columns of the input are not read by the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bits_for, hash60, materialize, table

WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (0.5, 0.0, -0.5)
MAX_REPEATS = 3
ROWS_PER_BUCKET = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From (source, source_size): the same with target double and slope double. One row per source.

    The level at which capped and uncapped sources share all words is the largest of the levels that each
    prefix of sources, ordered by cap per weight, would leave for the others."""
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    k = (F.row_number().over(order) - 1).alias("k")
    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    ranked = sizes.withColumn("k", k).select(
        "source", "source_size",
        F.get(lit(weights), F.col("k") % len(weights)).alias("weight"), F.get(lit(slopes), F.col("k") % len(slopes)).alias("slope"),
        (F.lit(max_repeats) * F.col("source_size")).cast("double").alias("cap"),
    )
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    every = W.partitionBy()
    capped = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    level = (F.sum("source_size").over(every) - capped) / left
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max("level").over(every))
        .select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"), "slope")
    )


def mixing_plan(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, max_repeats: int = MAX_REPEATS, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct (source, id, size): source, id, size, n (equal rows), start (of the first of them
    in the source's stream of words), source_size, target, slope."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), size.alias("size"))
    rows = materialize(rows.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("h", hash60(F.col("id"))))
    targets = materialize(source_targets(rows.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, slopes, max_repeats))
    bits = bits_for(rows.count(), ROWS_PER_BUCKET) + 5
    rows = rows.withColumn("bucket", F.shiftright("h", 60 - bits))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    words = F.sum(F.col("n") * F.col("size"))
    buckets = rows.groupBy("source", "bucket").agg(words.alias("words"))
    buckets = buckets.select(
        "source", "bucket", F.coalesce(F.sum("words").over(before(W.partitionBy("source").orderBy("bucket"))), F.lit(0)).alias("bucket_start")
    ).join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    inside = F.coalesce(words.over(before(W.partitionBy("source", "bucket").orderBy("h", "id", "size"))), F.lit(0))
    rows = rows.withColumn("inside", inside)
    joined = rows.join(
        buckets.withColumnsRenamed({"source": "s", "bucket": "b"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    )
    return joined.select("source", "id", "size", "n", "h", (F.col("bucket_start") + F.col("inside")).alias("start"), "source_size", "target", "slope")


def _passes(df: DataFrame) -> DataFrame:
    """From rows with ``start`` of their own: adds passes int, and position of the first pass (null if none)."""
    middle = F.col("start") + F.col("size") / 2
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    last = F.col("target") - whole * F.col("source_size")
    passes = F.when(F.col("size") > 0, whole + F.when(middle < last, 1).otherwise(0)).otherwise(0)
    return df.withColumn("middle", middle).withColumn("passes", passes.cast("int"))


def _position(turn) -> F.Column:
    """The time at which the source's cumulative demand reaches the middle of the copy of pass ``turn``."""
    u = F.least(F.lit(1.0), (F.col("middle") + turn * F.col("source_size")) / F.col("target"))
    a = F.col("slope")
    return 2 * u / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * u))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: source, id, size, source_size, target, passes, taken long, position double."""
    plan = mixing_plan(docs, **kw)
    each = plan.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("start", F.col("start") + F.col("i") * F.col("size"))
    each = _passes(each).withColumn("position", F.when(F.col("passes") > 0, F.round(_position(F.lit(0)), 6)))
    return each.select("source", "id", "size", "source_size", "target", "passes", (F.col("passes") * F.col("size")).cast("long").alias("taken"), "position")


def training_order(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents as they are trained on: each as often as the mix takes it, range-sorted by position."""
    plan = mixing_plan(docs, source_col=source_col, id_col=id_col, text_col=text_col, **kw)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("_s"), F.col(id_col).alias("_d"), size.alias("_z"))
    same = F.col("_s").eqNullSafe(F.col("source")) & F.col("_d").eqNullSafe(F.col("id")) & (F.col("_z") == F.col("size"))
    both = doc.join(plan, same)
    if not plan.where(F.col("n") > 1).isEmpty():  # equal rows follow each other in the stream
        turn = F.row_number().over(W.partitionBy("_s", "_d", "_z").orderBy(F.xxhash64(F.to_json("row")))) - 1
        both = both.withColumn("start", F.col("start") + turn * F.col("size"))
    both = _passes(both).where(F.col("passes") > 0)
    both = both.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    return both.withColumn("position", _position(F.col("pass"))).orderBy("position", "h").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce('v' || doc_id::VARCHAR, 'n')), 1, 15))::BIGINT AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, [5.0, 2.0, 1.0][1 + k % 3]::DOUBLE AS weight, [0.5, 0.0, -0.5][1 + k % 3]::DOUBLE AS slope,
         (3 * source_size)::DOUBLE AS cap
  FROM (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1)::INT AS k FROM src)),
levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
targets AS (SELECT source, source_size, slope, least(cap, max(level) OVER () * weight) AS target FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2 AS middle
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
passes AS (
  SELECT *, CASE WHEN size > 0 THEN floor(target / greatest(source_size, 1))
                + CASE WHEN middle < target - floor(target / greatest(source_size, 1)) * source_size THEN 1 ELSE 0 END ELSE 0 END AS passes,
         CASE WHEN size > 0 THEN least(1.0, middle / target) END AS u
  FROM placed)
SELECT doc_id, size, source_size, target, (passes * size)::BIGINT AS taken,
       CASE WHEN passes > 0 THEN round(2 * u / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)), 6) END AS position
FROM passes
"""
