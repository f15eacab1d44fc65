"""Views of the driver's tables as rasters and series, in Spark and, word for word the same, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pixel, day, t, v): observations of a pixel; one in seven lines counts as missing."""
    li = table(spark, sf_dir, "lineitem")
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("double")
    g = li.groupBy(F.col("l_partkey").alias("pixel"), day.alias("day")).agg(
        F.avg(F.when(F.col("l_linenumber") % 7 != 3, F.col("l_extendedprice"))).alias("v"), F.avg("l_quantity").alias("u")
    )
    return g.withColumn("t", F.row_number().over(W.partitionBy("pixel").orderBy("day")))


OBS = """obs AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY day) AS t FROM (
  SELECT l_partkey AS pixel, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::DOUBLE AS day,
         avg(CASE WHEN l_linenumber % 7 <> 3 THEN l_extendedprice END) AS v, avg(l_quantity) AS u FROM lineitem GROUP BY 1, 2)),
val AS (SELECT * FROM obs WHERE v IS NOT NULL)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pixel with a column for each band."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_discount").alias("blue"), F.col("l_tax").alias("green"), F.col("l_quantity").alias("red"), (F.col("l_extendedprice") / 1000).alias("nir"),
        (F.col("l_quantity") * 0.5 + F.col("l_tax") * 10).alias("swir16"), (F.col("l_extendedprice") / 2000).alias("swir22"),
    )


WIDE = """wide AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_discount AS blue, l_tax AS green, l_quantity AS red, l_extendedprice / 1000 AS nir,
  l_quantity * 0.5 + l_tax * 10 AS swir16, l_extendedprice / 2000 AS swir22 FROM lineitem)"""


def scl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, scl): classes of a scene's pixels; scenes differ in how cloudy they are."""
    li = table(spark, sf_dir, "lineitem")
    c = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 12
    return li.select(F.col("l_suppkey").alias("scene_id"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.when((c.isin(3, 8, 9, 10)) & (F.col("l_suppkey") % 4 > 0) & (F.col("l_orderkey") % (F.col("l_suppkey") % 4 + 1) > 0), 4).otherwise(c).cast("int").alias("scl"))


SCL = """scl AS (SELECT l_suppkey AS scene_id, l_orderkey AS row, l_linenumber AS col, (CASE WHEN c IN (3, 8, 9, 10) AND l_suppkey % 4 > 0 AND l_orderkey % (l_suppkey % 4 + 1) > 0 THEN 4 ELSE c END)::INT AS scl
  FROM (SELECT *, (l_orderkey * 7 + l_linenumber) % 12 AS c FROM lineitem))"""


def patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as tiles of 8 x 8."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("data"), F.lit(8).alias("n_rows"), F.lit(8).alias("n_cols"))


PATCH = "patch AS (SELECT vec_id, i // 8 AS row, i % 8 AS col, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i))"


def neighbours(radius: int) -> str:
    """Each pixel of a patch with its window, edges repeated."""
    return f"""{PATCH}, nb AS (SELECT p.vec_id, p.row, p.col, p.v AS c, a AS dr, b AS dc, n.v
  FROM patch p, range(-{radius}, {radius + 1}) x(a), range(-{radius}, {radius + 1}) y(b), patch n
  WHERE n.vec_id = p.vec_id AND n.row = greatest(0, least(7, p.row + a)) AND n.col = greatest(0, least(7, p.col + b)))"""


def series(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """(user_id, t, v): daily sums of a user's events over all days; a day without any is a gap. ordered: events are dealt
    by their sums and added in the order of their numbers, so that sums do not hang, in their last bit, on how files are split."""
    e = table(spark, sf_dir, "events")
    span = e.agg(F.to_date(F.min("ts")).alias("d0"), F.datediff(F.max("ts"), F.min("ts")).alias("days"))  # one row
    dated = e.crossJoin(F.broadcast(span)).select("user_id", F.datediff("ts", "d0").alias("t"), "event_id", "value")
    if ordered:
        dated = dated.repartition("user_id", "t").sortWithinPartitions("user_id", "t", "event_id")
    daily = dated.groupBy("user_id", "t").agg(F.sum("value").alias("v"))
    users = daily.select("user_id").distinct().crossJoin(F.broadcast(span))
    grid = users.select("user_id", F.explode(F.sequence(F.lit(0), F.col("days"))).alias("t"))
    return grid.join(daily, ["user_id", "t"], "left")


#: The last day, in SQL over ``series``.
LAST = "(SELECT max(t) FROM series)"
SERIES = """daily AS (SELECT user_id, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) AS t, sum(value) AS v FROM events GROUP BY 1, 2),
days AS (SELECT unnest(range(0, max(t) + 1)) AS t FROM daily),
series AS (SELECT g.user_id, g.t, d.v FROM (SELECT user_id, t FROM (SELECT DISTINCT user_id FROM daily), days) g LEFT JOIN daily d USING (user_id, t)),
nx AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY user_id ORDER BY t) AS ta,
              min(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tb FROM series),
lin AS (SELECT n.user_id, n.t, n.v, coalesce(n.v, a.v + (n.t - n.ta) / (n.tb - n.ta)::DOUBLE * (b.v - a.v), a.v, b.v) AS f
        FROM nx n LEFT JOIN series a ON a.user_id = n.user_id AND a.t = n.ta LEFT JOIN series b ON b.user_id = n.user_id AND b.t = n.tb)"""
