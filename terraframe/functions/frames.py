"""Working columns and statistics of groups that are joined back to their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has, whatever their case."""
    known, out = {c.lower() for c in df.columns}, []
    for name in names:
        own = f"_{name}"
        while own.lower() in known:
            own = f"_{own}"
        known.add(own.lower())
        out.append(own)
    return out


def with_group(df: DataFrame, groups: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The rows with the columns of their group; NULL is a key like any other. groups: keys and columns, one row each.

    Groups are aggregates, few rows against those of ``df``; whether they are broadcast is left to the optimizer."""
    if not keys:
        return df.crossJoin(F.broadcast(groups.select(*columns)))  # one row
    names = fresh(df, *(f"k_{k}" for k in keys))
    right = groups.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *columns)
    cond = None
    for k, n in zip(keys, names):
        same = df[k].eqNullSafe(right[n])
        cond = same if cond is None else cond & same
    return df.join(right, cond).select(*[df[c] for c in df.columns], *[right[c] for c in columns])


def with_stats(df: DataFrame, keys: list[str], **stats: Column) -> tuple[DataFrame, dict[str, str]]:
    """The rows with statistics of their group under fresh names: one aggregate and a join, no window over whole groups."""
    names = dict(zip(stats, fresh(df, *stats)))
    groups = df.groupBy(*keys).agg(*[c.alias(names[k]) for k, c in stats.items()])
    return with_group(df, groups, keys, list(names.values())), names


#: Approximate percentiles bracket the exact ones within a few such parts of all ranks.
ACCURACY = 10_000


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], out: str = "percentiles") -> DataFrame:
    """(keys, out): the percentiles that ``percentile`` gives, without its map of all distinct values in one task.

    Approximate percentiles bracket each exact one; only values inside a bracket, a few ten-thousandths of all, are
    counted one by one. Groups of few values have everything as their bracket. NULLs don't count."""
    named, keys = keys, [f"key_{i}" for i in range(len(keys))]
    valid = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(named, keys)], F.col(value).cast("double").alias("value"))
    p = [x for s in shares for x in (max(0.0, s - 4 / ACCURACY), min(1.0, s + 4 / ACCURACY))]
    wide = valid.groupBy(*keys).agg(F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile_approx("value", p, ACCURACY).alias("q"))
    few = F.col("n") < 20 * ACCURACY
    brackets = F.array(*[
        F.struct(
            F.lit(k).alias("k"), F.floor(F.lit(s) * (F.col("n") - 1)).alias("rank"), (F.lit(s) * (F.col("n") - 1) - F.floor(F.lit(s) * (F.col("n") - 1))).alias("part"),
            F.when(few, F.col("least")).otherwise(F.get("q", F.lit(2 * k))).alias("lo"), F.when(few, F.col("most")).otherwise(F.get("q", F.lit(2 * k + 1))).alias("hi"),
        ) for k, s in enumerate(shares)
    ])
    bounds = wide.select(*keys, brackets.alias("brackets"))
    placed = with_group(valid, bounds, keys, ["brackets"])
    below = placed.groupBy(*keys).agg(F.array(*[F.count_if(F.col("value") < F.get("brackets", F.lit(k))["lo"]) for k in range(len(shares))]).alias("below"))
    near = placed.select(*keys, "value", F.explode(F.filter("brackets", lambda b: (F.col("value") >= b["lo"]) & (F.col("value") <= b["hi"]))).alias("b"))
    near = near.groupBy(*keys, "b.k", "b.rank", "b.part", "value").agg(F.count(F.lit(1)).alias("c"))
    near = with_group(near, below, keys, ["below"])
    upto = F.sum("c").over(W.partitionBy(*keys, "k").orderBy("value")) + F.get("below", F.col("k"))
    near = near.withColumn("upto", upto)
    pick = lambda more: F.min(F.when(F.col("upto") > F.col("rank") + more, F.col("value")))
    each = near.groupBy(*keys, "k", "part").agg(pick(0).alias("a"), pick(1).alias("b"))
    found = each.select(*keys, F.struct("k", F.when(F.col("part") > 0, F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).otherwise(F.col("a")).alias("v")).alias("s"))
    listed = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("listed"))
    return listed.select(*[F.col(n).alias(k) for k, n in zip(named, keys)], F.col("listed").alias(out))
