"""The corpus pipeline: language identification, near-deduplication, benchmark decontamination, source mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next stage reads it.
All but the last return the columns of ``documents``.

    language   keeps documents with a language; a text without a letter, or foreign to every language, goes
    dedup      keeps the document with the smallest id of each near-duplicate class
    decontaminate  cuts benchmark passages out of texts; a document that is mostly benchmark goes
    mix        repeats or drops documents so that sources meet their target weights, in training order
    shard      one row per document to write: doc_id, n_bytes, shard, depth, over_limit
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm import decontaminate as decontamination
from terraframe.llm import language, mixing, near_dedup, sharding
from terraframe.llm.common import materialize, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(language.labelled(docs), reject=True)
    found = language.predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return found.where(F.col("lang_pred") != language.UNKNOWN).select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs)


STAGES = [
    ("language", identify),
    ("dedup", deduplicate),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: The kernel regression and the sampling of near-duplicate candidates can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
