"""Quality classification by hierarchical empirical Bayes.

A logistic regression over shape features of the whole text gives each document's evidence. Documents with a
label count with the label, all others with the regression's probability, in grouped sums by host and by path
within the host. Each level is shrunk toward the one above it: a host toward the global rate, a path toward
its host, by a prior strength that the method of moments reads off the spread of the groups' rates. A document
is left out of its own path's and host's sums, and its posterior log-odds are its evidence (log-odds over the
global rate) plus the log-odds of its path.

The regression is fitted on about ``PER_LABEL`` labelled rows of each value, those whose id's hash is below
that share of all hashes; only their features come to the driver. All sums cover all documents.

Defined results
    * A null or empty text has the features of an empty text and is judged like any other.
    * A null host, or path, is a group of its own. Labels that are null don't count; of several labels for an
      id the mean counts. Without both label values the evidence is 0 everywhere, and rates are those of the labels.
    * Repeated rows count each. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash60, materialize, python_ready, table

PER_LABEL = 2000
RIDGE = 1.0
KEEP = 0.5
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.zeros(256, np.intp)  # of a byte: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line break, 6 beyond ASCII, then one for each sign
for _c in range(256):
    _x = bytes([_c])
    _CLASS[_c] = 6 if _c >= 128 else 1 if _x.islower() else 2 if _x.isupper() else 3 if _x.isdigit() else 5 if _x == b"\n" else 4 if _x.isspace() else 7 + SIGNS.index(_x) if _x in SIGNS else 0
N_CLASSES = 7 + len(SIGNS)
N_FEATURES = N_CLASSES + 7


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    shares = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=N_CLASSES) / max(1, len(data))
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    n = max(1, len(words))
    more = (
        math.log1p(len(words)), min(20.0, sum(map(len, words)) / n), len(set(words)) / n, len(set(lines)) / max(1, len(lines)),
        math.log1p(len(words) / max(1, len(lines))), sum(map(bytes.isupper, words)) / n, math.log1p(len(lines)),
    )
    return np.concatenate([np.sqrt(shares), more])


class Logistic:
    """Ridge logistic regression, by Newton's method; classes weigh alike, so that it speaks of evidence, not of base rates."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = self._standard(x)
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
        self.beta = np.zeros(z.shape[1])
        penalty = ridge * np.eye(z.shape[1])
        penalty[-1, -1] = 1e-9
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            gradient = z.T @ (weight * (y - p)) - penalty @ self.beta
            step = np.linalg.solve((z.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ z + penalty, gradient)
            self.beta += step
            if np.abs(step).max() < 1e-8:
                break

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood ratios, kept within what so many labels can tell."""
        return np.clip(self._standard(x) @ self.beta, -12, 12)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()).tolist() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])


def sample_labels(known: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """known: label_id, label. About ``per_label`` ids of each label 0 and 1: those whose hash is below that share of all hashes."""
    known = known.where("label IN (0, 1)")
    share = {r["label"]: min(1.0, per_label / r["n"]) for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    below = F.when(F.col("label") == 0, F.lit(int(share.get(0.0, 0) * 2**60))).otherwise(F.lit(int(share.get(1.0, 0) * 2**60)))
    return known.where(hash60(F.col("label_id")) < below)


def train(rows: DataFrame) -> Logistic | None:
    """rows: id, text, label (0 or 1), a bounded sample. Of rows that repeat an id one counts."""
    python_ready(rows.sparkSession)
    one = rows.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    found = one.select("label", "text").mapInArrow(_features, "label double, x array<double>").collect()
    y = np.array([r["label"] for r in found])
    if len(set(y.tolist())) < 2:
        return None
    x = np.array([r["x"] for r in found])
    order = np.lexsort(np.column_stack([x, y]).T)  # the same sums whatever order rows came in
    return Logistic(x[order], y[order])


def evidence(rows: DataFrame, model: Logistic | None, text_col: str = "text") -> DataFrame:
    """The rows without their text, with evidence double."""
    spark = rows.sparkSession
    python_ready(spark)
    kept = [c for c in rows.columns if c not in (text_col, "evidence")]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if own is not None and batch.num_rows:
                out = own.evidence(np.stack([features(t.as_py()) for t in batch.column(text_col)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out)], names=[*kept, "evidence"])

    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in kept]).add("evidence", "double"))


def _odds(p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.ln(p / (1 - p))


def _strength(groups: DataFrame, center: Column) -> float:
    """How many documents the level above counts as, by the method of moments: spread of the groups' rates beyond what their sizes explain."""
    rate, n = F.col("s") / F.col("n"), F.col("n")
    noise = center * (1 - center) / n
    row = groups.where("n > 1").agg(F.sum(n * (F.pow(rate - center, 2) - noise)) / F.sum(n), F.sum(n * center * (1 - center)) / F.sum(n)).first()
    spread, whole = (row[0] or 0.0), (row[1] or 0.25)
    return min(1e4, max(1.0, whole / spread - 1)) if spread > 0 else 1e4


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: float = KEEP) -> DataFrame:
    """One row per document: id_col, host, path, evidence, host_rate, path_rate, p_quality double, keep boolean."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), host.alias("host"), path.alias("path"))
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    taught = rows.select("id", "text").join(F.broadcast(sample_labels(known)), F.col("id") == F.col("label_id"))  # PER_LABEL bounds it
    model = train(taught.select("id", "text", "label"))
    found = materialize(evidence(rows, model))
    found = found.join(known, F.col("id") == F.col("label_id"), "left").drop("label_id")

    given = known.agg(F.avg("label")).first()[0]
    base = 0.5 if given is None else min(1 - 1e-6, max(1e-6, given))
    guess = 1 / (1 + F.exp(-(F.col("evidence") + math.log(base / (1 - base)))))
    found = materialize(found.withColumn("p", F.coalesce("label", guess)))

    paths = materialize(found.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    rate = base if total is None else total
    host_m = _strength(hosts, F.lit(rate))
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    path_m = _strength(both, (F.col("host_s") + rate * host_m) / (F.col("host_n") + host_m))
    both = both.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "host_n", "host_s")

    each = found.join(both, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    host_rate = (F.col("host_s") - F.col("p") + rate * host_m) / (F.col("host_n") - 1 + host_m)
    path_rate = (F.col("s") - F.col("p") + F.col("host_rate") * path_m) / (F.col("n") - 1 + path_m)
    each = each.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    each = each.withColumn("p_quality", 1 / (1 + F.exp(-(F.col("evidence") + _odds(F.col("path_rate"))))))
    return each.select(F.col("id").alias(id_col), "host", "path", "evidence", "host_rate", "path_rate", "p_quality", (F.col("p_quality") >= keep).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
