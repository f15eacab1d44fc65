"""Language identification with string kernels.

The kernel of two texts is the cosine of their blended-spectrum presence vectors: which character n-grams of
lengths 1 to 4 occur in them at all, over lower-cased letters with everything else folded to blanks, hashed
to ``BUCKETS`` places. Landmarks drawn from the training rows give the Nyström feature map
``k(x, L) K_LL^-1/2``; one ridge regression per language, against all others, is solved on it. Scoring is two
matrix products per batch of documents: presence times landmarks, kernel times coefficients.

Training uses at most ``PER_LANGUAGE`` rows of each language, those with the smallest hash of their id among
the labelled rows that are not held out (and among these, of rows whose hash is below about ``MARGIN`` times that
share of all hashes, which is less only where most texts are null), and of these ``LANDMARKS`` as landmarks. Only their presence bits,
``BUCKETS / 8`` bytes a row, come to the driver, and where texts are to be rejected the first ``HEAD``
characters. Whole texts are read in training and in prediction.

The regressions' values only compare languages: for L of them they sum to about 2 - L, so that some value is
high for any text. Where texts are to be rejected, ``Familiar`` judges them by the mean, over all n-grams of
a text that start with a letter, of the log share of training texts with the n-gram, in the language where it is
most common; so texts of several languages pass. The mean does not depend on a text's length, only its spread
does. For each class of length (powers of 2 of different longest n-grams, counted as the inverse of the chance
that two are equal, so that repeating a word does not lengthen a text) the floor comes from excerpts of each language's
training texts, left out of their own shares: ``SLACK`` times as far below their median as their lowest
hundredth, of all languages the lowest.

Defined results
    * A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing is labelled.
    * The score is the winning regression's value mapped from [-1, 1] to [0, 1]; ties go to the first language
      in code-point order. Repeated rows are predicted alike. A null id is hashed as the empty text.
    * Columns of the input pass through; names the operator adds win.
    * Where texts are rejected, a foreign one is ``und`` with score 0. Texts of less than ``2 ** SHORTEST``
      different n-grams are not rejected, and with a language of one training text none is.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import hash60, python_ready, table

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
PER_LANGUAGE, MARGIN = 150, 8
LANDMARKS = 64
RIDGE = 1e-2
GROUP_DOCS, GROUP_CHARS = 64, 1 << 18
UNKNOWN = "und"
HEAD = 1 << 11
SHORTEST, LONGEST = 2, 10
SLACK = 5


def _fold_table() -> np.ndarray:
    """For each code point of the basic plane: its lower-case letter, or 0 for what is no letter."""
    table = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_FOLD: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Folded code points."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    points = np.frombuffer(text.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)
    if points.size and points.max() >= 1 << 16:
        high = np.unique(points[points >= 1 << 16])
        known = np.array([chr(c).isalpha() for c in high])
        out = _FOLD[0][np.minimum(points, (1 << 16) - 1)]
        at = points >= 1 << 16
        out[at] = np.where(known[np.searchsorted(high, points[at])], points[at], 0)
        return out
    return _FOLD[0][points]


def _places(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the buckets of the n-grams that start at each position. Grams without any letter count too: they only say that there is a blank."""
    h = np.zeros(len(points), np.uint32)
    for n in ORDERS:
        if len(points) < n:
            return
        h = (h[: len(points) - n + 1] + points[n - 1 :] + np.uint32(1)) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        yield n, (h >> np.uint32(3)) & np.uint32(BUCKETS - 1)


def presence(texts: list[np.ndarray]) -> np.ndarray:
    """One row of 0 and 1 per text (texts as letters), as float32."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    flat = out.reshape(-1)
    for row, points in enumerate(texts):
        for lo in range(0, max(1, len(points)), GROUP_CHARS):
            for _, at in _places(points[lo : lo + GROUP_CHARS + ORDERS[-1] - 1]):
                flat[at.astype(np.int64) + row * BUCKETS] = 1
    return out


class Familiar:
    """How common the n-grams of a text are in the languages, and the least that is still one of them."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, n_languages: int, heads: list[np.ndarray]):
        """rows, labels: as those of the model; heads: the texts' beginnings as letters."""
        df = np.stack([rows[labels == k].sum(0) for k in range(n_languages)])
        n = np.bincount(labels, minlength=n_languages)
        shares = np.log((df + 0.1) / (n[:, None] + 0.1))
        self.weights = shares.max(0)
        self.floors = np.full(LONGEST + 1, np.inf)
        for lang in range(n_languages):
            without = np.log((np.maximum(df[lang] - 1, 0) + 0.1) / max(n[lang] - 1, 1))
            without = np.maximum(without, np.delete(shares, lang, 0).max(0, initial=-np.inf))
            seen: list[list[float]] = [[] for _ in self.floors]
            for head in (heads[k] for k in np.flatnonzero(labels == lang).tolist()):
                for size in (int(1.3 * 2**k) for k in range(SHORTEST, LONGEST + 1)):
                    for lo in np.unique(np.linspace(0, len(head) - size, 4).astype(int)) if len(head) >= size else ():
                        piece = head[lo : lo + size]
                        mean, k = self.measure(piece, without)
                        if k >= SHORTEST:
                            seen[k].append(mean)
            own = -np.inf
            for k, values in enumerate(seen):
                if values and n[lang] > 1:
                    low, middle = np.percentile(values, [1, 50])
                    own = middle - SLACK * (middle - low)
                self.floors[k] = min(self.floors[k], own)
        self.floors = np.minimum.accumulate(self.floors[::-1])[::-1]  # a longer text spreads no wider
        self.floors[:SHORTEST] = -np.inf

    @staticmethod
    def measure(points: np.ndarray, weights: np.ndarray) -> tuple[float, int]:
        """Mean weight of all n-grams that start with a letter, and the class of length."""
        total, n, seen = 0.0, 0, np.zeros(BUCKETS)
        for lo in range(0, len(points), GROUP_CHARS):
            size = min(GROUP_CHARS, len(points) - lo)
            for order, at in _places(points[lo : lo + size + ORDERS[-1] - 1]):
                at = at[:size]
                at = at[points[lo : lo + len(at)] != 0]
                total, n = total + float(weights[at].sum(dtype=np.float64)), n + len(at)
                if order == ORDERS[-1]:
                    seen += np.bincount(at, minlength=BUCKETS)
        different = seen.sum() ** 2 / max(1.0, (seen * seen).sum())
        return total / max(n, 1), min(int(different + 1e-9).bit_length() - 1, LONGEST)

    def foreign(self, points: np.ndarray) -> bool:
        mean, k = self.measure(points, self.weights)
        return k >= SHORTEST and mean < self.floors[k]


class Model:
    """Landmarks and coefficients."""

    familiar: Familiar | None = None

    def __init__(self, languages: list[str], rows: np.ndarray, labels: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE):
        """rows: presence of the training texts, dealt so that any first rows hold all languages; labels: their languages' numbers."""
        unit = rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
        at = unit[:landmarks]
        values, vectors = np.linalg.eigh((at @ at.T).astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-6))  # K^-1/2 up to a rotation
        kernel = (unit @ at.T).astype(np.float64)
        features = np.column_stack([kernel @ root, np.ones(len(rows))])
        signs = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
        weight = 1 / np.bincount(labels, minlength=len(languages))[labels]  # each language counts alike
        left = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1])
        solved = np.linalg.solve(left, features.T @ (signs * weight[:, None]))
        self.languages, self.landmarks = languages, np.ascontiguousarray(at.T)
        self.coefficients, self.bias = root @ solved[:-1], solved[-1]

    def values(self, texts: list[np.ndarray]) -> np.ndarray:
        rows = presence(texts)
        kernel = (rows @ self.landmarks) / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
        return kernel.astype(np.float64) @ self.coefficients + self.bias


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed, heads = [], []
        for text in batch.column("text"):
            points = letters(text.as_py())
            heads.append(text.as_py()[:HEAD])
            packed.append(np.packbits(presence([points])[0].astype(bool)).tobytes() if points.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("n"), pa.array(packed, pa.binary()), pa.array(heads, pa.string())], names=["lang", "n", "bits", "head"])


def train(rows: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, reject: bool = False) -> Model | None:
    """rows: id, text, lang, all of them labelled. reject: whether the model is to tell foreign texts."""
    python_ready(rows.sparkSession)
    usable = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    # Ids below a share of all hashes that leaves about MARGIN times as many as needed: no more texts than these are shuffled.
    counts = rows.where(F.col("lang").isNotNull()).groupBy("lang").count().collect()  # languages are few: the model has a column for each
    if not counts:
        return None
    below = [(r["lang"], min(1 << 60, int((MARGIN * per_language / r["count"]) * 2**60))) for r in counts]
    below = rows.sparkSession.createDataFrame(below, "lang string, below long")
    usable = usable.join(F.broadcast(below), "lang").where(hash60(F.col("id")) < F.col("below")).drop("below")
    order = W.partitionBy("lang").orderBy(hash60(F.col("id")), F.col("id"), F.md5("text"))
    sample = usable.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("lang", "n", "text")
    sample = sample.mapInArrow(_bits, "lang string, n int, bits binary, head string")
    found = sorted((r for r in (sample if reject else sample.drop("head")).collect() if r["bits"]), key=lambda r: (r["n"], r["lang"]))
    if not found:
        return None
    languages = sorted({r["lang"] for r in found})
    bits = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in found), np.uint8).reshape(len(found), -1), axis=1).astype(np.float32)
    labels = np.array([languages.index(r["lang"]) for r in found])
    model = Model(languages, bits, labels, max(landmarks, 8 * len(languages)))
    if reject:
        model.familiar = Familiar(bits, labels, len(languages), [letters(r["head"]) for r in found])
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The documents with lang_pred string and score double."""
    spark = docs.sparkSession
    python_ready(spark)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != text_col)]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            langs, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            at, texts, chars = [], [], 0

            def flush():
                values = own.values(texts)
                best = values.argmax(1)
                langs[at] = np.array(own.languages, object)[best]
                scores[at] = np.clip((values[np.arange(len(best)), best] + 1) / 2, 0, 1)
                if own.familiar is not None:
                    foreign = [k for k, points in zip(at, texts) if own.familiar.foreign(points)]
                    langs[foreign], scores[foreign] = UNKNOWN, 0
                at.clear(), texts.clear()

            for k, text in enumerate(batch.column(text_col) if own is not None else ()):
                points = letters(text.as_py() or "")
                if points.any():
                    at.append(k), texts.append(points)
                    chars += len(points)
                    if len(at) == GROUP_DOCS or chars > 4 * GROUP_CHARS:
                        flush()
                        chars = 0
            if at:
                flush()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(scores)], names=[*kept, "lang_pred", "score"])

    schema = T.StructType([docs.schema[c] for c in kept]).add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(run, schema)


def labelled(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("lang").isNotNull()).select(F.col("doc_id").alias("id"), "text", "lang")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text").withColumn("held_out", held_out())
    return predict(rows, train(labelled(docs)), keep_text=False)
