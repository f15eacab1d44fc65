"""Exact top-k search by term-at-a-time accumulation.

Vectors are sparse integer rows: component ``floor(scale * x)`` is the weight of term x, zero weights are
left out. A block of candidates is turned into one posting list per term; each query row scatters its
weighted postings into a dense array with one score per candidate, and what reaches the query's current
threshold is kept by partition selection. Results of the blocks are merged within the task, and those of
the tasks by rank.

Weights travel as doubles, which hold ``floor(scale * x)`` of a double exactly if the scale is a power of two.

Queries and candidates are packed into blocks of a bounded number of rows and bytes, and each block is written
once, by one exchange. A task is a cell of the Cartesian product of both: it holds its few blocks of queries and
streams its slice of the candidates, which are read as often as there are chunks of queries but never copied. So
neither memory nor disk grows with the product, and nothing is broadcast.

Defined results
    * Vectors that are null, empty, or hold a null, NaN or infinite component take no part on either side.
    * A query never meets rows with its own id. Rows that repeat an id are candidates each by itself.
    * Equal scores: the smaller id first. Vectors of other lengths share the terms they have.
    * Weights and sums are exact at any size: 32 or 64 bits where a block's bound allows it, else integers of any
      length. A score that reaches the result and does not fit into a long raises an error, as does a component
      that is finite, but not when scaled.
    * Ids that are null take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import python_ready, table

K = 20
SCALE = 64
QUERY_CHUNK = 4096
BLOCK = 8192
#: Rows of candidates that travel together; small, so that short tables have blocks for all slices.
PACK = 1024
#: Bytes of weights, as doubles, in a packed block at most; a longer row is a block of its own.
BLOCK_BYTES = 1 << 22
DENSE_SHARE = 0.5
#: Candidates with a larger weight are in blocks of their own, so that others keep short integers.
LARGE = 1 << 24


def _integers(rows: np.ndarray, kind: type) -> np.ndarray:
    return rows.astype(kind) if kind is not object else np.array([int(x) for x in rows.reshape(-1)], object).reshape(rows.shape)


class _Postings:
    """Posting lists of one block of candidates, in the shortest integers that hold every score."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.n, self.rows = ids, len(ids), rows
        self.most = float(np.abs(rows).max(initial=0))
        self.kinds: dict[type, list] = {}

    def kind(self, weights: np.ndarray) -> type:
        bound = self.most * float(np.abs(weights).max(initial=0)) * max(1, min(self.rows.shape[1], len(weights)))
        return np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object

    def lists(self, kind: type) -> list:
        if kind not in self.kinds:
            out = []
            for t in range(self.rows.shape[1]):
                column = _integers(np.ascontiguousarray(self.rows[:, t]), kind)
                at = np.flatnonzero(column)
                # A list with most candidates in it is kept without their numbers; its zeros add nothing.
                out.append((None, column) if len(at) > DENSE_SHARE * self.n else (at, column[at]))
            self.kinds[kind] = out
        return self.kinds[kind]


def _search(postings: _Postings, weights: np.ndarray, tmp: dict[type, np.ndarray]) -> np.ndarray:
    """Dense scores of one query row against the block."""
    kind = postings.kind(weights)
    lists, scores = postings.lists(kind), np.zeros(postings.n, dtype=kind)
    if kind not in tmp:
        tmp[kind] = np.empty(postings.n, dtype=kind)
    weights = _integers(weights[: len(lists)], kind)
    for t in np.flatnonzero(weights):
        at, values = lists[t]
        if at is None:
            np.multiply(values, weights[t], out=tmp[kind])
            scores += tmp[kind]
        elif len(at):
            scores[at] += values * weights[t]
    return scores


def _long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and any(not -(2**63) <= x < 2**63 for x in scores):
        raise OverflowError("a score does not fit into 64 bits")
    return scores.astype(np.int64)


class _Cell:
    """One chunk of queries with the best k of each so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.rows, self.best, self.blocks = k, [], [], None, []
        self.waiting = 0

    def query(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids.append(ids)
        self.rows.append(rows)

    def candidates(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.blocks.append((ids, rows))
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if not self.waiting or not len(self.ids):
            return
        if self.best is None:
            self.ids, self.rows = np.concatenate(self.ids), _stack(self.rows)
            self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(self.ids)
        ids, rows = np.concatenate([x for x, _ in self.blocks]), _stack([x for _, x in self.blocks])
        self.blocks, self.waiting = [], 0
        if not np.isfinite(rows).all() or not np.isfinite(self.rows).all():
            raise OverflowError("a component is beyond the range of doubles when scaled")
        large = np.abs(rows).max(1, initial=0) >= LARGE
        for own in (np.flatnonzero(~large), np.flatnonzero(large)):
            for lo in range(0, len(own), BLOCK):
                at = own[lo : lo + BLOCK]
                self._block(ids[at], rows[at])

    def _block(self, ids: np.ndarray, rows: np.ndarray) -> None:
        postings, tmp = _Postings(ids, rows), {}
        for q in range(len(self.ids)):
            scores = _search(postings, self.rows[q], tmp)
            old_scores, old_ids = self.best[q]
            if len(old_ids) == self.k:
                at = np.flatnonzero(scores >= old_scores[-1])
            elif len(scores) > 4 * self.k:
                at = np.flatnonzero(scores >= np.partition(scores, -2 * self.k)[-2 * self.k])
                if np.count_nonzero(ids[at] != self.ids[q]) < self.k:  # its own rows crowd out others
                    at = np.arange(len(scores))
            else:
                at = np.arange(len(scores))
            at = at[ids[at] != self.ids[q]]
            if len(at):
                s, i = np.concatenate([old_scores, scores[at] if scores.dtype == object else scores[at].astype(np.int64)]), np.concatenate([old_ids, ids[at]])
                order = np.array(sorted(range(len(s)), key=lambda k: (-s[k], i[k])), np.int64) if s.dtype == object else np.lexsort((i, ~s))
                self.best[q] = s[order[: self.k]], i[order[: self.k]]

    def result(self):
        """(query_id, vec_ids, scores) of each query that met a candidate."""
        self.flush()
        for q, (scores, ids) in zip(self.ids, self.best or []):
            if len(ids):
                yield int(q), ids.tolist(), _long(scores).tolist()


def _stack(parts: list[np.ndarray]) -> np.ndarray:
    wide = max(x.shape[1] for x in parts)
    return np.concatenate([np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in parts])


def _dense(lists: pa.Array) -> np.ndarray:
    """Rows of integral doubles, padded with zeros."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values[offsets[0] : offsets[-1]]
    return out


def _packer(limit: int):
    """Rows to blocks of at most ``limit`` rows, their weights in the shortest type that holds them."""

    def block(ids: list, rows: list, number: int) -> pa.RecordBatch:
        weights = _stack(rows)
        most = np.abs(weights).max(initial=0)
        kind = next((t for t in ("int8", "int16", "int32") if most <= np.iinfo(t).max), "float64")
        values = [TaskContext.get().partitionId(), number, weights.shape[1], kind, np.concatenate(ids).tobytes(), weights.astype(kind).tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["part", "number", "width", "kind", "ids", "weights"])

    def pack(batches):
        ids, rows, held, wide, number = [], [], 0, 0, 0
        for batch in batches:
            own, lists = batch.column("id").to_numpy(), batch.column("weights")
            sizes, lo = np.diff(lists.offsets.to_numpy()), 0
            while lo < len(own):
                widest = np.maximum.accumulate(np.maximum(sizes[lo : lo + limit - held], wide))
                n = int(np.count_nonzero((held + 1 + np.arange(len(widest))) * widest <= BLOCK_BYTES // 8))
                if n or not held:
                    n = max(1, n)
                    ids, rows, held, wide, lo = [*ids, own[lo : lo + n].copy()], [*rows, _dense(lists.slice(lo, n))], held + n, int(widest[n - 1]), lo + n
                if held == limit or n < len(widest):
                    yield block(ids, rows, number)
                    ids, rows, held, wide, number = [], [], 0, 0, number + 1
        if held:
            yield block(ids, rows, number)

    return pack


def _blocks(vectors: DataFrame, limit: int, parts: int):
    """An RDD of packed blocks in ``parts`` partitions, behind one exchange: it is read again without packing again."""
    packed = vectors.mapInArrow(_packer(limit), "part int, number int, width int, kind string, ids binary, weights binary")
    return packed.repartition(parts).rdd


def _unpacked(block) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(block.ids, np.int64)
    return ids, np.frombuffer(block.weights, block.kind).reshape(len(ids), block.width).astype(float)


def _run(k: int):
    def run(pairs):
        cells: dict[tuple[int, int], _Cell] = {}
        for chunk, block in pairs:
            if (key := (chunk.part, chunk.number)) not in cells:
                cells[key] = _Cell(k)
                cells[key].query(*_unpacked(chunk))
            cells[key].candidates(*_unpacked(block))
        for cell in cells.values():
            yield from cell.result()

    return run


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: float = SCALE) -> DataFrame:
    """(id, weights): integral rows of the usable vectors, as doubles."""
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    # From 2^53 on every double is integral; floor gives a long.
    weight = lambda x: F.when(F.abs(scaled(x)) < float(1 << 53), F.floor(scaled(x)).cast("double")).otherwise(scaled(x))
    return vectors.where(usable & ~F.exists(vector_col, bad)).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, weight).alias("weights"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """Both (id, weights). Each query's k best candidates: query_id, rank, vec_id, score."""
    spark = queries.sparkSession
    python_ready(spark)
    chunks = max(1, math.ceil(queries.count() / QUERY_CHUNK))
    slices = max(1, math.ceil(4 * spark.sparkContext.defaultParallelism / chunks))
    # Queries are few and come together first, so that a chunk is full; candidates are packed where they are read.
    left = _blocks(queries.select("id", "weights").repartition(chunks), 2 * QUERY_CHUNK, chunks)
    right = _blocks(candidates.select("id", "weights"), PACK, slices)
    each = spark.createDataFrame(left.cartesian(right).mapPartitions(_run(k)), "query_id long, vec_ids array<long>, scores array<long>", verifySchema=False)
    found = each.select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("x")).select("query_id", F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows.where(F.col("id") % 20 == 0), rows)


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score::BIGINT AS score FROM r WHERE rank <= {K}
"""
