"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words (a text of fewer words is one shingle). A shingle's weight is its count in
the text times an inverse document frequency. Improved consistent weighted sampling draws, with each of
``BANDS * ROWS`` functions, one shingle of a text such that two texts draw the same with a probability equal
to their weighted Jaccard similarity; groups of ``ROWS`` draws are band keys. Texts that share a band key
and agree in enough draws are candidates, and a candidate is a link if the exact weighted Jaccard similarity
of the two texts is at least ``SIMILARITY``. Classes are the connected components of the links.

Inverse document frequency is ``1 + ln(N / max(df, theta N)) / (2 ln(1 / theta))``: from 1 for a shingle of
every text to 1.5 for one in at most a share theta of them. It is kept within these bounds because copies
raise the frequency of their own shingles: without them, texts of a large group of near copies would be
judged by the few shingles that they do not share. Only shingles in more than theta of all texts need to be
known by number; at most (mean shingles a text) / theta exist, so the table that goes to all tasks is bounded.
They are found exactly, in two passes: tasks of about ``TASK_DOCS`` texts or more keep Misra-Gries summaries, whose
undercounts are known and together below theta; sums of these leave the shingles that may be that frequent, and
one pass counts them. Where undercounts or candidates pass their bounds, which takes texts of very many
different shingles, all shingles are counted by an aggregation instead, with the same result.

Draws come from a table of 2^16 parameter triples indexed by a hash of shingle and function; a draw is known
by its value and by 32 more bits of that hash.

Large groups: texts equal in their words are one node from the start. Within a bucket, agreement is compared
for all members, but what is emitted is, for more than ``SMALL`` members, a maximum spanning forest and the
nearest neighbours of each. After the first components, buckets that still hold several of them compute the
exact similarities of their members outside the largest component, one to all others at a time, and emit what joins
components, until there is one; so no link between components is lost.
A bucket of more than ``HOT`` members is cut into blocks of about ``BLOCK``. First each block meets only the
bucket's ``GUESTS`` representatives (those with the least keys), through which groups are joined across blocks; what
is left outside the bucket's largest component then meets every block, each pair a task of its own. So the work
grows with members plus (members left over) x members, not with the square of a group of near copies.

Defined results
    * A null text is in no class but its own, with a null class id if its id is null; texts without words are
      a class with those of exactly the same text.
    * The class id is the smallest id in the class. Repeated rows are one class. Null ids never become class
      ids unless a class has no other. Extra columns are not read. An empty table gives an empty result.
    * Texts of any length are read whole; a task holds the shingles of 16 texts at a time.
    * ``deduplicated`` keeps, of rows that repeat both id and text, the one with the least hash of all its columns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, python_ready, release, table
from .components import components
from .decontaminate import FOLD, SQL_WORDS

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 3
DRAWS = BANDS * ROWS
#: Draws in which candidates agree at least; a pair at the threshold misses this about 4 times in 100,000.
AGREE = 23
THETA = 0.01
SMALL, NEAREST = 8, 3
HOT, BLOCK, GUESTS = 1024, 512, 64
#: Texts a task sees at least, on average, when it summarises; counters of a summary; shingles that are counted in one pass.
TASK_DOCS, COUNTERS, CANDIDATES = 1000, 1 << 21, 1 << 20
GATHER = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up = lambda b: np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64), dtype=np.uint64)))
        _POWERS[:] = [up(_BASE), up(inverse)]
    return _POWERS[0], _POWERS[1]


def word_hashes(folded: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text whose other bytes are blanks."""
    data = np.frombuffer(folded, np.uint8)
    inside = (data != 32).view(np.int8)
    edge = np.diff(np.concatenate(([0], inside, [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(data.astype(np.uint64) * power[: len(data)], dtype=np.uint64)))
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, ascending, and their counts."""
    words = word_hashes(text.encode("utf-8", "surrogatepass").translate(FOLD)) if text else np.empty(0, np.uint64)
    return _shingles(words)


def _shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(words):
        return words, np.empty(0, np.int64)
    n = min(SHINGLE, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = h * _STEP + words[k : len(words) - n + 1 + k]
    return np.unique(_mix(h), return_counts=True)


class Weights:
    """Inverse document frequencies: those of frequent shingles by number, one for all others."""

    def __init__(self, n_docs: int, hashes: np.ndarray, counts: np.ndarray, theta: float = THETA):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.common = 1 + np.log(n_docs / np.maximum(counts[order], theta * n_docs)) / (2 * math.log(1 / theta)) if len(hashes) else np.empty(0)
        self.rare = 1.5

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.rare)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            out[known] = self.common[at[known]]
        return out * counts


class Sampler:
    """Improved consistent weighted sampling with ``draws`` functions."""

    def __init__(self, draws: int = DRAWS, seed: int = 20_240_229):
        rng = np.random.default_rng(seed)
        self.r, self.c = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16)
        self.beta = rng.random(1 << 16)
        self.odd = rng.integers(0, 1 << 63, draws, np.uint64) * np.uint64(2) + np.uint64(1)
        self.usual_weight = 1.5
        self.usual = self._values(np.arange(1 << 16), np.full(1 << 16, 1.5))

    def _values(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """ln a for each weight and triple, as the upper half of an order-preserving integer."""
        r, beta = self.r[at], self.beta[at]
        t = np.floor(np.log(weights) / r + beta)
        value = (np.log(self.c[at]) - r * (t - beta) - r).astype(np.float32)
        bits = value.view(np.uint32)
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        return bits.astype(np.uint64) << np.uint64(32)

    def __call__(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of draws for each text; a text's shingles begin at its start."""
        odd_ones = np.flatnonzero(weights != self.usual_weight)
        own = weights[odd_ones]
        out = np.empty((len(starts), len(self.odd)), np.uint64)
        for f, odd in enumerate(self.odd):
            g = hashes * odd
            at = (g >> np.uint64(48)).astype(np.intp)
            value = self.usual[at]
            if len(odd_ones):
                value[odd_ones] = self._values(at[odd_ones], own)
            value |= (g >> np.uint64(16)) & np.uint64(0xFFFFFFFF)
            out[:, f] = np.minimum.reduceat(value, starts)
        return out


class Summary:
    """Misra-Gries counters of shingles: every true count is at least the counter's and at most ``lost`` more."""

    def __init__(self, theta: float, most: int | None = None):
        self.theta, self.most = theta, most or COUNTERS
        self.values, self.counts, self.lost = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        self.docs = self.seen = self.size = 0
        self.held: list[np.ndarray] = []

    def add(self, own: np.ndarray) -> None:
        self.docs += 1
        self.seen += len(own)
        if len(own):
            self.held.append(own)
            self.size += len(own)
        if self.size >= GATHER:
            self.fold()

    def _drop(self, least: int) -> None:
        """Forget counters of at most ``least``; the others count that much less, which is in what is lost."""
        keep = self.counts > least
        self.values, self.counts = self.values[keep], self.counts[keep] - least
        self.lost += least

    def fold(self) -> None:
        values, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *self.held]), return_counts=True)
        self.held, self.size = [], 0
        both, at = np.unique(np.concatenate([self.values, values]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, counts]), len(both)).astype(np.int64)
        self.values = both
        # So many that a full summary loses at most a quarter of theta of its texts, if memory allows.
        room = min(self.most, max(1 << 12, math.ceil(4 * self.seen / max(1, self.docs) / self.theta)))
        if len(both) > room:
            self._drop(int(np.partition(self.counts, -room - 1)[-room - 1]))

    def finish(self) -> None:
        self.fold()
        if (least := int(0.45 * self.theta * self.docs)) > 0:
            self._drop(least)


def _summarise(theta: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Summary(theta)
        for batch in batches:
            for text in batch.column("text"):
                own.add(shingles(text.as_py())[0])
        own.finish()
        for lo in range(0, len(own.values), 1 << 16):
            values, counts = own.values[lo : lo + (1 << 16)], own.counts[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts), pa.array(np.zeros(len(values), np.int64))], names=["shingle", "docs", "lost"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([own.docs]), pa.array([own.lost])], names=["shingle", "docs", "lost"])

    return run


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("text"):
            own, _ = shingles(text.as_py())
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["shingle"])


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros(len(known), np.int64)
        for batch in batches:
            for text in batch.column("text"):
                own, _ = shingles(text.as_py())
                if len(own):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    counts[at[known[at] == own]] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(known[seen].view(np.int64)), pa.array(counts[seen])], names=["shingle", "docs"])

    return run


def _sorted_hashes(rows) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)


def document_frequencies(texts: DataFrame, theta: float = THETA) -> Weights:
    """texts: (text). Exact document frequencies of the shingles in more than theta of all texts."""
    spark = texts.sparkSession
    total = texts.count()
    wide = texts.coalesce(max(1, total // TASK_DOCS))
    summed = materialize(wide.mapInArrow(_summarise(theta), "shingle long, docs long, lost long").groupBy("shingle").agg(F.sum("docs").alias("docs"), F.sum("lost").alias("lost")))
    n_docs, lost = summed.where("shingle IS NULL").agg(F.sum("docs"), F.sum("lost")).first()
    n_docs = n_docs or 0
    maybe = summed.where(F.col("shingle").isNotNull() & (F.col("docs") > theta * n_docs - (lost or 0))).select("shingle")
    if n_docs and (lost >= theta * n_docs or maybe.count() > CANDIDATES):
        counted = texts.mapInArrow(_all_shingles, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("docs"))
        hashes, counts = _sorted_hashes(counted.where(F.col("docs") > theta * n_docs).collect())
    else:
        known = np.sort(np.array([r[0] for r in maybe.collect()], np.int64).view(np.uint64))
        hashes, counts = known, np.empty(0, np.int64)
        if len(known):
            shared = spark.sparkContext.broadcast(known)
            rows = texts.mapInArrow(_count(shared), "shingle long, docs long").groupBy("shingle").agg(F.sum("docs").alias("docs"))
            hashes, counts = _sorted_hashes(rows.where(F.col("docs") > theta * n_docs).collect())
            shared.unpersist()
    release(summed)
    return Weights(n_docs, hashes, counts, theta)


def _sign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, sample = shared.value, Sampler()
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                rows = batch.slice(lo, 16)
                keys, draws = _sign_rows(rows.column("text").to_pylist(), weigh, sample)
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("t"), pa.array(keys, pa.string()), pa.array(draws, pa.binary())], names=["id", "t", "k", "draws"])

    return run


def _key(folded: bytes, text: str) -> str:
    """Equal for texts with equal words; for texts without words, for equal texts."""
    words = folded.split()
    return hashlib.md5(b" ".join(words) if words else b"\0" + text.encode("utf-8", "surrogatepass")).hexdigest()


def _sign_rows(texts: list[str | None], weigh: Weights, sample: Sampler) -> tuple[list, list]:
    keys, draws, held = [], [None] * len(texts), []
    for k, text in enumerate(texts):
        if text is None:
            keys.append(None)
            continue
        folded = text.encode("utf-8", "surrogatepass").translate(FOLD)
        keys.append(_key(folded, text))
        own, counts = _shingles(word_hashes(folded))
        if len(own):
            held.append((k, own, weigh(own, counts)))
    if held:
        starts = np.concatenate(([0], np.cumsum([len(x) for _, x, _ in held])[:-1]))
        found = sample(np.concatenate([x for _, x, _ in held]), np.concatenate([w for _, _, w in held]), starts)
        for (k, _, _), row in zip(held, found):
            draws[k] = row.tobytes()
    return keys, draws


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.frombuffer(b"".join(x.as_py() for x in batch.column("draws")), np.uint64).reshape(-1, DRAWS)
        h = np.zeros((len(rows), BANDS), np.uint64)
        for r in range(ROWS):
            h = _mix(h * _STEP + rows[:, r::ROWS])
        h = _mix(h + np.arange(BANDS, dtype=np.uint64))
        k = batch.column("k").take(pa.array(np.repeat(np.arange(len(rows)), BANDS)))
        yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), k], names=["bucket", "k"])


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x


def _pairs(keys: list[str], draws: np.ndarray) -> list[tuple[str, str]]:
    """Candidates of one bucket."""
    n, out = len(keys), []
    short = draws.astype(np.uint32)
    if n <= SMALL:
        for i in range(n - 1):
            agree = (short[i + 1 :] == short[i]).sum(1)
            out += [(keys[i], keys[j + i + 1]) for j in np.flatnonzero(agree >= AGREE)]
        return out
    # Prim's algorithm for the maximum spanning forest; the rows it computes also give the nearest neighbours.
    best, link, left = np.full(n, -1), np.full(n, -1), np.ones(n, bool)
    while left.any():
        i = int(np.where(left, best, -2).argmax())
        left[i] = False
        if best[i] >= AGREE:
            out.append((keys[i], keys[link[i]]))
        agree = (short == short[i]).sum(1)
        agree[i] = -1
        near = np.argpartition(agree, -NEAREST)[-NEAREST:]
        out += [(keys[i], keys[j]) for j in near[agree[near] >= AGREE]]
        closer = left & (agree > best)
        best[closer], link[closer] = agree[closer], i
    return out


def _links(keys: list[str], roots: list[str], blobs: list[bytes], threshold: float, asks: list[bool] | None = None) -> list[tuple[str, str]]:
    """Links between the components of one bucket, enough to join all that have any: exact similarities of one
    member to all others at a time, from posting lists of the bucket's shingles. ``asks`` are the members to ask
    for; without it, all outside the largest component."""
    names, label = np.unique(np.array(roots), return_inverse=True)
    sizes_of = np.bincount(label)
    ask = label != int(sizes_of.argmax()) if asks is None else np.array(asks, bool)
    forest, out, left = _Forest(len(names)), [], len(names)
    if left < 2 or not ask.any():
        return out
    sets = [_parse(x) for x in blobs]
    sizes = np.array([len(h) for h, _ in sets])
    member = np.repeat(np.arange(len(sets)), sizes)
    hashes, weights = np.concatenate([h for h, _ in sets]), np.concatenate([w for _, w in sets])
    total = np.bincount(member, weights, len(sets))
    order = np.argsort(hashes, kind="stable")
    values, starts = np.unique(hashes[order], return_index=True)
    stops = np.append(starts[1:], len(order))
    at = np.searchsorted(values, hashes)
    member_of, weight_of = member[order], weights[order]
    first = np.concatenate(([0], np.cumsum(sizes)))
    asking = np.flatnonzero(ask)
    for i in asking[np.argsort(sizes_of[label[asking]], kind="stable")].tolist():
        own = slice(first[i], first[i + 1])
        lo, n = starts[at[own]], (stops - starts)[at[own]]
        entries = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        least = np.bincount(member_of[entries], np.minimum(weight_of[entries], np.repeat(weights[own], n)), len(sets))
        similar = least >= threshold * (total + total[i] - least)
        for j in np.flatnonzero(similar & (label != label[i])).tolist():
            x, y = forest.root(int(label[i])), forest.root(int(label[j]))
            if x != y:
                forest.up[x] = y
                out.append((keys[i], keys[j]))
                left -= 1
        if left == 1:
            break
    return out


def _by_bucket(columns: tuple[str, ...], kind):
    """Rows sorted by bucket; ``kind`` gives a bucket's pairs from its members' columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [[] for _ in columns], []

        def flush():
            if len(held[0]) > 1:
                found.extend(kind(*held))
            for x in held:
                x.clear()

        def pairs():
            out = pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.string()), pa.array([max(x) for x in found], pa.string())], names=["u", "v"])
            found.clear()
            return out

        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", *columns))):
                if bucket != now:
                    flush()
                    now = bucket
                    if len(found) > 50_000:
                        yield pairs()
                for x, y in zip(held, row):
                    x.append(y)
        flush()
        if found:
            yield pairs()

    return run


def _candidates(keys: list[str], draws: list[bytes]) -> list[tuple[str, str]]:
    return _pairs(keys, np.frombuffer(b"".join(draws), np.uint64).reshape(-1, DRAWS))


def _blob(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = shared.value
        for batch in batches:
            blobs = []
            for text in batch.column("text"):
                own, counts = shingles(text.as_py())
                blobs.append(own.tobytes() + weigh(own, counts).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(blobs, pa.binary())], names=["k", "blob"])

    return run


def _parse(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 12
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.float32, n, 8 * n).astype(np.float64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over the sum of the greater ones; shingles ascending."""
    total = a[1].sum() + b[1].sum()
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    least = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(least / (total - least)) if total else 0.0


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, own, keep = None, None, []
            for u, a, b in zip(batch.column("u"), batch.column("a"), batch.column("b")):
                if (u := u.as_py()) != last:
                    last, own = u, _parse(a.as_py())
                keep.append(weighted_jaccard(own, _parse(b.as_py())) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_of(n: str = "n"):
    return F.pmod(F.xxhash64("k"), F.ceil(F.col(n) / BLOCK)).cast("int")


def _blocks(buckets: DataFrame) -> DataFrame:
    """Hot buckets as one bucket for each block with the representatives. buckets: bucket, k, n, block."""
    hot = buckets.where(F.col("n") > HOT)
    # The least key of each of so many slots: partial minima, so that no task sees a whole hot bucket.
    guests = hot.groupBy("bucket", "n", F.pmod(F.xxhash64("k", F.lit(1)), F.lit(GUESTS)).alias("slot")).agg(F.min("k").alias("k"))
    guests = guests.select("bucket", "k", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / BLOCK) - 1).cast("int"))).alias("block"))
    cells = hot.select("bucket", "k", "block").unionByName(guests).select(F.xxhash64("bucket", "block").alias("bucket"), "k").distinct()
    return buckets.where(F.col("n") <= HOT).select("bucket", "k").unionByName(cells)


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Buckets that hold several components: bucket, k, root, ask. Hot ones are cut into pairs of blocks: members left
    outside the largest component of one block, which ask, and all members of the other. members: bucket, k, n, block."""
    rooted = members.where(F.col("n") > SMALL).join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    sizes = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"))
    split = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("components"), F.max_by("root", F.struct("size", "root")).alias("largest")).where("components > 1")
    open_ones = materialize(rooted.join(split.select("bucket", "largest"), "bucket"))
    small = open_ones.where(F.col("n") <= HOT).select("bucket", "k", "root", F.lit(None).cast("boolean").alias("ask"))
    hot = open_ones.where(F.col("n") > HOT).withColumn("ask", F.col("root") != F.col("largest"))
    asking = hot.where("ask")
    of = asking.select("bucket", F.col("block").alias("i")).distinct()
    answers = hot.join(of, "bucket").select("bucket", "i", F.col("block").alias("j"), "k", "root", (F.col("ask") & (F.col("i") == F.col("block"))).alias("ask"))
    others = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / BLOCK) - 1).cast("int")))
    askers = asking.select("bucket", F.col("block").alias("i"), others.alias("j"), "k", "root", "ask").where("i <> j")
    pairs = answers.unionByName(askers).select(F.xxhash64("bucket", "i", "j").alias("bucket"), "k", "root", "ask")
    return small.unionByName(pairs)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, theta: float) -> DataFrame:
    """One row per document: id, t (a hash of the text), class_id, and keeper, the (id, t) of the one that stays."""
    spark = docs.sparkSession
    python_ready(spark)
    rows = _rows(docs, id_col, text_col)
    weights = spark.sparkContext.broadcast(document_frequencies(rows.select("text"), theta))
    id_type = rows.schema["id"].dataType.simpleString()
    signed = materialize(rows.mapInArrow(_sign(weights), f"id {id_type}, t long, k string, draws binary"))
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "t")
    texts = signed.where("k IS NOT NULL").groupBy("k").agg(F.first("draws").alias("draws"), F.min("id").alias("least"), F.min(first).alias("owner"))
    texts = materialize(texts)

    narrow = materialize(texts.where("draws IS NOT NULL").select("k", "draws").mapInArrow(_band, "bucket long, k string"))
    shared_keys = narrow.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(narrow.join(shared_keys, "bucket").withColumn("block", F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / BLOCK)).cast("int")))
    release(narrow)

    def blobs(needed: DataFrame) -> DataFrame:
        """(k, blob): the weighted shingles of some nodes."""
        owners = texts.join(needed.select("k").distinct(), "k", "left_semi").select("k", F.col("owner.id").alias("owner_id"), F.col("owner.t").alias("owner_t"))
        owned = rows.join(owners, F.col("id").eqNullSafe(F.col("owner_id")) & (F.col("t") == F.col("owner_t"))).select("k", "text")
        return materialize(owned.mapInArrow(_blob(weights), "k string, blob binary").groupBy("k").agg(F.first("blob").alias("blob")))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket").sortWithinPartitions("bucket", "k")

    with_draws = _blocks(members).join(texts.select("k", "draws"), "k")
    pairs = materialize(dealt(with_draws).mapInArrow(_by_bucket(("k", "draws"), _candidates), "u string, v string").distinct())
    sets = blobs(pairs.select(F.col("u").alias("k")).unionByName(pairs.select(F.col("v").alias("k"))))
    left, right = (sets.withColumnsRenamed({"k": k, "blob": x}) for k, x in (("u", "a"), ("v", "b")))
    roots = components(pairs.join(right, "v").join(left, "u").select("u", "v", "a", "b").mapInArrow(_verify(threshold), "u string, v string"))
    release(pairs, sets)

    rest = materialize(_unsettled(members, roots))
    release(members)
    if not rest.isEmpty():
        resolve = lambda keys, of, held, ask: _links(keys, of, held, threshold, None if ask[0] is None else ask)
        own = blobs(rest)
        more = materialize(dealt(rest.join(own, "k")).mapInArrow(_by_bucket(("k", "root", "blob", "ask"), resolve), "u string, v string").distinct())
        release(own)
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))  # roots join what the links do
    release(rest)
    node = texts.select("k", "least", "owner").join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    each = node.groupBy("root").agg(F.min("least").alias("class_id"), F.min("owner").alias("keeper"))
    classes = node.select("k", "root").join(each, "root").select("k", "class_id", "keeper")
    return signed.select("id", "t", "k").join(classes, "k", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, theta: float = THETA) -> DataFrame:
    """One row per document: ``id_col`` and class_id, the smallest id of its class."""
    found = _classes(docs, id_col, text_col, threshold, theta)
    return found.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, theta: float = THETA) -> DataFrame:
    """The documents of which one of each class stays: the one with the smallest id. Null texts stay."""
    found = _classes(docs, id_col, text_col, threshold, theta)
    kept = found.where(F.col("id").eqNullSafe(F.col("keeper.id")) & (F.col("t") == F.col("keeper.t"))).select("id", "t")
    kept = materialize(kept.groupBy("id", "t").agg(F.count(F.lit(1)).alias("n")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.where(F.col(text_col).isNotNull()).select(F.struct(*columns).alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_t"))
    out = own.join(kept, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_t") == F.col("t")))
    if not kept.where("n > 1").isEmpty():  # rows that repeat both id and text
        out = out.groupBy("row_id", "row_t").agg(F.min_by("row", F.struct(F.xxhash64(F.to_json("row")), F.to_json("row"))).alias("row"))
    return out.select("row.*").unionByName(docs.where(F.col(text_col).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs of texts that share a shingle, exactly; for small tables.
SQL = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, w, CASE WHEN text IS NULL THEN NULL WHEN len(w) = 0 THEN 'x' || text ELSE 'w' || array_to_string(w, ' ') END AS words
  FROM (SELECT doc_id, text, {SQL_WORDS} AS w FROM documents)),
node AS (SELECT row_number() OVER (ORDER BY min(doc_id)) AS k, words, any_value(w) AS w, min(doc_id) AS least, count(*) AS copies FROM t WHERE words IS NOT NULL GROUP BY words),
sh AS (SELECT k, copies, s, count(*) AS c
       FROM (SELECT k, copies, array_to_string(w[i:i + least({SHINGLE}, len(w)) - 1], ' ') AS s FROM node, range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1) r(i) WHERE len(w) > 0)
       GROUP BY ALL),
idf AS (SELECT s, 1 + ln(n / greatest(sum(copies), {THETA} * n)) / (2 * ln(1 / {THETA})) AS idf FROM sh, (SELECT count(*) AS n FROM documents) GROUP BY s, n),
weighed AS (SELECT k, s, c * idf AS x FROM sh JOIN idf USING (s)),
total AS (SELECT k, sum(x) AS x FROM weighed GROUP BY k),
shared AS (SELECT a.k AS u, b.k AS v, sum(least(a.x, b.x)) AS least FROM weighed a JOIN weighed b ON a.s = b.s AND a.k < b.k GROUP BY ALL),
link AS (SELECT u, v FROM shared JOIN total a ON a.k = u JOIN total b ON b.k = v WHERE least >= {SIMILARITY} * (a.x + b.x - least)),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT k, k AS r FROM node UNION SELECT edge.v, r FROM reach JOIN edge ON edge.u = reach.k),
class AS (SELECT reach.k, min(other.least) AS class_id FROM reach JOIN node other ON other.k = r GROUP BY ALL)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id FROM t LEFT JOIN node USING (words) LEFT JOIN class USING (k)
"""
