"""Exact substring deduplication by external induced suffix sorting.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (in a document with a smaller id, or
earlier in the same one) is removed; matches never cross documents.

Dealing out. All windows of ``LENGTH`` bytes are assigned content-defined anchors, and the windows of one anchor
form a block. Equal windows have equal anchors, so blocks are dealt by their anchor's hash, and equal windows meet.
A block that is equal as a whole to an earlier one is not sorted again: all its windows start earlier. Blocks are
told apart by 192 bits, of their anchor and twice of the whole. Anchors with one block have nothing to share.

Sorting. What is left, anchors with several different blocks, makes up the shards. A shard streams into files; its
text, and all that is made of it, is in memory only up to a budget. Its suffixes are put in order, with their common
prefixes, by external induced sorting (``induced``): bulk queues of (symbol, position, common prefix) tuples with
their ranges on disk, through the recursion on named substrings. Neighbours in that order with a common prefix of at
least ``LENGTH`` are equal windows, and the earliest one of each run of them stays. What a shard keeps in memory for
each block are two keys and its place in the text, 24 bytes.

Hot strings. Copies of a block within a batch of documents never leave it. An anchor next to a passage that very
many documents share has a different block in each of them. Blocks of anchors with more than ``HOT`` are cut into
pieces by how far windows reach to the left of the anchor, and dealt by the bytes that all windows of a piece have in
common; keys that are still as crowded are cut again, down to single windows. Windows that lie in the passage become
equal pieces, of which one a batch remains; those that reach beyond it get different keys. So no shard gets more than
its share of a passage, however many documents hold it.

Defined results
    * A null text is empty. Texts shorter than ``LENGTH`` bytes lose nothing. Ids are integers of any width.
    * Rows with a null id come before all others, as the least id. Rows that repeat an id are ordered by a hash
      of their text; rows that repeat both are one document, and each of them gets its result.
    * Texts of any length are read in pieces that overlap by ``LENGTH - 1`` bytes, so no window is missed.
    * An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .anchors import Sums, blocks, mix
from .common import materialize, python_ready, release, table
from .induced import PAD, STEP, Spool, Workspace, suffix_order

LENGTH = 100
GRAM = 32
PIECE = 1 << 20
SHARD_BYTES = 2 << 20
LEAST_ID = -(1 << 63)

#: Blocks of an anchor, or pieces of a key, from which on they are cut.
HOT = 1000
#: shape: whether the block is a copy within its batch, its number of windows, and the offset of its anchor, in 8 bits each.
_ROW = "shape int, anchor long, block long, more long, doc long, t long, lo long"


def _blocks(length: int):
    """Blocks; those that are copies within a batch are marked."""
    names = [x.split()[0] for x in _ROW.split(", ")]

    def flush(texts: list[bytes], docs: list, starts: list):
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
        text, lo, n, anchor, a, b, c = blocks(data, offsets, length, GRAM)
        if not len(text):
            return None
        place = lo - offsets[text] + np.array(starts, np.int64)[text]
        return np.array([d[0] for d in docs], np.int64)[text], np.array([d[1] for d in docs], np.int64)[text], place, n, anchor - lo, a.view(np.int64), b.view(np.int64), c.view(np.int64)

    def settle(found: list) -> pa.RecordBatch:
        """Of equal blocks of this batch only the earliest goes on."""
        doc, t, place, n, off, a, b, c = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((place, t, doc, c, b, a))
        again = np.zeros(len(order), np.int64)
        again[order[1:]] = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (a, b, c)])
        return pa.RecordBatch.from_arrays([pa.array((again << 16 | n << 8 | off).astype(np.int32)), *(pa.array(x) for x in (a, b, c, doc, t, place))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held, size = [], ([], [], []), 0

            def put(piece: bytes, doc, start: int):
                nonlocal size
                for x, y in zip(held, (piece, doc, start)):
                    x.append(y)
                size += len(piece)
                if size >= PIECE:
                    empty()

            def empty():
                nonlocal size
                if held[0] and (got := flush(*held)) is not None:
                    found.append(got)
                for x in held:
                    x.clear()
                size = 0

            for doc, t, text in zip(batch.column("doc").to_pylist(), batch.column("t").to_pylist(), batch.column("text")):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for start in range(0, max(1, len(data) - length + 1), PIECE):
                    if len(data) >= length:
                        put(data[start : start + PIECE + length - 1], (doc, t), start)
            empty()
            if found:
                yield settle(found)

    return run


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of blocks, from whole texts and their lists of blocks."""
    for batch in batches:
        rows = [[], [], [], [], [], [], []]
        for doc, t, text, own in zip(batch.column("doc").to_pylist(), batch.column("t").to_pylist(), batch.column("text"), batch.column("blocks").to_pylist()):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for x in own:
                for column, value in zip(rows, (x["anchor"], doc, t, x["lo"], x["off"], x["hot"], data[x["lo"] : x["lo"] + x["size"]])):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in rows[:5]), pa.array(rows[5], pa.bool_()), pa.array(rows[6], pa.binary())], names=["key", "doc", "t", "lo", "off", "hot", "data"])


# Pieces of crowded anchors.

_PIECE = "key long, doc long, t long, lo long, reach int, least int, most int, data binary"


def _piece_key(data: bytes, reach: int, least: int, most: int, length: int) -> int:
    """Of the bytes that all windows whose reach to the left of the anchor is from ``least`` to ``most`` have in common."""
    core = data[reach - least : reach + length - most]
    return int.from_bytes(hashlib.blake2b(bytes((least, most)) + core, digest_size=8).digest(), "little", signed=True)


def _halves(data: bytes, lo: int, reach: int, least: int, most: int, length: int) -> Iterator[tuple[bytes, int, int, int, int]]:
    """A piece's windows that reach far to the left, and the others, as pieces."""
    n, middle = len(data) - length + 1, (least + most) // 2
    far = min(n, reach - middle)  # windows of the first half
    if far > 0:
        yield data[: far + length - 1], lo, reach, middle + 1, most
    if far < n:
        skip = max(0, far)
        yield data[skip:], lo + skip, reach - skip, least, middle


def _split(length: int, whole: bool):
    """Halves of pieces, or (``whole``) of blocks; of pieces that are equal within a batch only the earliest goes on, the others have no data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first = [], {}
            bounds = ([0] * batch.num_rows, [length - GRAM] * batch.num_rows) if whole else (batch.column("least").to_pylist(), batch.column("most").to_pylist())
            reaches = batch.column("off" if whole else "reach").to_pylist()
            for doc, t, lo, reach, least, most, data in zip(batch.column("doc").to_pylist(), batch.column("t").to_pylist(), batch.column("lo").to_pylist(), reaches, *bounds, batch.column("data").to_pylist()):
                for part in _halves(data, lo, reach, least, most, length):
                    own, at, r, a, b = part
                    same = (a, b, own)
                    if same not in first or (doc, t, at) < first[same]:
                        first[same] = (doc, t, at)
                    rows.append((doc, t, at, r, a, b, own))
            seen, out = set(), []
            for doc, t, at, r, a, b, own in rows:
                same = (a, b, own)
                if first[same] == (doc, t, at) and same not in seen:
                    seen.add(same)
                    out.append((_piece_key(own, r, a, b, length), doc, t, at, r, a, b, own))
                else:
                    out.append((None, doc, t, at, len(own), a, b, None))  # its bytes, in place of its reach
            columns = list(zip(*out)) or [[]] * 8
            types = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, types)], names=[x.split()[0] for x in _PIECE.split(", ")])

    return run


def _pieces(hot: DataFrame, length: int) -> DataFrame:
    """Pieces of crowded blocks, cut until no key is crowded or its pieces are single windows; those that are known to start earlier elsewhere have no data."""
    now, done = materialize(hot.mapInArrow(_split(length, True), _PIECE)), []
    while True:
        crowded = materialize(now.where("data IS NOT NULL AND most > least").groupBy("key").count().where(F.col("count") > HOT).select("key"))
        n = crowded.count()  # each stands for more than HOT rows
        if not n:
            break
        keys = F.broadcast(crowded) if n <= 1 << 20 else crowded
        done.append(now.join(keys, "key", "left_anti").select(now.columns))
        now = materialize(now.join(keys, "key", "left_semi").select(now.columns).mapInArrow(_split(length, False), _PIECE))
    release(crowded)
    for more in done:
        now = now.unionByName(more)
    return now


# Shards.


class _Shard:
    """Blocks and pieces as they come, in files; then the windows that are equal to an earlier one."""

    def __init__(self, space: Workspace, length: int):
        self.space, self.length, self.side = space, length, (length - GRAM + 1) // 2
        self.raw, self.rows, self.sizes, self.keys = Spool(space, np.uint8), Spool(space), Spool(space), Spool(space, np.uint64)

    def add(self, key: np.ndarray, doc: np.ndarray, t: np.ndarray, lo: np.ndarray, off: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Two blocks of an anchor share a window only if they agree on one side of it: a window reaches ``side`` bytes beyond the
        anchor to its left or to its right. Pieces (without offset) share one only if they have one key."""
        starts = np.cumsum(sizes) - sizes
        at, sums = starts + off, Sums(flat)
        both = np.zeros((len(sizes), 2), np.uint64)
        for k, (a, b) in enumerate(((at - self.side, at + GRAM), (at, at + GRAM + self.side))):
            inside = np.flatnonzero((off >= 0) & (a >= starts) & (b <= starts + sizes))
            both[inside, k] = mix(sums.of(a[inside], b[inside]) + np.uint64(k + 1))
        piece = off < 0
        both[piece, 0] = mix(key[piece].view(np.uint64) + np.uint64(7))
        self.raw.append(flat)
        self.sizes.append(sizes)
        self.rows.append(np.stack((doc, t, lo), 1).reshape(-1))
        self.keys.append(both.reshape(-1))

    def _text(self) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]:
        """Blocks that may share a window, with a separator behind each, and the end: the text, its length, the start and size of each block, and its rows."""
        keys, sizes, rows, raw = self.keys.take(), self.sizes.take(), self.rows.take().reshape(-1, 3), self.raw.take()
        ordered = np.sort(keys[keys != 0])
        shared = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(shared):
            return np.empty(0, np.uint16), 0, sizes[:0], sizes[:0], rows[:0]
        keep = (shared[np.minimum(np.searchsorted(shared, keys), len(shared) - 1)] == keys).reshape(-1, 2).any(1)
        own = np.flatnonzero(keep)
        to = np.concatenate(([0], np.cumsum(sizes[own] + 1)))
        n = int(to[-1]) + 1
        data, done = self.space.array(n + PAD, np.uint16), 0
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 8 * STEP)))
            size, kept = sizes[lo:hi], keep[lo:hi]
            flat = np.asarray(raw[ends[lo] - sizes[lo] : ends[hi - 1]])[np.repeat(kept, size)].astype(np.uint16) + 2
            size = size[kept]
            part = np.ones(len(flat) + len(size), np.uint16)
            part[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = flat
            data[done : done + len(part)] = part
            done, lo = done + len(part), hi
        return data, n, to[:-1], sizes[own], rows[own]

    def late(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """doc, t, start and stop of runs of windows that are equal to earlier ones."""
        data, n, to, sizes, rows = self._text()
        if not n:
            return
        order, common = suffix_order(data, n, self.length, self.space)
        del data
        late = self.space.array(n, bool)
        best = None  # the earliest of the run that goes on: (doc, t, window, position)
        for lo in range(0, n, STEP):
            at, linked = np.asarray(order[lo : lo + STEP]), np.asarray(common[lo : lo + STEP]) >= self.length
            follows = lo + len(at) < n and common[lo + len(at)] >= self.length
            member = linked | np.append(linked[1:], follows)
            if not linked[0]:
                best = None
            own = np.flatnonzero(member)
            place = at[own]
            block = np.searchsorted(to, place, "right") - 1
            # Suffixes of a run have all their first symbols in common: they are all windows, or all reach over a separator.
            inside = (block < len(to)) & (place + self.length <= to[block] + sizes[block])
            own, place, block = own[inside], place[inside], block[inside]
            follows = follows and len(own) > 0 and own[-1] == len(at) - 1
            if not len(own):
                best = None
                continue
            if own[0]:
                best = None
            doc, t, window = rows[block, 0], rows[block, 1], rows[block, 2] + place - to[block]
            run = np.cumsum(~linked[own])
            rank = np.lexsort((window, t, doc, run))
            first = np.concatenate(([True], np.diff(run[rank]) != 0))
            late[place[rank[~first]]] = True
            heads = rank[first]
            if best is not None:  # the first run began before
                head = heads[0]
                mine = (int(doc[head]), int(t[head]), int(window[head]), int(place[head]))
                late[max(mine, best)[3]] = True
                best = min(mine, best)
            if follows:
                head = heads[-1]
                if len(heads) > 1 or best is None:
                    best = (int(doc[head]), int(t[head]), int(window[head]), int(place[head]))
            else:
                best = None
        del order, common
        for lo in range(0, n, 8 * STEP):
            place = np.flatnonzero(late[lo : lo + 8 * STEP]) + lo
            if len(place):
                block = np.searchsorted(to, place, "right") - 1
                cut = np.flatnonzero(np.concatenate(([True], (np.diff(block) != 0) | (np.diff(place) != 1))))
                end = np.concatenate((cut[1:], [len(place)])) - 1
                b = block[cut]
                yield rows[b, 0], rows[b, 1], rows[b, 2] + place[cut] - to[b], rows[b, 2] + place[end] - to[b] + self.length


def _shards(length: int, budget: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Workspace(*(() if budget is None else (budget,))) as space:
            shard = _Shard(space, length)
            for batch in batches:
                if batch.num_rows:
                    data = batch.column("data").cast(pa.large_binary())
                    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
                    flat = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                    shard.add(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc", "t", "lo", "off")), flat.copy(), np.diff(offsets))
            for columns in shard.late():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc", "t", "start", "stop"])

    return run


def _settled(found: DataFrame, length: int) -> DataFrame:
    """One exchange by anchor settles equal blocks and tells which anchors have several different ones, and which are crowded:
    anchor, doc, t, lo, size, off, late, hot."""
    copied = F.col("shape") >= 1 << 16
    # Copies within a batch are late already; they are spread out.
    found = found.withColumn("copied", copied).withColumn("by", F.when(copied, F.xxhash64("doc", "lo")).otherwise(F.col("anchor")))
    own = W.partitionBy("by", "copied", "anchor")
    copy = F.row_number().over(W.partitionBy("by", "copied", "anchor", "block", "more").orderBy("doc", "t", "lo"))
    differ = lambda c: F.min(c).over(own) != F.max(c).over(own)
    found = found.select("*", copy.alias("copy"), (differ("block") | differ("more")).alias("several"), (F.count(F.lit(1)).over(own) > HOT).alias("hot"))
    late = F.col("copied") | (F.col("copy") > 1)
    size = F.expr(f"(shiftright(shape, 8) & 255) + {length - 1}")
    return found.where("copied OR copy > 1 OR several").select("anchor", "doc", "t", "lo", size.alias("size"), F.expr("shape & 255").cast("long").alias("off"), late.alias("late"), "hot")


def _unique_ids(rows: DataFrame) -> bool:
    return rows.groupBy("doc").count().where("count > 1").isEmpty()


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(rows: id, doc, t, text; spans: doc, t, spans). Spans are byte ranges, not yet merged; (doc, t) tell documents apart."""
    spark = docs.sparkSession
    python_ready(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("doc"), F.col(text_col).alias("text"))
    unique = _unique_ids(rows.select("doc"))
    rows = rows.withColumn("t", F.lit(0).cast("long") if unique else F.xxhash64("text"))
    source = rows.select("doc", "t", "text")
    if not unique:
        source = source.dropDuplicates(["doc", "t"])
    found = source.mapInArrow(_blocks(length), _ROW)

    settled = materialize(_settled(found, length))

    open_blocks = settled.where("NOT late")
    total, hot = open_blocks.agg(F.sum("size"), F.count_if("hot")).first()
    by_doc = open_blocks.groupBy("doc", "t").agg(F.collect_list(F.struct("anchor", "lo", "size", "off", "hot")).alias("blocks"))
    cut = source.join(by_doc, ["doc", "t"]).mapInArrow(_cut_blocks, "key long, doc long, t long, lo long, off long, hot boolean, data binary")
    spans = settled.where("late").select("doc", "t", F.col("lo").alias("start"), (F.col("lo") + F.col("size")).alias("stop"))
    held = [settled]
    if hot:
        cut = materialize(cut)
        held.append(cut)
        pieces = _pieces(cut.where("hot"), length)
        spans = spans.unionByName(pieces.where("data IS NULL").select("doc", "t", F.col("lo").alias("start"), (F.col("lo") + F.col("reach")).alias("stop")))
        cut = cut.where("NOT hot").drop("hot").unionByName(pieces.where("data IS NOT NULL").select("key", "doc", "t", "lo", F.lit(-1).cast("long").alias("off"), "data"))
    shards = max(2 * spark.sparkContext.defaultParallelism, -(-(total or 0) // SHARD_BYTES))
    more = cut.select("key", "doc", "t", "lo", "off", "data").repartition(shards, "key").mapInArrow(_shards(length), "doc long, t long, start long, stop long")
    spans = spans.unionByName(more)
    spans = materialize(spans.groupBy("doc", "t").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    release(*held)
    return rows, spans


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["stop"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, kept, cuts = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            merged = _merged(spans)
            sizes.append(len(data))
            cuts.append([{"start": a, "stop": b} for a, b in merged])
            ends = [0, *(b for _, b in merged)]
            kept.append(b"".join(data[e:a] for e, a in zip(ends, [*(a for a, _ in merged), len(data)])))
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(cuts, spans), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: id_col, n_bytes, spans (removed byte ranges, apart from each other) and kept (the other bytes)."""
    rows, spans = removed_spans(docs, id_col, text_col, length)
    kind = docs.schema[id_col].dataType.simpleString()
    both = rows.join(spans, ["doc", "t"], "left").select("id", "text", "spans")
    return both.mapInArrow(_cut, f"id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple[int, int, int, int, str]]:
    """The query's rows for a few documents, by a dictionary of all windows."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                gone[k : k + length] = True
            seen.add(window)
        runs = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((doc, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


#: Every window by its MD5; for small tables.
SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, md5(b[p + 1:p + {LENGTH}]) AS h FROM d, range(0, octet_length(b) - {LENGTH - 1}) t(p)),
late AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1),
run AS (SELECT *, sum(CASE WHEN p <= before + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
        FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM late)),
span AS (SELECT doc_id, min(p) AS lo, max(p) + {LENGTH} AS hi FROM run GROUP BY doc_id, run),
cut AS (SELECT doc_id, lo, hi FROM span UNION ALL SELECT doc_id, octet_length(b), octet_length(b) FROM d),
piece AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi), 0) AS since FROM cut),
kept AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) - 1 AS n_spans, string_agg(hex(b[since + 1:lo]), '' ORDER BY lo, hi) AS kept FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN kept USING (doc_id)
"""
