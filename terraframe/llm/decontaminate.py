"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items go into one suffix automaton. Documents are streamed through it word
by word; the automaton's state and the longest matching length say, at each word, which item windows end
there. Every word covered by an occurring window is hit. Hit spans at or above the length limit are cut from
the text, and a document whose hit words exceed the coverage limit is removed.

A word outside the items' vocabulary resets the automaton to its root, so only runs of known words at least
as long as the shortest window are streamed; nothing else can hold a window.

The automaton is broadcast. Its size is checked first: items are dealt into parts of at most ``PART_BYTES``
of text. With several parts a first pass keeps aside the documents with a window that may be one of the items':
hashes of all items' windows are marked in a bitmap (``BITS`` bits a window, at most ``MOST_BITS``, which is
broadcast). Only these documents pass through one part's automaton after another, each pass written to the shared
folder; the others are not written anywhere. The bitmap errs on the safe side only: without a mark there is no window.

Defined results
    * A null or empty text has no words: nothing is hit, coverage is 0, the text stays as it is.
    * Items with null, empty or word-free text have no window. A null item id counts as the id ``null``, and so as
      the same item as one of that name.
    * Texts of any length are scanned whole, one at a time.
    * Rows repeating an item id count as one item; documents that repeat an id are judged each by itself.
    * Without items no word is hit. Columns of the input pass through; names the operator adds win.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash60, materialize, python_ready, release, table

WINDOW = 10
MAX_COVERAGE = 0.5
PART_BYTES = 2 << 20
BITS, MOST_BITS, PROBES = 64, 1 << 29, 6
#: Bytes that are not part of a word become blanks, A-Z become a-z; every byte of a character outside ASCII is part of a word.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over item words, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.go: dict[int, int] = {}  # state << 32 | word: next state
        self.link, self.length = [-1], [0]
        out: list[list[int]] = [[]]  # words that leave a state, to copy them
        texts = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if ids:
                texts.append((item, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c, out)
        n = len(self.link)
        self.least = min([window, *(len(ids) for _, ids in texts)])
        order = sorted(range(n), key=self.length.__getitem__)
        self.anchor = [-1] * n  # the state that holds the last `window` words of this one
        for s in order[1:]:
            up = self.link[s]
            self.anchor[s] = s if self.length[up] < window <= self.length[s] else self.anchor[up]
        ends: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        for item, ids in texts:
            s = 0
            for c in ids:
                s = self.go[s << 32 | c]
                if self.anchor[s] >= 0:
                    ends.setdefault(self.anchor[s], set()).add(item)
            if len(ids) < window:
                whole.setdefault(s, []).append((len(ids), item))
        self.ends = {s: sorted(x) for s, x in ends.items()}
        self.short: dict[int, list[tuple[int, str]]] = {}  # whole items of fewer words that end in this state
        for s in order[1:]:
            if found := whole.get(s, []) + self.short.get(self.link[s], []):
                self.short[s] = found

    def _extend(self, last: int, c: int, out: list[list[int]]) -> int:
        go, link, length = self.go, self.link, self.length
        if (q := go.get(last << 32 | c)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, c, q, out)
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        out.append([])
        p = last
        while p >= 0 and (p << 32 | c) not in go:
            go[p << 32 | c] = new
            out[p].append(c)
            p = link[p]
        if p >= 0:
            q = go[p << 32 | c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q, out)
        return new

    def _split(self, p: int, c: int, q: int, out: list[list[int]]) -> int:
        go, link, length = self.go, self.link, self.length
        copy = len(link)
        link.append(link[q])
        length.append(length[p] + 1)
        out.append(list(out[q]))
        for x in out[q]:
            go[copy << 32 | x] = go[q << 32 | x]
        link[q] = copy
        while p >= 0 and go.get(p << 32 | c) == q:
            go[p << 32 | c] = copy
            p = link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal spans [start, end) of hit words, and the items whose windows occur."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, ends = known[::2], known[1::2]
        long = ends - starts >= self.least
        spans: list[list[int]] = []
        items: set[str] = set()
        go, link, length, anchor, window = self.go, self.link, self.length, self.anchor, self.window
        for lo, hi in zip(starts[long].tolist(), ends[long].tolist()):
            s = matched = 0
            for i, c in enumerate(ids[lo:hi].tolist(), lo):
                while (t := go.get(s << 32 | c)) is None and s:
                    s = link[s]
                    matched = length[s]
                if t is None:
                    continue
                s, matched = t, matched + 1
                most = 0
                if matched >= window:
                    # The state may hold fewer words than matched only if a link was followed, which set `matched`.
                    items.update(self.ends[anchor[s]])
                    most = window
                if s in self.short:
                    for n, item in self.short[s]:
                        if n <= matched:
                            items.add(item)
                            most = max(most, n)
                if most:
                    start = i + 1 - most
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return [(a, b) for a, b in spans], items


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from each span's first word to its last."""
    at = [m.span() for m in WORD.finditer(text)]
    parts, end = [], 0
    for a, b in spans:
        parts += (text[end : at[a][0]], "\n")
        end = at[b - 1][1]
    return "".join([*parts, text[end:]])


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ADDED = T.StructType().add("n_words", "long").add("hit_spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("items", T.ArrayType(T.StringType()))


def _step(automaton, text_col: str, kept: list[str], max_coverage: float | None = None):
    """Adds what was found; with a limit instead cuts it out of the texts, and leaves out those over the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton.value
        for batch in batches:
            names = batch.schema.names
            known = "hit_spans" in names
            before = batch.column("hit_spans").to_pylist() if known else None
            more = batch.column("items").to_pylist() if known else None
            n_words, spans, items = [], [], []
            for k, text in enumerate(batch.column(text_col)):
                words = words_of(text.as_py())
                found, of = own.scan(words) if words else ([], set())
                if known:
                    found = _merge(found + [(x["start"], x["end"]) for x in before[k]])
                    of |= set(more[k])
                n_words.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in found])
                items.append(sorted(of))
            columns = [batch.column(c) for c in kept]
            if max_coverage is not None:
                stay = [sum(x["end"] - x["start"] for x in own_spans) <= max_coverage * n for own_spans, n in zip(spans, n_words)]
                texts = [cut(t.as_py(), [(x["start"], x["end"]) for x in own_spans]) if own_spans else t.as_py() for t, own_spans in zip(batch.column(text_col), spans)]
                columns[kept.index(text_col)] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=kept).filter(pa.array(stay, pa.bool_()))
                continue
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))], names=[*kept, "n_words", "hit_spans", "items"])

    return run


def _parts(items: DataFrame, text_col: str) -> int:
    size = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return -(-size // PART_BYTES) or 1


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> Iterator[Automaton]:
    """One automaton per part of the items; never more than ``PART_BYTES`` of text, or one item, at a time."""
    texts = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text"))
    parts = _parts(texts, "text")
    for k in range(parts):
        part = texts.where(F.pmod(hash60(F.col("id"), F.col("text")), F.lit(parts)) == k) if parts > 1 else texts
        yield Automaton([(r["id"], r["text"]) for r in part.orderBy("id", "text").collect()], window)


def _window_hashes(words: list[bytes], sizes: list[int]) -> np.ndarray:
    """64-bit hashes of all runs of so many words."""
    own = np.fromiter((int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words), np.uint64, len(words))
    out = []
    for n in sizes:
        if len(own) >= n:
            h = np.zeros(len(own) - n + 1, np.uint64)
            for k in range(n):
                h = (h ^ own[k : len(own) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append(h)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    for k in range(PROBES):
        yield ((hashes + np.uint64(k) * step) % np.uint64(bits)).astype(np.int64)


class Marks:
    """A bitmap of the items' windows."""

    def __init__(self, windows: int, window: int):
        self.window, self.sizes = window, set()
        self.bits = min(MOST_BITS, max(1 << 10, BITS * windows))
        self.map = np.zeros(-(-self.bits // 8), np.uint8)

    def add(self, words: list[bytes]) -> None:
        if words:
            n = min(self.window, len(words))
            self.sizes.add(n)
            for at in _places(_window_hashes(words, [n]), self.bits):
                np.bitwise_or.at(self.map, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def meets(self, words: list[bytes]) -> bool:
        for n in sorted(self.sizes):
            left = _window_hashes(words, [n])
            marked = np.ones(len(left), bool)
            for at in _places(left, self.bits):
                marked &= (self.map[at >> 3] >> (at & 7)) & 1 > 0
            if marked.any():
                return True
        return False


def _marked(shared, text_col: str, wanted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            yield batch.filter(pa.array([marks.meets(words_of(t.as_py())) == wanted for t in batch.column(text_col)], pa.bool_()))

    return run


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", keep_text: bool = True, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_coverage: float | None = None) -> DataFrame:
    """The documents with n_words, hit_spans (word numbers, end exclusive) and items (ids as sorted strings).
    With ``max_coverage`` instead the documents within it, without their hit spans."""
    spark = docs.sparkSession
    python_ready(spark)
    added = ADDED.fieldNames()
    first = docs.select([c for c in (f"`{c}`" for c in docs.columns) if c.strip("`") not in added])
    if _parts(items, item_text) == 1:
        return _apply(spark, first, next(automata(items, item_id, item_text, window)), text_col, keep_text, max_coverage)
    marks = Marks(items.agg(F.sum(F.octet_length(item_text))).first()[0] // 2, window)
    for row in items.select(item_text).toLocalIterator():
        marks.add(words_of(row[0]))
    shared = spark.sparkContext.broadcast(marks)
    split = lambda wanted: first.mapInArrow(_marked(shared, text_col, wanted), first.schema)
    clean = _apply(spark, split(False), Automaton([], window), text_col, keep_text, max_coverage)
    out, previous = materialize(split(True)), None
    for automaton in automata(items, item_id, item_text, window):
        if previous is not None:
            before, out = out, materialize(_apply(spark, out, previous, text_col, True))
            release(before)
        previous = automaton
    return clean.unionByName(_apply(spark, out, previous, text_col, keep_text, max_coverage))


def _apply(spark: SparkSession, df: DataFrame, automaton: Automaton, text_col: str, keep_text: bool, max_coverage: float | None = None) -> DataFrame:
    kept = [c for c in df.columns if c not in ADDED.fieldNames() and (keep_text or c != text_col)]
    schema = T.StructType([df.schema[c] for c in kept] + (ADDED.fields if max_coverage is None else []))
    return df.mapInArrow(_step(spark.sparkContext.broadcast(automaton), text_col, kept, max_coverage), schema)


def n_hit():
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE, **kw) -> DataFrame:
    """The documents without their hit spans; those with more than ``max_coverage`` of their words hit are gone.
    A span leaves a line break."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    clean = find_contamination(own, items, window=window, max_coverage=max_coverage, **kw)
    return clean.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False).withColumn("n_hit", n_hit())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Words of a text, in SQL.
SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, w, least(len(w), {WINDOW}) AS n
           FROM (SELECT item_id, {SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM i, range(1, len(w) - n + 2) t(k)),
d AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS} AS w FROM documents),
found AS (
  SELECT r, k, n, item_id
  FROM (SELECT r, k, x.n AS n, array_to_string(w[k:k + x.n - 1], ' ') AS s
        FROM d, (SELECT DISTINCT n FROM windows) x, range(1, len(w) - x.n + 2) t(k)) JOIN windows USING (n, s)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM found, range(k, k + n) t(j) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
