r"""Chat formatting by columnar byte assembly.

Each turn becomes ``<|im_start|>role\ntext<|im_end|>\n``. For a block of turns the lengths of all pieces give
their offsets, and headers, roles, texts and ends are scattered into one preallocated buffer with numpy
indices; the buffer becomes the Arrow column as it is. The loss mask holds the code points of every
assistant's text.

Control strings inside texts and roles are escaped by one more backslash after their first character
(``<|im_end|>`` becomes ``<\|im_end|>``, and that becomes ``<\\|im_end|>``), which unescaping takes away, so
every text comes back as it was. In roles, backslashes and line feeds are escaped before that.

Turns are dealt by conversation and sorted, and blocks of them stream through; a conversation longer than a
block comes out in numbered parts, so memory is bounded by a block and the longest turn, whatever a
conversation's length.

Defined results
    * Null texts and roles are empty. Turns are ordered by turn (null last), then role, then text; repeated
      rows stay. A null conversation id is a conversation of its own. Extra columns are not read.
    * A turn of any length is whole; the conversation after one longer than a block begins with part 0.
    * An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_ready, table

HEAD, MIDDLE, TAIL = b"<|im_start|>", b"\n", b"<|im_end|>\n"
LOSS_ROLE = "assistant"
BLOCK_BYTES = 4 << 20
#: Control strings, after their first character ``<`` or ``[``.
CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?<?/?SYS>>|/?INST\]"
ESCAPE, UNESCAPE = rf"([<\[])(\\*)({CONTROL})", rf"([<\[])\\(\\*)({CONTROL})"
_UNESCAPE = re.compile(UNESCAPE)
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, ESCAPE, r"\1\\\2\3")


def _escape_role(column: pa.Array) -> pa.Array:
    return _escape(pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n"))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A large_string column's data and offsets."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and len(data) else np.empty(0, np.uint8), offsets


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy the k-th piece of ``data`` to ``out[at[k]:]``."""
    sizes = np.diff(offsets)
    index = np.arange(offsets[0], offsets[-1])
    out[index + np.repeat(at - offsets[:-1], sizes)] = data[offsets[0] : offsets[-1]]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer; the offsets of turns in it (one more than turns), and where each text starts and ends."""
    text_data, text_at = _bytes(texts)
    role_data, role_at = _bytes(roles)
    role_sizes, text_sizes = np.diff(role_at), np.diff(text_at)
    fixed = len(HEAD) + len(MIDDLE) + len(TAIL)
    offsets = np.concatenate(([0], np.cumsum(fixed + role_sizes + text_sizes)))
    out = np.empty(offsets[-1], np.uint8)
    role_to = offsets[:-1] + len(HEAD)
    text_to = role_to + role_sizes + len(MIDDLE)
    for piece, at in ((HEAD, offsets[:-1]), (MIDDLE, role_to + role_sizes), (TAIL, text_to + text_sizes)):
        out[at[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
    _scatter(out, role_to, role_data, role_at)
    _scatter(out, text_to, text_data, text_at)
    return out, offsets, text_to, text_to + text_sizes


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_NONE = object()


def _block(rows: pa.Table, part: int) -> pa.RecordBatch:
    """The formatted conversations of whole rows; ``part`` numbers the first conversation's part."""
    ids = rows.column("conv_id").combine_chunks()
    large = lambda c: pc.fill_null(rows.column(c).combine_chunks().cast(pa.large_string()), "")
    roles, texts = large("role"), large("text")
    learn = pc.equal(roles, LOSS_ROLE).to_numpy(zero_copy_only=False)
    out, offsets, lo, hi = assemble(_escape_role(roles), _escape(texts))
    n = len(ids)
    key, null = pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.flatnonzero((np.diff(key) != 0) | (np.diff(null.astype(np.int8)) != 0)) + 1, [n]))
    bounds = offsets[first]
    text = pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out))
    # Code points before a byte: bytes that continue a character don't count.
    points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    conv = np.repeat(np.arange(len(first) - 1), np.diff(first))[learn]
    base = points[bounds[conv]]
    spans = pa.StructArray.from_arrays([pa.array(points[lo[learn]] - base), pa.array(points[hi[learn]] - base)], names=["start", "end"])
    per = np.concatenate(([0], np.cumsum(np.bincount(conv, minlength=len(first) - 1)))).astype(np.int32)
    parts = np.zeros(len(first) - 1, np.int32)
    parts[0] = part
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(first[:-1])), pa.array(parts), text.cast(pa.string()), pa.ListArray.from_arrays(pa.array(per), spans)], names=["conv_id", "part", "formatted", "loss_spans"]
    )


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole conversations; a conversation that fills a block by itself comes out in parts, which are
    numbered by comparing its id with the one that came out last."""
    pending, size, last, part = [], 0, _NONE, 0

    def block(rows: pa.Table) -> pa.RecordBatch:
        nonlocal last, part
        first, end = rows.column("conv_id")[0].as_py(), rows.column("conv_id")[-1].as_py()
        number = part + 1 if last is not _NONE and first == last else 0
        out = _block(rows, number)
        last, part = end, number if out.num_rows == 1 else 0
        return out

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            # Rows of about a block at a time, but at least one.
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text").slice(at)), 0).to_numpy(zero_copy_only=False) + 64)
            n = max(1, int(np.searchsorted(sizes, BLOCK_BYTES)))
            pending.append(batch.slice(at, n))
            size += int(sizes[min(n, len(sizes)) - 1])
            at += n
            if size < BLOCK_BYTES:
                continue
            rows = pa.Table.from_batches(pending).combine_chunks()
            ids = rows.column("conv_id").to_pylist()
            open_from = len(ids)
            while open_from > 0 and ids[open_from - 1] == ids[-1]:
                open_from -= 1
            if open_from:  # the last conversation may go on
                yield block(rows.slice(0, open_from))
                pending, size = rows.slice(open_from).to_batches(), rows.slice(open_from).nbytes
            else:
                yield block(rows)
                pending, size = [], 0
    if pending:
        yield block(pa.Table.from_batches(pending).combine_chunks())


def format_chats(turns: DataFrame) -> DataFrame:
    """From (conv_id, turn, role, text): conv_id, part int, formatted string, loss_spans (code points of the part).
    Parts of a conversation are consecutive rows of one partition."""
    python_ready(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "text").drop("turn")
    return rows.mapInArrow(_format, "conv_id long, part int, formatted string, loss_spans array<struct<start:long,end:long>>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []

    def flush():
        batch = pa.RecordBatch.from_pylist(
            [{"conv_id": x[0], "n_turns": x[1], "turns_sha256": x[2].hexdigest(), "loss_chars": x[3], "loss_sha256": x[4].hexdigest(), "formatted_chars": x[5]} for x in done],
            schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]),
        )
        done.clear()
        return batch

    for batch in batches:
        for k in range(batch.num_rows):
            conv, part = batch.column("conv_id")[k].as_py(), batch.column("part")[k].as_py()
            if now is None or part == 0 or conv != now[0]:
                if now is not None:
                    done.append(now)
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = batch.column("formatted")[k].as_py()
            now[5] += len(text)
            for m in TURN.finditer(text):
                now[1] += 1
                now[2].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            for span in batch.column("loss_spans")[k].as_py():
                learned = unescape(text[span["start"] : span["end"]])
                now[3] += len(learned)
                now[4].update(learned.encode("utf-8", "surrogatepass"))
        if done:
            yield flush()
    if now is not None:
        done.append(now)
        yield flush()


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations: one row of digests each."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PLANTED = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return read_back(format_chats(turns.unionByName(own)))


SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, k, r, '{PLANTED}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
e AS (SELECT *, regexp_replace(text, '{ESCAPE}', '\1\\\2\3', 'g') AS inside,
             regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '{ESCAPE}', '\1\\\2\3', 'g') AS who FROM t),
s AS (SELECT *, '<|im_start|>' || who || chr(10) || inside || '<|im_end|>' || chr(10) AS formatted FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       sum(length(formatted))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
