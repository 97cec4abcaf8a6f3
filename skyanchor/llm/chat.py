"""Chat formatting by columnar byte assembly.

Turns come sorted by conversation.  Of a batch the lengths of all segments
(opening, role, break, content, closing) are computed in numpy; their running
sums place every segment, and one scatter per kind of segment copies the bytes
of the whole batch into one preallocated buffer, which becomes the Arrow column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import flat

OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
BATCH_BYTES = 64 << 20


def _scatter(out: np.ndarray, where: np.ndarray, source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
    """out[where[i] : where[i] + sizes[i]] = source[starts[i] : ...] for all i at once."""
    total = int(sizes.sum())
    if not total:
        return
    inner = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(where, sizes) + inner] = source[np.repeat(starts, sizes) + inner]


def assemble(role, text, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted conversations (large_string), and where each turn's content starts and ends in bytes.

    first holds the number of the first turn of each conversation.
    """
    (rb, ro), (tb, to) = flat(role), flat(text)
    o, b, c = (np.frombuffer(x.encode(), np.uint8) for x in (OPEN, BREAK, CLOSE))
    rs, ts = np.diff(ro), np.diff(to)
    size = len(o) + rs + len(b) + ts + len(c)
    end = np.cumsum(size)
    start = end - size
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    n = len(size)
    at_text = start + len(o) + rs + len(b)
    for where, part in ((start, o), (start + len(o) + rs, b), (end - len(c), c)):
        out[where[:, None] + np.arange(len(part))] = part
    _scatter(out, start + len(o), rb, ro[:-1], rs)
    _scatter(out, at_text, tb, to[:-1], ts)
    bounds = np.concatenate([start[first], [len(out)]]).astype(np.int64)
    text_col = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(out))
    base = np.repeat(bounds[:-1], np.diff(np.concatenate([first, [n]])))
    return text_col, at_text - base, at_text + ts - base


def _emit(table: pa.Table):
    """Format the conversations of a table that holds each of them whole."""
    n = table.num_rows
    if not n:
        return
    conv = table.column("conv_id").combine_chunks()
    value = np.asarray(pc.fill_null(conv, 0))
    void = np.asarray(pc.is_null(conv))
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (void[1:] != void[:-1])])
    first = np.flatnonzero(new)
    role, text = (table.column(c).combine_chunks() for c in ("role", "text"))
    out, begin, end = assemble(role, text, first)
    off = pa.array(np.concatenate([first, [n]]).astype(np.int32))
    mine = np.asarray(pc.fill_null(pc.equal(role, "assistant"), False))
    kept = np.concatenate([[0], np.cumsum(mine)])[np.concatenate([first, [n]])].astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(begin[mine].astype(np.int64)), pa.array(end[mine].astype(np.int64))], names=["start", "stop"])
    cols = [conv.take(pa.array(first)), pc.list_value_length(pa.ListArray.from_arrays(off, pa.array(np.zeros(n, np.int8)))).cast(pa.int64())]
    sizes = np.diff(np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(out)))])).astype(np.int64)
    whole = pa.RecordBatch.from_arrays([*cols, pa.array(sizes), out, pa.ListArray.from_arrays(pa.array(kept), spans)], names=["conv_id", "n_turns", "n_bytes", "text", "answers"])
    # a string column of Spark's takes less than 2 GB a batch
    at = 0
    while at < whole.num_rows:
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_BYTES, side="right")))
        part = whole.slice(at, to - at)
        if sizes[at] >= 1 << 31:
            raise ValueError(f"conversation {part.column(0)[0].as_py()} has {sizes[at]} bytes: a string column holds less than 2 GB")
        yield part.set_column(3, "text", part.column("text").cast(pa.string()))
        at = to


def _run(batches):
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        conv = table.column("conv_id").combine_chunks()
        last = conv[len(conv) - 1]
        same = pc.is_null(conv) if not last.is_valid else pc.fill_null(pc.equal(conv, last), False)
        n = len(conv) - int(np.argmin(np.concatenate([np.asarray(same)[::-1], [False]])))
        held.append(table.slice(0, n))
        if n:
            yield from _emit(pa.concat_tables(held))
            held = []
        held.append(table.slice(n))
    if held:
        yield from _emit(pa.concat_tables(held))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_bytes, text, answers) for each conversation of (conv_id, turn, role, text).

    Turns follow by turn, nulls first, ties by role, then text (nulls first); repeated
    rows each are a turn.  A null role or text is an empty one; all rows of null
    conv_id are one conversation, and so are held by one task: filter them out where
    they are many.  answers are the byte spans of what role 'assistant' says.  Text
    that looks like a marker is copied as it is; very long texts are copied whole, but
    a conversation of 2 GB or more, which no string column holds, stops the job with a
    message.  Other columns, whatever their names, are left out; an empty table gives one.
    """
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(_run, "conv_id bigint, n_turns bigint, n_bytes bigint, text string, answers array<struct<start:bigint,stop:bigint>>")


SQL = f"""
WITH t AS (SELECT conv_id, turn, role, text, COALESCE(role, '') AS r, COALESCE(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations),
s AS (SELECT conv_id, i, r, '{OPEN}' || r || chr(10) AS head, x, '{OPEN}' || r || chr(10) || x || '{CLOSE.strip()}' || chr(10) AS seg FROM t),
p AS (SELECT *, strlen(head) AS h, strlen(x) AS c, SUM(strlen(seg)) OVER (PARTITION BY conv_id ORDER BY i) - strlen(seg) AS before FROM s)
SELECT conv_id, COUNT(*) AS n_turns, SUM(strlen(seg))::BIGINT AS n_bytes, string_agg(seg, '' ORDER BY i) AS text,
  COALESCE(string_agg((before + h)::BIGINT || '-' || (before + h + c)::BIGINT, ',' ORDER BY i) FILTER (r = 'assistant'), '') AS answers
FROM p GROUP BY conv_id
"""
