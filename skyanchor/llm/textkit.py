"""Vectorised text primitives over Arrow columns, shared by the corpus operators.

Everything works on the flat UTF-8 bytes of a column with numpy; no per-word
Python.  A *word* is a maximal run of ASCII letters or digits and of bytes of
non-ASCII characters, in lower case.  Null texts count as having no words.
"""

from __future__ import annotations

import os
import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy import ndarray as Arr

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
SEGMENT = 1 << 19
CHUNK_BYTES = 3 << 20

WORD_BYTE = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD_BYTE[_lo:_hi] = True


def mix(x: Arr) -> Arr:
    """The splitmix64 finaliser; a bijection of 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def flat(column) -> tuple[Arr, Arr]:
    """Bytes and int64 offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column, limit: int = CHUNK_BYTES):
    """Spans (start, stop) of rows, each of about limit bytes, or one longer row."""
    _, off = flat(column)
    start, n = 0, len(off) - 1
    while start < n:
        stop = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def word_spans(raw: Arr, off: Arr) -> tuple[Arr, Arr, Arr]:
    """Starts, ends and row numbers of the words."""
    inside = WORD_BYTE[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0], edge[-1] = True, True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[off] = True
    cut = np.flatnonzero(edge)
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    starts, ends = cut[:-1], cut[1:]
    keep = inside[starts]
    starts, ends = starts[keep], ends[keep]
    rows = np.searchsorted(off, starts, side="right") - 1
    return starts, ends, rows


_tables: dict[int, tuple[Arr, Arr]] = {}


def _powers(n: int) -> tuple[Arr, Arr]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(10, int(n - 1).bit_length())
    if size not in _tables:
        both = []
        for base in (BASE, BASE_INV):
            p = np.full(size, base, U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _tables[size] = tuple(both)
    return _tables[size]


def span_hashes(raw: Arr, starts: Arr, ends: Arr) -> Arr:
    """64-bit hashes of ascending byte spans: polynomials from prefix sums, then mixed."""
    out = np.zeros(len(starts), U)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + SEGMENT, side="right"))
        if j <= i:  # one span longer than a segment: add it up piece by piece
            total, length = 0, int(ends[i]) - lo
            for p in range(0, length, SEGMENT):
                part = raw[lo + p : min(lo + p + SEGMENT, lo + length)].astype(U) + U(1)
                pw, _ = _powers(len(part))
                total += int((part * pw[: len(part)]).sum(dtype=U)) * pow(BASE, p, 1 << 64)
            out[i] = total % (1 << 64)
            i += 1
            continue
        seg = raw[lo : int(ends[i:j].max())].astype(U) + U(1)
        pw, inv = _powers(len(seg) + 1)
        prefix = np.zeros(len(seg) + 1, U)
        np.cumsum(seg * pw[: len(seg)], out=prefix[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (prefix[e] - prefix[s]) * inv[s]
        i = j
    return mix(out + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(column) -> tuple[Arr, Arr, Arr]:
    """Word hashes, their rows, and the number of words of each row."""
    raw, off = flat(pc.utf8_lower(column))
    starts, ends, rows = word_spans(raw, off)
    return span_hashes(raw, starts, ends), rows, np.bincount(rows, minlength=len(off) - 1)


def shingles(column, k: int) -> tuple[Arr, Arr]:
    """Hashes of all runs of k words, in order, and the bounds of each row's run of them.

    A row of fewer words, but at least one, has the single shingle of all its
    words; a row of none has none.  Repeated shingles stay.
    """
    h, rows, count = words(column)
    n = len(count)
    first = np.concatenate([[0], np.cumsum(count)])
    size = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(len(h), U)
    for j in range(k):
        m = len(h) - j
        if m <= 0:
            break
        inside = rows[:m] == rows[j:] if j else slice(None)
        term = mix(h[j:] + U((j + 1) * 0xA0761D6478BD642F % (1 << 64)))
        out[:m][inside] += term[inside]
    # of a row's words the first `size` start a shingle
    start = np.repeat(first[:-1], size) + (np.arange(bounds[-1]) - np.repeat(bounds[:-1], size))
    assert len(first) == n + 1
    return mix(out[start.astype(np.int64)]), bounds


def shared_dir(spark) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; made where it is unset and all workers are threads of this process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="skyanchor-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def local_path(uri: str) -> str:
    """The mounted path of a file: URI; a store that isn't mounted is refused."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri):
        raise ValueError(f"{uri} is not a mounted folder: this operator needs spark.checkpoint.dir on one")
    return uri


def cut(df):
    """The rows of df, with its lineage ended by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def without(df, *names: str):
    """df less the columns that clash, whatever their case, with the names an operator adds."""
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])


def fresh(taken, *names: str) -> list[str]:
    """Names like those asked for, for an operator's own columns, that differ from all of taken whatever their case."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def makedirs(path: str) -> str:
    os.makedirs(path, exist_ok=True)
    return path
