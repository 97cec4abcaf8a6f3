"""Document statistics and bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U, flat, span_hashes, word_spans

SLICE = 1 << 16
#: Labelled documents to a partition of the sample.
SAMPLE_PART = 1250

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "sd_word", "one_byte_words", "upper", "digit", "symbol", "stop", "comma", "exclaim", "bar",
    "blank", "line_end", "non_ascii", "markup", "distinct_words", "same_next", "top_word", "words_per_stop", "long_words", "distinct_lines",
)

_CLASS = np.zeros((11, 256), np.float32)
for _k, _set in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+=@^_~<>{}[]\\|/", b".", b",;:", b"!?", b"|", b" \t", b"\n\r", bytes(range(128, 256)), b"<>{}=")
):
    _CLASS[_k, list(_set)] = 1


def statistics(column) -> np.ndarray:
    """A row of STATISTICS for each text, from all of it; a null or empty text gives zeros."""
    raw, off = flat(column)
    n = len(off) - 1
    size = np.diff(off).astype(float)
    out = np.zeros((n, len(STATISTICS)))
    if not len(raw):
        return out
    some = size > 0
    at = off[:-1][some]
    shares = np.zeros((11, n))
    for k in range(11):
        shares[k, some] = np.add.reduceat(_CLASS[k][raw], at, dtype=np.float64) / size[some]
    starts, ends, rows = word_spans(raw, off)
    length = (ends - starts).astype(float)
    count = np.bincount(rows, minlength=n).astype(float)
    per = np.maximum(count, 1)
    mean = np.bincount(rows, length, n) / per
    var = np.maximum(np.bincount(rows, length * length, n) / per - mean**2, 0)
    h = span_hashes(raw, starts, ends)
    again = np.zeros(n)
    distinct, top = np.zeros(n), np.zeros(n)
    if len(h):
        same = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
        again = np.bincount(rows[1:], same, n) / per
        order = np.argsort((h >> U(24)) | (rows.astype(U) << U(40)), kind="stable") if n < 1 << 23 else np.lexsort((h, rows))
        hs, rs = h[order], rows[order]
        new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])])
        distinct = np.bincount(rs[new], minlength=n) / per
        runs = np.diff(np.concatenate([np.flatnonzero(new), [len(hs)]]))
        np.maximum.at(top, rs[new], runs)
        top /= per
    # lines: hashed as spans between line ends
    edge = np.flatnonzero(raw == 10)
    cut = np.unique(np.concatenate([off, edge, edge + 1]))
    ls, le = cut[:-1], cut[1:]
    keep = raw[np.minimum(ls, len(raw) - 1)] != 10
    ls, le = ls[keep], le[keep]
    lr = np.searchsorted(off, ls, side="right") - 1
    lines = np.bincount(lr, minlength=n).astype(float)
    lh = span_hashes(raw, ls, le)
    order = np.lexsort((lh, lr))
    fresh = np.ones(len(lh), bool)
    fresh[1:] = (lh[order][1:] != lh[order][:-1]) | (lr[order][1:] != lr[order][:-1])
    dl = np.bincount(lr[order][fresh], minlength=n) / np.maximum(lines, 1)
    stops = np.maximum(shares[3] * size, 1)
    upper, digit, symbol, stop, comma, exclaim, bar, blank, line, non, markup = shares
    cols = (
        np.log1p(size), np.log1p(count), mean, np.sqrt(var), np.bincount(rows, length == 1, n) / per, upper, digit, symbol, stop, comma, exclaim, bar,
        blank, line, non, markup, distinct, again, top, np.log1p(count / stops), np.bincount(rows, length > 20, n) / per, dl,
    )
    out[:] = np.stack(cols, axis=1)
    out[~some] = 0
    return out


def _bytes(x: np.ndarray) -> bytes:
    np.save(f := io.BytesIO(), x, allow_pickle=False)
    return f.getvalue()


def _array(x: bytes) -> np.ndarray:
    return np.load(io.BytesIO(x), allow_pickle=False)


def summed(df: DataFrame, f) -> np.ndarray | None:
    """The sum of the arrays that f gives for Arrow batches.

    A partition's sum is cut into slices of its last axis, which are added up in
    a shuffle, so that the driver gets one array however many partitions there are.
    They add up in the order of the partitions, so that equal partitions give equal sums.
    """

    def partial(batches):
        part_id = TaskContext.get().partitionId()
        total = None
        for batch in batches:
            if batch.num_rows:
                part = f(batch)
                total = part if total is None else total + part
        if total is not None:
            for at in range(0, total.shape[-1], SLICE):
                part = np.ascontiguousarray(total[..., at : at + SLICE])
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part_id]), pa.array([zlib.compress(_bytes(part), 1)])], names=["at", "part", "m"])

    def added(table: pa.Table) -> pa.Table:
        total = None
        for x in table.sort_by("part").column("m"):
            part = _array(zlib.decompress(x.as_py()))
            total = part if total is None else total + part
        return pa.table({"at": table.column("at").slice(0, 1), "m": pa.array([zlib.compress(_bytes(total), 1)], pa.binary())})

    summed = df.mapInArrow(partial, "at bigint, part bigint, m binary").groupBy("at").applyInArrow(added, "at bigint, m binary")
    parts = [_array(zlib.decompress(bytes(r.m))) for r in sorted(summed.collect(), key=lambda r: r.at)]
    return np.concatenate(parts, axis=-1) if parts else None


def labelled(docs: DataFrame, labels: DataFrame, name: str, bound: int) -> DataFrame:
    """(doc_id, text, lang, y) of at most bound labelled documents: those of the least hashes of doc_id.

    A doc_id labelled both ways is left out, as are nulls; of several texts of one
    doc_id the least counts, so that bound holds for rows too.  The bound makes the
    labels small enough to broadcast, so that only the sample's texts are shuffled,
    to partitions that depend on doc_id alone, each in the order of doc_id.
    """
    clean = labels.select("doc_id", F.col(name).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    one = clean.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").select("doc_id", "y")
    some = one.orderBy(F.xxhash64(F.lit(name), "doc_id"), "doc_id").limit(bound)
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", "text", lang.alias("lang")).filter("text is not null")
    found = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("least"))
    parts = max(1, -(-bound // SAMPLE_PART))
    return found.select("doc_id", "least.text", "least.lang", "y").repartition(parts, "doc_id").sortWithinPartitions("doc_id")
