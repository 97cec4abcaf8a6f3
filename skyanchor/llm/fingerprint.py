"""Bottom-k sketches of shingle hashes.

A sketch holds the k least distinct hashes (as signed 64-bit integers in
ascending unsigned order).  The sketch of a union is the k least of the union of
sketches, so parts are merged in any order.  With fewer than k hashes a sketch
is the whole set, and every estimate is exact.
"""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U, chunks, cut, local_path, makedirs, mix, shared_dir, shingles

K = 256
SHINGLE_WORDS = 3
SPACE = 2.0**64
#: The sources' sketches are broadcast up to this size, and joined by a shuffle beyond.
BROADCAST_BYTES = 32 << 20
#: Rows of a segment of the hash index at most, rows compared with it at a time, meetings on a hash counted and pairs given at a time.
SEGMENT_ROWS, SLICE_ROWS, MEETINGS, GIVEN = 1 << 14, 128, 1 << 19, 1 << 17
#: Hashes of a range that is read across the segments; a list is long from HOT_ROWS rows and one in HOT_SHARE of all; bytes of bitmaps, members of short lists and rows united at a time.
RANGE_HASHES, HOT_ROWS, HOT_SHARE, HOT_BYTES, MET_ROWS, UNITED_ROWS = 1 << 21, 64, 512, 48 << 20, 1 << 21, 256
VOID = np.iinfo(np.int64).min


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch (uint64, ascending) of the union of the sets that were sketched."""
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.zeros(0, U)


def distinct(s: np.ndarray, k: int = K) -> float:
    """Estimated size of the set: exact below k hashes, else (k-1) over the k-th least as a share of the space."""
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[k - 1]) + 1) / SPACE)


def compare(a: np.ndarray, b: np.ndarray, k: int = K) -> tuple[float, float | None]:
    """Estimated resemblance of two sets and containment of the first in the second; 0 where a set is empty.

    Both come from the sample below the lesser of the two sketches' last hashes,
    in which both sets are known in full; where that holds nothing of the first
    set its containment is unknown (None).
    """
    if not len(a) or not len(b):
        return 0.0, 0.0
    last = [s[-1] for s in (a, b) if len(s) >= k]
    if last:
        a, b = a[a <= min(last)], b[b <= min(last)]
    same = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - same
    return same / either if either else 0.0, same / len(a) if len(a) else None


def _least(h: np.ndarray, k: int) -> np.ndarray:
    h = np.unique(h)
    return h[:k].copy()


def _sketches(k: int, words: int, merged: bool):
    def run(batches):
        held: dict = {}
        for batch in batches:
            text = batch.column("text")
            for a, z in chunks(text):
                h, b = shingles(text.slice(a, z - a), words)
                parts = [_least(h[b[i] : b[i + 1]], k) for i in range(z - a)]
                part = batch.slice(a, z - a)
                if merged:
                    by: dict = {}
                    for g, s in zip(part.column("source").to_pylist(), parts):
                        by.setdefault(g, []).append(s)
                    for g, more in by.items():
                        held[g] = merge(*more, *([held[g]] if g in held else []), k=k)
                    continue
                off = np.concatenate([[0], np.cumsum([len(s) for s in parts])]).astype(np.int32)
                flat = np.concatenate(parts) if parts else np.zeros(0, U)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("source"), pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))],
                    names=["doc_id", "source", "sketch"],
                )
        if merged and held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([s.view(np.int64) for s in held.values()], pa.list_(pa.int64()))],
                names=["source", "sketch"],
            )

    return run


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")


def document_sketches(docs: DataFrame, k: int = K, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, source, sketch) for each row; a null, empty or wordless text has an empty sketch."""
    return _input(docs).mapInArrow(_sketches(k, shingle_words, False), "doc_id bigint, source string, sketch array<bigint>")


def source_sketches(docs: DataFrame, k: int = K, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(source, union): the sketch of all texts of each source, merged from one partial sketch per partition.

    Null is a source of its own.  Partials merge as distinct hashes ranked within
    the source, which Spark limits to k before the shuffle.
    """
    partial = _input(docs).mapInArrow(_sketches(k, shingle_words, True), "source string, sketch array<bigint>")
    hashes = partial.select("source", F.explode_outer("sketch").alias("h")).distinct()
    # flipping the sign bit makes signed order that of unsigned hashes
    ranked = hashes.withColumn("o", F.col("h").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))).selectExpr(
        "source", "h", "o", "row_number() over (partition by source order by o nulls last) rank"
    )
    kept = ranked.filter(F.col("rank") <= k)
    sketch = F.transform(F.array_sort(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("o", "h")))), lambda x: x["h"])
    return kept.groupBy("source").agg(sketch.alias("union"))


def _against(k: int):
    def run(batches):
        for batch in batches:
            mine = batch.column("sketch").to_numpy(zero_copy_only=False)
            union = batch.column("union").to_numpy(zero_copy_only=False)
            none = np.zeros(0, np.int64)
            out = []
            for s, u in zip(mine, union):
                s, u = (x if x is not None else none for x in (s, u))
                s, u = np.ascontiguousarray(s).view(U), np.ascontiguousarray(u).view(U)
                out.append((distinct(s, k), distinct(u, k), *compare(s, u, k)))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), batch.column("sketch"), *(pa.array(c, pa.float64()) for c in cols)],
                names=["doc_id", "source", "sketch", "n_distinct", "source_distinct", "resemblance", "containment"],
            )

    return run


def _index(base: DataFrame) -> list[tuple[int, int, int, str]]:
    """Write base with its hashes in ascending order; (least doc_id, greatest, rows, path stem) of the segments, null as VOID."""
    folder = f"{local_path(shared_dir(base.sparkSession))}/sketches-{uuid.uuid4().hex}"

    def write(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SEGMENT_ROWS):
                part = batch.slice(at, SEGMENT_ROWS)
                part = part.take(pa.array(np.argsort(_ids(part), kind="stable")))
                ids, (flat, off) = _ids(part), _flat(part)
                order = np.argsort(flat, kind="stable")
                stem = f"{makedirs(folder)}/{uuid.uuid4().hex}"
                with pa.OSFile(f"{stem}.rows", "wb") as f, pa.ipc.new_file(f, part.schema) as w:
                    w.write_batch(part)
                flat[order].tofile(f"{stem}.hashes")
                np.repeat(np.arange(len(ids), dtype=np.uint16), np.diff(off))[order].tofile(f"{stem}.owners")
                yield pa.RecordBatch.from_pydict({"lo": [int(ids[0])], "hi": [int(ids[-1])], "n": [len(ids)], "stem": [stem]})

    made = base.mapInArrow(write, "lo bigint, hi bigint, n bigint, stem string").collect()
    return sorted((r.lo, r.hi, r.n, r.stem) for r in made)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("doc_id").fill_null(VOID))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The rows' sketches end to end, and their bounds."""
    sketch = batch.column("sketch")
    return np.asarray(sketch.flatten()).view(U), np.concatenate([[0], np.cumsum(np.asarray(sketch.value_lengths()), dtype=np.int64)])


@lru_cache(maxsize=64)
def _segment(stem: str):
    batch = pa.ipc.open_file(pa.memory_map(f"{stem}.rows")).get_batch(0)
    flat, off = _flat(batch)
    some = os.path.getsize(f"{stem}.hashes") > 0
    hashes, owners = (np.memmap(f"{stem}.{n}", t, "r") if some else np.zeros(0, t) for n, t in (("hashes", U), ("owners", np.uint16)))
    return batch, _ids(batch), flat, off, hashes, owners


def _below(flat: np.ndarray, start: np.ndarray, stop: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many of each ascending run flat[start:stop] are no greater than most."""
    lo, hi = start.copy(), stop.copy()
    while (live := lo < hi).any():
        mid = (lo + hi) >> 1
        up = flat[np.minimum(mid, len(flat) - 1)] <= most
        lo, hi = np.where(live & up, mid + 1, lo), np.where(live & ~up, mid, hi)
    return lo - start


def _slice(mine, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of rows a to z in ascending order, and their rows from a."""
    _, _, flat, off, _, _ = mine
    h, row = flat[off[a] : off[z]], np.repeat(np.arange(z - a), np.diff(off[a : z + 1]))
    order = np.argsort(h, kind="stable")
    return h[order], row[order]


def _meet(mine, a: int, z: int, sliced, theirs, k: int):
    """Rows (from a, of theirs) of the pairs that share a hash, with the hashes shared and held by each in their common sample."""
    _, _, flat, off, _, _ = mine
    _, ids, flat_b, off_b, hashes, owners = theirs
    h, row = sliced
    lo = np.searchsorted(hashes, h)
    hit = lo < len(hashes)
    hit[hit] = hashes[lo[hit]] == h[hit]
    h, row, lo = h[hit], row[hit], lo[hit]
    n = np.searchsorted(hashes, h, side="right") - lo
    ends = np.cumsum(n)

    def met(i: int, j: int) -> np.ndarray:
        """The numbers of the pairs that meet on the hashes i to j."""
        m = n[i:j]
        at = np.arange(m.sum()) + np.repeat(lo[i:j] - (np.cumsum(m) - m), m)
        return np.repeat(row[i:j] * len(ids), m) + owners[at]

    cells = (z - a) * len(ids)
    if len(n) and 4 * ends[-1] < min(cells, MEETINGS):  # few meetings: sort them instead of counting in all cells
        pairs = np.sort(met(0, len(n)))
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else pairs
        pair, same = pairs[first], np.diff(np.append(first, len(pairs)))
    else:
        count, i = np.zeros(cells, np.int64), 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + MEETINGS, side="right")))
            count += np.bincount(met(i, j), minlength=cells)
            i = j
        pair = np.flatnonzero(count)
        same = count[pair]
    x, y = np.divmod(pair, len(ids) or 1)
    held = []
    full = np.iinfo(U).max
    ends = [(f, o[r], o[r + 1]) for f, o, r in ((flat, off, x + a), (flat_b, off_b, y))]
    last = [np.where(e - s >= k, f[e - 1], full) if len(e) else np.zeros(0, U) for f, s, e in ends]
    for (f, s, e), own, other in ((ends[0], *last), (ends[1], *last[::-1])):
        held.append(e - s)
        short = np.flatnonzero(own > other)
        held[-1][short] = _below(f, s[short], e[short], other[short])
    return x, y, same, *held


def _with_pairs(segments: list[tuple[int, int, int, str]], starts: np.ndarray, k: int):
    """For slice numbers, the rows of each slice with what they share with later documents."""

    def run(batches):
        for batch in batches:
            for number in batch.column("id").to_pylist():
                at = int(np.searchsorted(starts, number, side="right")) - 1
                mine = _segment(segments[at][3])
                a = (number - int(starts[at])) * SLICE_ROWS
                z = min(a + SLICE_ROWS, segments[at][2])
                found, sliced = [], _slice(mine, a, z)
                for other, (_, hi, _, stem) in enumerate(segments):
                    if hi < mine[1][a] or (hi == mine[1][a] and other < at):
                        continue
                    theirs = _segment(stem)
                    x, y, same, na, nb = _meet(mine, a, z, sliced, theirs, k)
                    own, its = mine[1][x + a], theirs[1][y]
                    later = (its > own) | ((its == own) & ((other > at) | ((other == at) & (y > x + a))))
                    found.append([v[later].astype(t) for v, t in ((x, np.uint16), (its, np.int64), (same, np.int32), (na, np.int32), (nb, np.int32))])
                x, its, same, na, nb = (np.concatenate(v) for v in zip(*found))
                del found
                order = np.argsort(x, kind="stable")
                if ((x[order][1:] == x[order][:-1]) & (its[order][1:] < its[order][:-1])).any():
                    order = np.lexsort((its, x))
                x, its, same, na, nb = (v[order] for v in (x, its, same, na, nb))
                ends = np.cumsum(np.bincount(x, minlength=z - a))
                i = 0
                while i < z - a:
                    began = int(ends[i - 1]) if i else 0
                    j = max(i + 1, int(np.searchsorted(ends, began + GIVEN, side="right")))
                    some = slice(began, int(ends[j - 1]))
                    off = pa.array(np.concatenate([[0], ends[i:j] - began]).astype(np.int32))
                    who, n, p, q = its[some], same[some], na[some], nb[some]
                    values = (pa.array(who, mask=who == VOID), *(pa.array(v) for v in (n / (p + q - n), n / p, n / q)))
                    part = mine[0].slice(a + i, j - i)
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.ListArray.from_arrays(off, v) for v in values)], names=[*part.schema.names, *NEAR])
                    i = j

    return run


NEAR = ("near", "near_resemblance", "near_containment", "near_contained")


def near_pairs(base: DataFrame, k: int = K) -> DataFrame:
    """base (doc_id, sketch, ...) with near, near_resemblance, near_containment and near_contained.

    They list the later documents, in order of doc_id, that share a hash of the
    sketch, so that each pair stands once, with the lesser doc_id; null comes first,
    and equal doc_ids in any order.  Containment is of this document in the other,
    contained of the other in this one.  The join is on equal hashes, without a cap:
    slices of rows look theirs up in segments of an index in the shared folder and
    count by pair of rows, so a hash held by all costs and gives all pairs, but no
    pair is shuffled.
    """
    spark = base.sparkSession
    segments = _index(base)
    slices = [-(-n // SLICE_ROWS) for _, _, n, _ in segments]
    starts = np.concatenate([[0], np.cumsum(slices)]).astype(np.int64)[: len(slices)]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    total = sum(slices)
    tasks = spark.range(0, total, 1, max(1, total // 8, min(total, spark.sparkContext.defaultParallelism)))
    return tasks.mapInArrow(_with_pairs(segments, starts, k), f"{ddl}, near array<bigint>, near_resemblance array<double>, near_containment array<double>, near_contained array<double>")


@lru_cache(maxsize=8192)
def _mapped(path: str, kind) -> np.ndarray:
    return np.memmap(path, kind, "r").view(np.ndarray) if os.path.getsize(path) else np.zeros(0, kind)


def _segments(base: DataFrame, folder: str) -> tuple[list[tuple[int, str]], np.ndarray]:
    """Write base in segments: rows without sketches, and hashes in ascending order with their rows; (rows, path stem) of each, and from where ranges of about RANGE_HASHES begin."""

    def write(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SEGMENT_ROWS):
                part = batch.slice(at, SEGMENT_ROWS)
                flat, off = _flat(part)
                order = np.argsort(flat, kind="stable")
                flat, rest = flat[order], part.drop_columns(["sketch"])
                stem = f"{makedirs(folder)}/{uuid.uuid4().hex}"
                with pa.OSFile(f"{stem}.rows", "wb") as f, pa.ipc.new_file(f, rest.schema) as w:
                    w.write_batch(rest)
                flat.tofile(f"{stem}.hashes")
                np.repeat(np.arange(part.num_rows, dtype=np.uint16), np.diff(off))[order].tofile(f"{stem}.owners")
                some = flat[len(flat) // 512 :: max(1, len(flat) // 256)].view(np.int64)
                yield pa.RecordBatch.from_pydict({"n": [part.num_rows], "hashes": [len(flat)], "some": pa.array([some], pa.list_(pa.int64())), "stem": [stem]})

    made = base.mapInArrow(write, "n bigint, hashes bigint, some array<bigint>, stem string").collect()
    sample = np.concatenate([np.array(r.some, np.int64).view(U) for r in made]) if made else np.zeros(0, U)
    stands_for = np.repeat([r.hashes / max(1, len(r.some)) for r in made], [len(r.some) for r in made])
    order = np.argsort(sample)
    ranges = -(-sum(r.hashes for r in made) // RANGE_HASHES)
    at = np.searchsorted(np.cumsum(stands_for[order]), np.arange(ranges) * RANGE_HASHES)
    return sorted((r.n, r.stem) for r in made), np.unique(sample[order][np.minimum(at, len(sample) - 1)])


def _lists(segments: list[tuple[int, str]], first: np.ndarray, bounds: np.ndarray, folder: str):
    """For numbers of ranges of hashes: write the hashes that several rows hold, and the numbers of these rows."""

    def run(batches):
        for batch in batches:
            for p in batch.column("id").to_pylist():
                h, rows = [], []
                for at, (_, stem) in enumerate(segments):
                    hashes, owners = _mapped(f"{stem}.hashes", U), _mapped(f"{stem}.owners", np.uint16)
                    a, z = _range(hashes, bounds, p)
                    h.append(hashes[a:z])
                    rows.append(owners[a:z].astype(_row_type(first)) + first[at])
                h, rows = np.concatenate(h), np.concatenate(rows).astype(_row_type(first))
                order = np.argsort(h, kind="stable")
                h = h[order]
                begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.append(begin, len(h)))
                several = n > 1
                stem = f"{makedirs(folder)}/{uuid.uuid4().hex}"
                h[begin[several]].tofile(f"{stem}.shared")
                np.concatenate([[0], np.cumsum(n[several])]).astype(np.int64).tofile(f"{stem}.starts")
                rows[order[np.repeat(several, n)]].tofile(f"{stem}.lists")
                yield pa.RecordBatch.from_pydict({"p": [p], "stem": [stem]})

    return run


def _row_type(first: np.ndarray):
    return np.int32 if first[-1] < 1 << 31 else np.int64


def _range(hashes: np.ndarray, bounds: np.ndarray, p: int) -> tuple[int, int]:
    a = int(np.searchsorted(hashes, bounds[p])) if p else 0
    return a, int(np.searchsorted(hashes, bounds[p + 1])) if p + 1 < len(bounds) else len(hashes)


def _digests(segments: list[tuple[int, str]]):
    """For numbers of segments: 128 bits of each row's sketch (a row without hashes has its own), and its doc_id."""

    def run(batches):
        for batch in batches:
            for at in batch.column("id").to_pylist():
                n, stem = segments[at]
                h, owners = _mapped(f"{stem}.hashes", U), _mapped(f"{stem}.owners", np.uint16)
                own = mix(np.arange(n, dtype=U) + U(at << 16))
                held = np.bincount(owners, minlength=n)
                by = np.argsort(owners, kind="stable")
                begin = (np.cumsum(held) - held)[held > 0]
                sums = []
                for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    d = own ^ U(salt)
                    d[held > 0] = np.add.reduceat(mix(h[by] + U(salt)), begin) if len(begin) else d[:0]
                    sums.append(pa.array(d.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, at, np.int64)), pa.array(np.arange(n)), *sums, pa.ipc.open_file(f"{stem}.rows").get_batch(0).column("doc_id")],
                    names=["segment", "place", "d", "e", "doc_id"],
                )

    return run


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start, n of each, end to end."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def count_links(stem: str, asked: np.ndarray, lists: list[str], bounds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many rows of the whole table hold a hash of each of the asked rows of a segment, itself included if any other does.

    A row's links are the union of its hashes' lists.  Long lists are bitmaps, which
    are united word by word, once for rows of the same long lists; the members of
    short lists that the bitmaps lack are counted besides.
    """
    total, hot_at = int(first[-1]), max(HOT_ROWS, int(first[-1]) // HOT_SHARE)
    hashes, owners = _mapped(f"{stem}.hashes", U), _mapped(f"{stem}.owners", np.uint16)
    rank = np.full(1 << 16, -1, np.int64)
    rank[asked] = np.arange(len(asked))
    cold, hot, hot_rows, hot_ids, n_hot = [], [], [], [], 0
    for p, where in enumerate(lists):
        a, z = _range(hashes, bounds, p)
        shared, starts = _mapped(f"{where}.shared", U), _mapped(f"{where}.starts", np.int64)
        who = rank[owners[a:z]]
        h, who = hashes[a:z][who >= 0], who[who >= 0]
        k = np.searchsorted(shared, h)
        hit = k < len(shared)
        hit[hit] = shared[k[hit]] == h[hit]
        k, who = k[hit], who[hit]
        long = starts[k + 1] - starts[k] >= hot_at
        which, ids = np.unique(k[long], return_inverse=True)
        hot.append((f"{where}.lists", starts[which], starts[which + 1]))
        hot_rows.append(who[long])
        hot_ids.append(ids + n_hot)
        n_hot += len(which)
        cold.append((f"{where}.lists", who[~long], starts[k[~long]], starts[k[~long] + 1]))
    out = np.zeros(len(asked), np.int64)
    if not len(asked) or not lists:
        return out
    # rows in order of their long lists, so that rows of the same ones are neighbours
    who, ids = np.concatenate(hot_rows), np.concatenate(hot_ids)
    order = np.lexsort((ids, who))
    ids, off = ids[order], np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(asked)))])
    mine = [ids[off[i] : off[i + 1]] for i in range(len(asked))]
    keys = [x.tobytes() for x in mine]
    by = np.array(sorted(range(len(asked)), key=keys.__getitem__), np.int64)
    place = np.empty_like(by)
    place[by] = np.arange(len(by))
    sorted_cold = []
    size = np.zeros(len(asked), np.int64)
    for path, who, a, z in cold:
        who = place[who]
        o = np.argsort(who, kind="stable")
        sorted_cold.append((path, who[o], a[o], z[o]))
        size += np.bincount(who, weights=z - a, minlength=len(asked)).astype(np.int64)
    ends = np.cumsum(size)
    width = max(64, min(-(-total // 64) * 64, HOT_BYTES * 8 // max(1, n_hot) // 64 * 64))
    blocks = -(-total // width)
    for w in range(0, total, width):
        bitmaps, last, kept = _bitmaps(hot, n_hot, w, width, _row_type(first)), None, None
        i = 0
        while i < len(by):
            began = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, began + MET_ROWS * blocks, side="right")))
            met = []
            for path, who, a, z in sorted_cold:
                x, y = np.searchsorted(who, [i, j])
                if x == y:
                    continue
                rows, a, z, who = _mapped(path, _row_type(first)), a[x:y], z[x:y], who[x:y]
                if blocks > 1:
                    a, z = a + _below(rows, a, z, np.full(len(a), w - 1)), a + _below(rows, a, z, np.full(len(a), w + width - 1))
                met.append(np.repeat((who - i) * width - w, z - a) + rows[_runs(a, z - a)])
            met = np.sort(np.concatenate(met)) if met else np.zeros(0, np.int64)
            if len(met):
                met = met[np.concatenate([[True], met[1:] != met[:-1]])]
            for u in range(i, j, UNITED_ROWS):
                v = min(j, u + UNITED_ROWS)
                bits = np.zeros((v - u, width // 64), U)
                for q in range(u, v):
                    if (key := keys[by[q]]) != last:
                        kept = np.bitwise_or.reduce(bitmaps[mine[by[q]]], axis=0) if key else None
                        last = key
                    if key:
                        bits[q - u] = kept
                own = met[slice(*np.searchsorted(met, [(u - i) * width, (v - i) * width]))] - (u - i) * width
                lacks = (bits.view(np.uint8).reshape(-1)[own >> 3] >> (own & 7).astype(np.uint8)) & 1 == 0
                out[by[u:v]] += np.bitwise_count(bits).sum(axis=1, dtype=np.int64) + np.bincount(own[lacks] // width, minlength=v - u)
            i = j
    return out


def _bitmaps(hot, n_hot: int, w: int, width: int, kind) -> np.ndarray:
    """The members from w, width of them, of the long lists: a bit each."""
    out, at = np.zeros((n_hot, width // 64), U), 0
    for path, a, z in hot:
        rows = _mapped(path, kind)
        a, z = a + _below(rows, a, z, np.full(len(a), w - 1)), a + _below(rows, a, z, np.full(len(a), w + width - 1))
        for i in range(len(a)):
            cells = np.zeros(width, np.uint8)
            cells[rows[a[i] : z[i]] - w] = 1
            out[at + i] = np.packbits(cells, bitorder="little").view(U)
        at += len(a)
    return out


def _with_links(segments: list[tuple[int, str]], lists: list[str], bounds: np.ndarray, first: np.ndarray, names: list[str]):
    """The rows of each segment, with their sketches, from (segment, place, d, e, class_id, n_copies) of them all."""

    def run(batches):
        table = pa.Table.from_batches(found) if (found := list(batches)) else None
        for at in table.column("segment").unique().to_pylist() if table else ():  # one a partition
            n, stem = segments[at]
            own = table.filter(pc.equal(table.column("segment"), at)).sort_by("place").combine_chunks()
            digests = np.stack([np.asarray(own.column(c)) for c in ("d", "e")], 1)
            _, asked, of = np.unique(digests, axis=0, return_index=True, return_inverse=True)
            links = np.maximum(count_links(stem, asked, lists, bounds, first) - 1, 0)[of.reshape(-1)]
            h, owners = _mapped(f"{stem}.hashes", U), _mapped(f"{stem}.owners", np.uint16)
            off = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=n))]).astype(np.int32)
            flat = h[np.argsort(owners, kind="stable")].view(np.int64)
            rest = pa.ipc.open_file(f"{stem}.rows").get_batch(0)
            columns = {c: rest.column(c) for c in rest.schema.names} | {
                "sketch": pa.ListArray.from_arrays(pa.array(off), pa.array(flat)),
                "class_id": own.column("class_id").chunk(0),
                "n_copies": own.column("n_copies").chunk(0),
                "n_links": pa.array(links),
            }
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return run


def with_links(base: DataFrame) -> DataFrame:
    """base (doc_id, sketch, ...) with class_id, n_copies and n_links.

    Rows of the same sketch are a class: class_id is its least doc_id that isn't null,
    n_copies the number of its rows.  n_links is the number of other rows, copies
    included, that share a hash of the sketch; no hash is capped.  A row without hashes
    is a class of its own and has no links.

    The sketches are written once to the shared folder, in segments ordered by hash.
    Ranges of hashes are read across the segments for the list of rows of each hash that
    several rows hold; then each segment unites the lists of its classes' hashes.
    """
    spark = base.sparkSession
    folder = f"{local_path(shared_dir(spark))}/sketches-{uuid.uuid4().hex}"
    segments, bounds = _segments(base, folder)
    first = np.concatenate([[0], np.cumsum([n for n, _ in segments])]).astype(np.int64)

    def each(n: int) -> DataFrame:
        return spark.range(0, n, 1, max(1, n))

    made = each(len(bounds)).mapInArrow(_lists(segments, first, bounds, folder), "p bigint, stem string").collect()
    lists = [stem for _, stem in sorted((r.p, r.stem) for r in made)]
    rows = each(len(segments)).mapInArrow(_digests(segments), "segment bigint, place bigint, d bigint, e bigint, doc_id bigint")
    same = "over (partition by d, e)"
    classed = rows.selectExpr("segment", "place", "d", "e", f"min(doc_id) {same} class_id", f"count(*) {same} n_copies")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    by = classed.repartitionById(max(1, len(segments)), F.col("segment").cast("int"))
    return by.mapInArrow(_with_links(segments, lists, bounds, first, [*base.columns, *LINKS]), f"{ddl}, class_id bigint, n_copies bigint, n_links bigint")


LINKS = ("class_id", "n_copies", "n_links")


def fingerprints(docs: DataFrame, k: int = K, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, source, sketch, n_distinct, source_distinct, resemblance, containment) and with_links' columns for each row.

    resemblance and containment compare the document's shingle set with that of its
    source; n_links counts the documents that share a hash of its sketch, and
    near_pairs of the result lists them with their resemblance and containment.
    Repeated rows each have their row; columns other than doc_id, text and source,
    whatever their names, are left out; an empty table gives one.  Very long texts are
    sketched whole; a doc_id that isn't an integer, nor the text of one, is null; equal
    hashes count once.  A null, empty or wordless text has 0.0 for its
    n_distinct, resemblance and containment; containment is null where none of the
    document's hashes is as low as its source's sketch reaches.
    """
    mine = document_sketches(docs, k, shingle_words)
    unions = cut(source_sketches(docs, k, shingle_words).withColumnRenamed("source", "of"))
    if unions.count() * k * 8 <= BROADCAST_BYTES:
        unions = F.broadcast(unions)
    joined = mine.join(unions, mine["source"].eqNullSafe(unions["of"]), "left").select("doc_id", "source", "sketch", "union")
    base = joined.mapInArrow(
        _against(k),
        "doc_id bigint, source string, sketch array<bigint>, n_distinct double, source_distinct double, resemblance double, containment double",
    )
    return with_links(base)
