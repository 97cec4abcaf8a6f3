"""Near-duplicate removal: fast similarity sketches, banding, exact verification.

Sketch: rounds of hashed bin placement (Dahlgaard, Knudsen and Thorup, 2017).
In round i < t every shingle is thrown into a hashed bin with a value in
[i, i+1); in round t+i all shingles go to bin i.  Each bin keeps its least
value, so that after at most 2t rounds, and mostly after one or two, every
coordinate is filled, and the share of equal coordinates of two sketches is
concentrated about their Jaccard similarity.

Banding: a bucket is the set of documents that agree on all rows of one band.
Groups are the connected components of the verified pairs of bucket mates.
Phase 1 verifies each document against the least hub among its buckets, whose
links form a forest, so that pointer doubling finds its trees; phase 2 takes
every pair of bucket mates that are still in different trees, block by block of a
bucket, compares their sketches and verifies those whose sketches agree as pairs at
the threshold do (but for one in a thousand).  Only these pairs are ever shuffled,
so that a passage shared by many documents costs comparisons of bytes and no texts.
A pair in one tree needs no verification: the groups are those that verifying all
pairs of bucket mates would give, without n^2 work for a group of thousands of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U, chunks, cut, fresh, mix, shingles, without

SHINGLE_WORDS = 3
THRESHOLD = 0.5
BANDS = 36
ROWS = 4
FULL = np.iinfo(np.uint64).max
#: Standard deviations below its expectation at the threshold that a pair's agreement of sketches may lie.
SLACK = 3.0
#: Documents of a bucket to a block, and pairs compared at a time.
BLOCK, PAIRS = 2048, 1 << 18


def _salt(i: int) -> np.uint64:
    return U((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))


def sketch(hashes: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """t coordinates (uint64) for each row of shingles; FULL throughout for a row of none."""
    n = len(bounds) - 1
    out = np.full((n, t), FULL, U)
    size = np.diff(bounds)
    row = np.repeat(np.arange(n), size)
    low = U((1 << 54) - 1)
    live = size > 0
    for i in range(2 * t):
        if i:
            now = live & (out == FULL).any(axis=1)
            if not now.any():
                break
            if now.sum() < live.sum():
                live, keep = now, now[row]
                row, hashes = row[keep], hashes[keep]
        h = mix(hashes ^ _salt(i))
        value = (U(i) << U(54)) | (h & low)
        where = (mix(h) >> U(32)) * U(t) >> U(32) if i < t else np.full(len(h), i - t, U)
        np.minimum.at(out.reshape(-1), row * t + where.astype(np.int64), value)
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key (int64) for each band of each sketch; different bands' keys don't meet but by chance."""
    parts = sketches[:, : bands * rows].reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0xA24BAED4963EE407), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key ^ parts[:, :, r])
    return key.view(np.int64)


def jaccard(a: pa.Array, b: pa.Array, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of each pair of texts; 0 if either has none."""
    (sa, ba), (sb, bb) = shingles(a, k), shingles(b, k)
    out = np.zeros(len(a))
    for i in range(len(a)):
        x, y = np.unique(sa[ba[i] : ba[i + 1]]), np.unique(sb[bb[i] : bb[i + 1]])
        if len(x) and len(y):
            both = np.sort(np.concatenate([x, y]), kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            out[i] = same / (len(x) + len(y) - same)
    return out


def _sketches(bands: int, rows: int, k: int):
    def run(batches):
        for batch in batches:
            text, key = batch.column("text"), batch.column("key")
            for a, z in chunks(text):
                h, bounds = shingles(text.slice(a, z - a), k)
                drawn = sketch(h, bounds, bands * rows)
                keys = band_keys(drawn, bands, rows)
                some = np.diff(bounds) > 0
                flat = pa.array(keys[some].reshape(-1))
                off = pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32))
                # a byte of each coordinate tells all but one in 256 of different ones apart
                bytes_ = np.ascontiguousarray((mix(drawn[some]) & U(255)).astype(np.uint8))
                at = np.arange(0, bytes_.size + 1, bands * rows, dtype=np.int32)
                marks = pa.BinaryArray.from_buffers(pa.binary(), len(bytes_), [None, pa.py_buffer(at), pa.py_buffer(bytes_)])
                yield pa.RecordBatch.from_arrays(
                    [key.slice(a, z - a).filter(pa.array(some)), pa.ListArray.from_arrays(off, flat), marks], names=["key", "bands", "marks"]
                )

    return run


def _verify(k: int, threshold: float):
    def run(batches):
        for batch in batches:
            for a, z in chunks(batch.column("ta")):
                part = batch.slice(a, z - a)
                ok = pa.array(jaccard(part.column("ta"), part.column("tb"), k) >= threshold)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), ok], names=["a", "b", "ok"])

    return run


def least_agreement(t: int, threshold: float) -> int:
    """Equal coordinates of t that a pair at the threshold has, less SLACK standard deviations."""
    return max(0, int(np.floor(t * threshold - SLACK * np.sqrt(t * threshold * (1 - threshold)))))


def agreeing(group: np.ndarray, side: np.ndarray, cross: np.ndarray, root: np.ndarray, marks: np.ndarray, least: int):
    """Row numbers (i, j), i < j, of the pairs of one group that differ in root (and in side, where cross) and agree in least marks.

    Rows come group by group.
    """
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([start, [len(group)]]))
    first = np.repeat(start, size)
    before = np.arange(len(group)) - first
    ends = np.cumsum(before)
    i = 0
    while i < len(before):
        done = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        n = before[i:j]
        b = np.repeat(np.arange(i, j), n)
        a = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[i:j], n)
        open_ = (root[a] != root[b]) & (~cross[b] | (side[a] != side[b]))
        a, b = a[open_], b[open_]
        for at in range(0, len(a), PAIRS):
            x, y = a[at : at + PAIRS], b[at : at + PAIRS]
            ok = (marks[x] == marks[y]).sum(axis=1) >= least
            yield x[ok], y[ok]
        i = j


def _candidates(least: int):
    """Pairs of rows (band, p, q, side, key, root, marks), which come sorted by (band, p, q)."""

    def emit(table: pa.Table):
        table = table.combine_chunks()
        cols = [np.asarray(table.column(c)) for c in ("band", "p", "q", "side")]
        new = np.zeros(table.num_rows, bool)
        for c in cols[:3]:
            new[1:] |= c[1:] != c[:-1]
        keys, roots = table.column("key").combine_chunks(), table.column("root").combine_chunks()
        number = np.asarray(roots.dictionary_encode().indices)
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        for x, y in agreeing(np.cumsum(new), cols[3], cols[1] != cols[2], number, marks, least):
            if len(x):
                x, y = pa.array(x), pa.array(y)
                yield pa.RecordBatch.from_arrays([keys.take(x), keys.take(y), roots.take(x), roots.take(y)], names=["a", "b", "root_a", "root_b"])

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            same = np.ones(table.num_rows, bool)
            for c in ("band", "p", "q"):
                v = np.asarray(table.column(c))
                same &= v == v[-1]
            n = int(np.argmax(same))  # the last group may go on in the next batch
            if n or held:
                head = [*held, table.slice(0, n)]
                if n:
                    yield from emit(pa.concat_tables(head))
                    held = []
                elif tuple(held[-1].column(c)[-1].as_py() for c in ("band", "p", "q")) != tuple(table.column(c)[0].as_py() for c in ("band", "p", "q")):
                    yield from emit(pa.concat_tables(held))
                    held = []
            held.append(table.slice(n))
        if held:
            yield from emit(pa.concat_tables(held))

    return run


def _links(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """pairs (a, b) of keys of texts (key, text), with ok: whether their exact similarity reaches the threshold."""
    both = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").join(
        texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a"
    )
    return both.select("a", "b", "ta", "tb").mapInArrow(_verify(k, threshold), "a binary, b binary, ok boolean").distinct()


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) for the trees of (node, up), up < node, by pointer doubling."""
    now = cut(parents.select("node", F.col("up").alias("root")))
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        new = cut(now.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        now = new.select("node", "root")
        if new.filter("moved").isEmpty():
            return now


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of the undirected edges (a, b)."""
    now = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = cut(now.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    both = cut(now)
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        hop = label.join(near, "node").select("node", "root", F.least("root", "r").alias("to"))
        jump = label.select(F.col("node").alias("to"), F.col("root").alias("past"))
        new = cut(hop.join(jump, "to", "left").select("node", F.least("to", "past").alias("next"), "root"))
        label = new.select("node", F.col("next").alias("root"))
        if new.filter("next <> root").isEmpty():
            return label


def copy_groups(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """(doc_id, key, n, grp, keep): each distinct (doc_id, text) with its group, for docs (doc_id, text).

    key is the MD5 of the text as binary, n the number of its equal rows, keep
    true for one (doc_id, key) of each group: the least doc_id, nulls last, then
    the least key.  Equal texts, empty ones too, are copies; a text without any
    word has no near copies but its equals; null texts are left out; very long ones
    are compared whole.  A pair exactly at the threshold is one of copies.
    """
    keyed = docs.select("doc_id", "text").filter("text is not null").withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    ids = keyed.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    sketched = cut(keyed.select("key", "text").mapInArrow(_sketches(bands, rows, shingle_words), "key binary, bands array<bigint>, marks binary").dropDuplicates(["key"]))
    hashed = sketched.select("key", F.explode("bands").alias("band"))
    hubs = hashed.groupBy("band").agg(F.min("key").alias("hub"), F.max("key").alias("last")).filter("hub <> last").select("band", "hub")
    mates = cut(hashed.join(hubs, "band").select("band", "hub", "key"))

    # the whole table's texts are shuffled this once; both phases read what is left of them
    texts = cut(keyed.select("key", "text").join(mates.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]))
    first = cut(mates.filter("hub <> key").groupBy(F.col("key").alias("b")).agg(F.min("hub").alias("a")).select("a", "b"))
    tried = cut(_links(first, texts, shingle_words, threshold))
    trees = _roots(tried.filter("ok").select(F.col("b").alias("node"), F.col("a").alias("up")))
    labelled = mates.join(trees, F.expr("key = node"), "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    blocks = F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)")
    mixed = labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), blocks.alias("blocks")).filter("lo <> hi").select("band", "blocks")
    open_ = labelled.join(mixed, "band").join(sketched.select("key", "marks"), "key").withColumn("side", F.expr("cast(pmod(xxhash64(key), blocks) as int)"))
    met = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "key", "root", "marks")
    met = met.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")
    agree = met.mapInArrow(_candidates(least_agreement(bands * rows, threshold)), "a binary, b binary, root_a binary, root_b binary")
    swap = F.col("a") > F.col("b")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    rest = agree.select(either("a", "b").alias("a"), either("b", "a").alias("b"), either("root_a", "root_b").alias("root_a"), either("root_b", "root_a").alias("root_b")).distinct()
    rest = cut(rest.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    more = _links(rest.select("a", "b"), texts, shingle_words, threshold).filter("ok")
    joined = cut(more.join(rest, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    roots = components(joined)
    of = trees.select(F.col("node").alias("key"), "root").join(roots.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    of = of.select("key", F.coalesce("top", "root").alias("grp")).union(roots.select(F.col("node").alias("key"), F.col("root").alias("grp")))
    of = of.groupBy("key").agg(F.min("grp").alias("grp"))
    grouped = ids.join(of, "key", "left").withColumn("grp", F.coalesce("grp", "key"))
    order = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "key")
    best = grouped.groupBy("grp").agg(F.min(order).alias("best"))
    same = F.expr("doc_id <=> best.doc_id and key = best.key")
    return cut(grouped.join(best, "grp").select("doc_id", "key", "n", "grp", same.alias("keep")))


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """docs less all but one document of each group of exact and near copies: the least doc_id stays, nulls last, then the least MD5 of the text.

    Null texts are kept, as they are no copies of anything; empty ones are copies of
    each other; very long ones are compared whole; of equal rows of the document that
    stays, one stays.  All columns come through, whatever their names; documents of
    the same doc_id but different texts are told apart.  An empty table gives one.
    """
    groups = copy_groups(docs, **how)
    own_id, own_key, own_keep, of = fresh(docs.columns, "group_id", "group_key", "group_keep", "text_key")
    mark = groups.filter("not keep or n > 1").select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key), F.col("keep").alias(own_keep))
    marked = docs.withColumn(of, F.unhex(F.md5(docs["text"].cast("binary"))))
    marked = marked.join(mark, (F.col(of) == F.col(own_key)) & marked["doc_id"].eqNullSafe(F.col(own_id)), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = marked.filter(F.col(own_keep).isNull()).select(*columns)
    several = marked.filter(F.col(own_keep)).dropDuplicates([own_id, own_key]).select(*columns)
    return single.unionByName(several)


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, copies): a row for each document that stays, with the sorted doc_ids of the copies that go.

    Null texts have rows without copies, as many as there are; empty texts are
    copies of each other; very long ones are compared whole.  Which document of a group
    stays is settled as in near_dedup, and repeated rows of it count once.  Columns
    other than doc_id and text, whatever their names, are left out; an empty table
    gives one.
    """
    ids = f"array<{dict(docs.dtypes)['doc_id']}>"
    groups = copy_groups(docs, **how)
    gone = F.array_sort(F.collect_list(F.when(~F.col("keep"), F.col("doc_id"))))
    kept = F.max(F.when(F.col("keep"), F.struct("doc_id")))["doc_id"]
    of = groups.groupBy("grp").agg(kept.alias("doc_id"), gone.alias("copies")).select("doc_id", "copies")
    void = without(docs, "copies").filter("text is null").select("doc_id", F.array().cast(ids).alias("copies"))
    return of.select("doc_id", F.col("copies").cast(ids).alias("copies")).unionByName(void)
