"""Vector models: PCA from summed moments, random-projection search, PCA compression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a matrix's rows that add up in one group, and cells that a bucket of the approximate search holds.
ROW_BYTES, BUCKET_CELLS = 8 << 20, 8


def normalised(vector) -> Column:
    """A vector of unit length; zero stays zero, null null."""
    v = F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def _moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and sum of outer products of the embeddings; partitions' matrices add up by rows in a shuffle, so the driver gets one."""

    def run(batches):
        n, total = 0, None
        for batch in batches:
            v = batch.column(0)
            if len(v):
                x = np.asarray(v.flatten()).astype(float).reshape(len(v), -1)
                part = np.concatenate([np.full((1, x.shape[1]), float(len(x))), x.sum(axis=0)[None], x.T @ x])
                n, total = n + len(x), part if total is None else total + part
        if total is not None:
            part_id = TaskContext.get().partitionId()
            step = max(1, ROW_BYTES // (8 * total.shape[1]))
            for at in range(0, len(total), step):
                rows = total[at : at + step]
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part_id]), pa.array([rows.shape[1]]), pa.array([rows.tobytes()])], names=["at", "part", "d", "m"])

    def added(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")  # the same order each time, so the same sum
        total = sum(np.frombuffer(x.as_py()) for x in table.column("m"))
        return pa.table({"at": table.column("at").slice(0, 1), "d": table.column("d").slice(0, 1), "m": pa.array([total.tobytes()], pa.binary())})

    parts = df.filter("embedding is not null").select(F.col("embedding").cast("array<float>").alias("e")).mapInArrow(run, "at bigint, part bigint, d bigint, m binary")
    rows = sorted(parts.groupBy("at").applyInArrow(added, "at bigint, d bigint, m binary").collect(), key=lambda r: r["at"])
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    m = np.concatenate([np.frombuffer(bytes(r.m)).reshape(-1, r.d) for r in rows])
    return int(m[0, 0]), m[1], m[2:]


def pca_fit(df: DataFrame, k: int) -> DataFrame:
    """(component, variance, share, mean, axis): the k leading axes of (embedding), each signed so that its largest entry is positive."""
    n, s, m = _moments(df)
    spark = df.sparkSession
    schema = "component int, variance double, share double, mean array<double>, axis array<double>"
    if n < 2:
        return spark.createDataFrame([], schema)
    mean = s / n
    cov = (m - n * np.outer(mean, mean)) / (n - 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    rows = []
    for i, j in enumerate(order):
        axis = vectors[:, j] * np.sign(vectors[np.argmax(np.abs(vectors[:, j])), j])
        rows.append((i, float(values[j]), float(values[j] / values.sum()), mean.tolist(), axis.tolist()))
    return spark.createDataFrame(rows, schema)


def pca_apply(df: DataFrame, model: DataFrame, whiten: bool = False) -> DataFrame:
    """df with its embedding projected on the model's axes and scaled to unit length; zero stays zero."""
    got = model.orderBy("component").collect()
    mean, axes = np.array(got[0]["mean"]), np.array([r["axis"] for r in got])
    if whiten:
        axes = axes / np.sqrt(np.maximum([r["variance"] for r in got], 1e-12))[:, None]

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("embedding")
            v = batch.column(at)
            x = np.asarray(v.flatten()).astype(float).reshape(-1, len(mean))
            y = (x - mean) @ axes.T
            norm = np.linalg.norm(y, axis=1, keepdims=True)
            y = np.where(norm > 0, y / np.maximum(norm, 1e-300), 0).astype(np.float32)
            there = np.asarray(v.is_valid())
            off = np.concatenate([[0], np.cumsum(there * len(axes))]).astype(np.int32)
            yield batch.set_column(at, "embedding", pa.ListArray.from_arrays(pa.array(off), pa.array(y.reshape(-1)), mask=pa.array(~there)))

    cols = [F.col("embedding").cast("array<float>").alias("embedding") if c == "embedding" else F.col(c) for c in df.columns]
    base = df.select(*cols)
    return base.mapInArrow(run, base.schema)


def lsh_topk(frames: DataFrame, cells: DataFrame, k: int, tables: int = 32, bits: int | None = None, seed: int = 1) -> DataFrame:
    """(frame_id, cell_id, similarity, rank): approximate top k by signs of random projections, verified by exact dot products.

    Two vectors meet if they agree on all bits of one table; frames also visit the
    buckets one bit away.  bits is by default such that a bucket holds about
    BUCKET_CELLS cells, however many there are.  A bucket is one matrix product that
    gives k rows a frame.  Vectors at a cosine of 0.8 are found with a probability of
    0.99; those hardly nearer than chance are not, and topk_join is for them.
    """
    if bits is None:
        bits = int(np.clip(np.ceil(np.log2(max(1, cells.count()) / BUCKET_CELLS)), 6, 24))

    def keyed(df: DataFrame, name: str, near: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                v = batch.column(1)
                if not len(v):
                    continue
                x = np.asarray(v.flatten()).astype(float).reshape(len(v), -1)
                planes = np.random.default_rng(seed).normal(size=(tables * bits, x.shape[1]))
                sign = ((x @ planes.T) > 0).reshape(len(x), tables, bits)
                code = (sign * (1 << np.arange(bits))).sum(axis=2) + (np.arange(tables) << bits)
                if near:
                    code = np.concatenate([code] + [code ^ (1 << b) for b in range(bits)], axis=1)
                off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * code.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.ListArray.from_arrays(off, pa.array(code.reshape(-1).astype(np.int64)))], names=[name, "e", "codes"])

        some = df.filter("embedding is not null").select(F.col(name).cast("bigint").alias(name), F.col("embedding").cast("array<float>").alias("e"))
        return some.mapInArrow(run, f"{name} bigint, e array<float>, codes array<bigint>").select(name, "e", F.explode("codes").alias("code"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["frame_id", "cell_id", "similarity"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)
        a, b = (np.asarray(t.column("e").combine_chunks().flatten()).astype(float).reshape(t.num_rows, -1) for t in (left, right))
        f_ids, c_ids = np.asarray(left.column("frame_id")), np.asarray(right.column("cell_id"))
        i, j, v = [], [], []
        for at in range(0, len(a), 1024):
            s = a[at : at + 1024] @ b.T
            n = min(k, len(b))
            edge = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
            x, y = np.nonzero(s >= edge - 1e-12)
            i.append(x + at), j.append(y), v.append(s[x, y])
        return pa.table([pa.array(f_ids[np.concatenate(i)]), pa.array(c_ids[np.concatenate(j)]), pa.array(np.concatenate(v))], names=names)

    f, c = keyed(frames, "frame_id", True), keyed(cells, "cell_id", False)
    met = f.groupBy("code").cogroup(c.groupBy("code")).applyInArrow(meet, "frame_id bigint, cell_id bigint, similarity double")
    scored = met.groupBy("frame_id", "cell_id").agg(F.max("similarity").alias("similarity"))
    return scored.selectExpr("*", "cast(row_number() over (partition by frame_id order by similarity desc, cell_id) as bigint) as rank").filter(F.col("rank") <= k)


BACKENDS = {"lsh": lsh_topk}


def search(frames: DataFrame, cells: DataFrame, k: int, backend: str = "exact", **how) -> DataFrame:
    """The k nearest cells of each frame by a search backend: 'exact', 'lsh', or one registered as an 'ann' kernel (frames, cells, k) -> rows."""
    from ..functions import plugins
    from .retrieval import topk_join

    known = {"exact": topk_join, **BACKENDS}
    return (known[backend] if backend in known else plugins.get("ann", backend)())(frames, cells, k, **how)
