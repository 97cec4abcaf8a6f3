"""Similarity signals of aligned rasters, from pixel rows (pair_id, y, x, a, b) or, for gradients, from image blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy import ndarray as Arr
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.raster import canny, gaussian, sobel, stretched


#: Pixels whose two-way histograms one task makes.
TASK_PIXELS = 1 << 19


def ncc(pixels: DataFrame, least: int = 16, empty: float = 0.0) -> DataFrame:
    """(pair_id, n, ncc): Pearson correlation; empty where either side is flat or fewer than least pixels are valid."""
    g = pixels.filter("a is not null and b is not null").groupBy("pair_id").agg(F.count("*").alias("n"), F.covar_pop("a", "b").alias("c"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"))
    ok = (F.col("n") >= least) & (F.col("va") > 1e-12) & (F.col("vb") > 1e-12)
    return g.select("pair_id", "n", F.when(ok, F.col("c") / F.sqrt(F.col("va") * F.col("vb"))).otherwise(empty).alias("ncc"))


def _bin(v: str, lo: str, hi: str, bins: int) -> Column:
    """Equal bins over [lo, hi], the last one closed; a flat side is one bin."""
    return F.when(F.col(hi) > F.col(lo), F.least(F.lit(bins - 1), F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins).cast("int"))).otherwise(0)


def nmi(pixels: DataFrame, bins: int = 32) -> DataFrame:
    """(pair_id, nmi): marginal entropies over the joint one of the two-way histogram, in [1, 2]; 2 where the joint entropy is 0.

    Pairs are dealt to as many tasks as hold about TASK_PIXELS pixels each; a pair's counts
    are all made in its task, so that a task's memory doesn't grow with the table.
    """
    parts = max(pixels.sparkSession.sparkContext.defaultParallelism, -(-pixels.count() // TASK_PIXELS))
    pixels = pixels.select("pair_id", "a", "b").repartition(parts, "pair_id")
    ends = pixels.groupBy("pair_id").agg(*(f(c).alias(f"{n}{c}") for c in "ab" for n, f in (("lo", F.min), ("hi", F.max))))
    joint = pixels.join(ends, "pair_id").groupBy("pair_id", _bin("a", "loa", "hia", bins).alias("i"), _bin("b", "lob", "hib", bins).alias("j")).agg(F.count("*").alias("c"))

    # the two-way histogram and both sides' own, in one pass
    none = F.lit(None).cast("int")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("of"), F.col("i").cast("int").alias("i") if "a" in n else none.alias("i"), F.col("j").cast("int").alias("j") if "b" in n else none.alias("j")) for n in ("ab", "a", "b"))))
    counts = joint.select("pair_id", "c", each.alias("x")).groupBy("pair_id", "x.of", "x.i", "x.j").agg(F.sum("c").alias("c"))

    def entropy(n: str) -> Column:
        # H = ln N - sum c ln c / N
        c = F.when(F.col("of") == n, F.col("c"))
        return (F.log(F.sum(c)) - F.sum(c * F.log(c)) / F.sum(c)).alias(f"h{n}")

    h = counts.groupBy("pair_id").agg(*(entropy(n) for n in ("ab", "a", "b")))
    return h.select("pair_id", F.when(F.col("hab") <= 1e-12, 2.0).otherwise((F.col("ha") + F.col("hb")) / F.col("hab")).alias("nmi"))


def _gradients(z: Arr) -> tuple[Arr, Arr]:
    return sobel(gaussian(z, 1.0))


def _corr(a: Arr, b: Arr) -> float:
    a, b = a - a.mean(), b - b.mean()
    n = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / n) if n > 1e-9 else 0.0


def plain_ncc(a: Arr, b: Arr) -> float:
    """Correlation of values; 0 where either side is flat."""
    return _corr(a, b)


def grad_ncc(a: Arr, b: Arr) -> float:
    """Correlation of gradient magnitudes, blind to the sign of contrast."""
    return _corr(*(np.hypot(*_gradients(z)) for z in (a, b)))


def ngf(a: Arr, b: Arr) -> float:
    """Mean squared cosine of gradient angles where both gradients exceed a tenth of their mean magnitude; 0.5, as of chance, with fewer than 16 such pixels."""
    (ax, ay), (bx, by) = _gradients(a), _gradients(b)
    na, nb = np.hypot(ax, ay), np.hypot(bx, by)
    least = max(0.1 * float(na.mean() + nb.mean()) / 2, 1e-6)
    some = (na > least) & (nb > least)
    if some.sum() < 16:
        return 0.5
    return float(np.mean((ax * bx + ay * by)[some] ** 2 / np.maximum((na[some] * nb[some]) ** 2, 1e-12)))


def cfog_features(z: Arr, bins: int = 8, sigma: float = 2.0) -> Arr:
    """Channel features of oriented gradients: projections on bins directions without sign, smoothed in space and over directions, of unit length a pixel."""
    dx, dy = _gradients(z)
    t = np.arange(bins) * np.pi / bins
    f = np.stack([gaussian(np.abs(dx * np.cos(u) + dy * np.sin(u)), sigma) for u in t])
    f = (np.roll(f, 1, 0) + 2 * f + np.roll(f, -1, 0)) / 4
    f = f - f.mean(axis=0)
    n = np.sqrt((f * f).sum(axis=0))
    return np.where(n > 1e-6, f / np.maximum(n, 1e-6), 0)


def cfog(a: Arr, b: Arr) -> float:
    """Mean product of features where either side has structure; 0 with fewer than 16 such pixels."""
    x, y = cfog_features(a), cfog_features(b)
    some = (np.sqrt((x * x).sum(axis=0)) > 0.5) | (np.sqrt((y * y).sum(axis=0)) > 0.5)
    return float((x * y).sum(axis=0)[some].mean()) if some.sum() >= 16 else 0.0


def edge_dice(a: Arr, b: Arr, reach: int = 2) -> float:
    """Share of both sets of edges, of rasters stretched to bytes, that lie within reach of the other; 0 without edges."""

    def grown(e):
        p = np.pad(e, reach)
        return np.any([p[i : i + e.shape[0], j : j + e.shape[1]] for i in range(2 * reach + 1) for j in range(2 * reach + 1)], axis=0)

    x, y = canny(stretched(a)), canny(stretched(b))
    n = x.sum() + y.sum()
    return float(((x & grown(y)).sum() + (y & grown(x)).sum()) / n) if n else 0.0


def plain_nmi(a: Arr, b: Arr, bins: int = 32) -> float:
    """Marginal entropies over the joint one of the two-way histogram; 2 where the joint entropy is 0."""
    joint = np.histogram2d(a.reshape(-1), b.reshape(-1), bins)[0]
    joint /= max(joint.sum(), 1.0)
    h = lambda p: float(-(p[p > 0] * np.log(p[p > 0])).sum())
    both = h(joint)
    return 2.0 if both <= 0 else (h(joint.sum(axis=1)) + h(joint.sum(axis=0))) / both


def structural(a: Arr, b: Arr, valid: Arr, measure=grad_ncc, least: int = 256, side: int = 16) -> float:
    """A measure on the crop of the valid pixels with holes filled by the mean; -1 where too little is left."""
    ys, xs = np.flatnonzero(valid.any(axis=1)), np.flatnonzero(valid.any(axis=0))
    if valid.sum() < least or not len(ys) or np.ptp(ys) + 1 < side or np.ptp(xs) + 1 < side:
        return -1.0
    box = (slice(ys[0], ys[-1] + 1), slice(xs[0], xs[-1] + 1))
    v = valid[box]
    return measure(*(np.where(v, z[box], z[box][v].mean()) for z in (a, b)))


def token_cosine(a: Arr, b: Arr, tokens=None) -> float:
    """Mean cosine of the dense tokens of two aligned rasters; tokens makes them, rows of floats, of a raster, by default the registered 'dense' kernel 'dino'."""
    from ..functions import plugins

    tokens = tokens or plugins.get("dense", "dino")()
    x, y = (np.asarray(tokens(z), float) for z in (a, b))
    n = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    return float(np.mean((x * y).sum(axis=1) / np.maximum(n, 1e-12)))


MEASURES = {"grad_ncc": grad_ncc, "ngf": ngf, "cfog": cfog, "edge_dice": edge_dice}
#: How a frame's agreement with the map may be measured once it is placed.
KINDS = {"ncc": plain_ncc, "nmi": plain_nmi, "dino": token_cosine, **MEASURES}


def aligned(pairs: DataFrame) -> DataFrame:
    """(frame_id, kind, measure) of pairs (frame_id, kind, a, b, tx, ty, height, width, query, ref_height, ref_width, reference): each row's own measure.

    The map is brought to the frame's pixels.  'ncc' takes the pixels that both have,
    the others the crop that holds them with holes filled by the mean; -1 where too few
    are left, null where a raster or the transform is missing.  An unknown kind is an error.
    """
    from .pose import _sample

    from ..functions import plugins

    kind_of = pairs.schema["frame_id"].dataType.simpleString()
    make = plugins.registered("dense", "dino")  # registered on the driver, made in the worker

    def run(batches):
        tokens = make() if make else None
        kinds = {**KINDS, "dino": lambda a, b: token_cosine(a, b, tokens)}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["kind"] not in KINDS:
                    raise ValueError(f"no measure '{r['kind']}'; there are {', '.join(sorted(KINDS))}")
                if r["query"] is None or r["reference"] is None or r["a"] is None:
                    out.append(None)
                    continue
                q = np.frombuffer(r["query"], np.uint8).reshape(r["height"], r["width"]).astype(float)
                z = np.frombuffer(r["reference"], np.uint8).reshape(r["ref_height"], r["ref_width"]).astype(float)
                y, x = np.mgrid[0 : r["height"], 0 : r["width"]].astype(float)
                m, inside = _sample(z, r["a"] * x - r["b"] * y + r["tx"], r["b"] * x + r["a"] * y + r["ty"])
                if r["kind"] == "ncc":
                    out.append(plain_ncc(q[inside], m[inside]) if inside.sum() >= 16 else -1.0)
                else:
                    out.append(structural(q, m, inside, kinds[r["kind"]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["frame_id", "kind", "measure"])

    cols = ("frame_id", "kind", "a", "b", "tx", "ty", "height", "width", "query", "ref_height", "ref_width", "reference")
    return pairs.select(*cols).mapInArrow(run, f"frame_id {kind_of}, kind string, measure double")


def gradient_signals(pairs: DataFrame) -> DataFrame:
    """(pair_id, one column a measure) of pairs (pair_id, height, width, a, b) of row-major array<double> rasters, in Arrow batches.

    Rasters are taken from a batch one pair at a time, so a worker holds a batch and a pair.
    """

    def run(batches):
        for batch in batches:
            got = {m: [] for m in MEASURES}
            for k in range(batch.num_rows):
                size = [batch.column(c)[k].as_py() for c in ("height", "width")]
                a, b = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).reshape(size) for c in "ab")
                for m, f in MEASURES.items():
                    got[m].append(f(a, b))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.float64()) for v in got.values())], names=["pair_id", *got])

    return pairs.select("pair_id", "height", "width", "a", "b").mapInArrow(run, "pair_id bigint, " + ", ".join(f"{m} double" for m in MEASURES))


def average_pool(pixels: DataFrame, side: int, size: int) -> DataFrame:
    """(image_id, k, v): the means of a size x size raster's side x side blocks (k by rows), less their mean, of unit length; a flat one stays zero."""
    step = size // side
    cell = (F.floor(F.col("y") / step) * side + F.floor(F.col("x") / step)).cast("bigint").alias("k")
    g = pixels.groupBy("image_id", cell).agg(F.avg("v").alias("v"))
    g = g.join(g.groupBy("image_id").agg(F.avg("v").alias("m")), "image_id").select("image_id", "k", (F.col("v") - F.col("m")).alias("v"))
    n = g.groupBy("image_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return g.join(n, "image_id").select("image_id", "k", F.when(F.col("norm") > 0, F.col("v") / F.col("norm")).otherwise(0.0).alias("v"))
