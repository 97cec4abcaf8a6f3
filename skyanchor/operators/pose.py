"""Storey two: similarity transforms from correspondences, by aggregates.

A correspondence row is (frame_id, i, qx, qy, rx, ry); a transform maps
(x, y) to (a x - b y + tx, b x + a y + ty).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.geo import _c, wrap_deg

T = ("a", "b", "tx", "ty")


def scale(a="a", b="b") -> Column:
    return F.hypot(_c(a), _c(b))


def rotation_deg(a="a", b="b") -> Column:
    return F.degrees(F.atan2(_c(b), _c(a)))


def apply(x, y, a="a", b="b", tx="tx", ty="ty") -> tuple[Column, Column]:
    x, y = _c(x), _c(y)
    return _c(a) * x - _c(b) * y + _c(tx), _c(b) * x + _c(a) * y + _c(ty)


def inverse(a="a", b="b", tx="tx", ty="ty") -> tuple[Column, Column, Column, Column]:
    a, b, tx, ty = (_c(v) for v in (a, b, tx, ty))
    n = a * a + b * b
    return a / n, -b / n, -(a * tx + b * ty) / n, -(a * ty - b * tx) / n


def fit_similarity(corr: DataFrame, by: str = "frame_id") -> DataFrame:
    """(by, n, a, b, tx, ty): the least-squares transform; null parameters where the points don't spread."""
    m = corr.groupBy(by).agg(
        F.count("*").alias("n"),
        *(F.avg(c).alias(f"m{c}") for c in ("qx", "qy", "rx", "ry")),
        (F.var_pop("qx") + F.var_pop("qy")).alias("vv"),
        (F.covar_pop("qx", "rx") + F.covar_pop("qy", "ry")).alias("ca"),
        (F.covar_pop("qx", "ry") - F.covar_pop("qy", "rx")).alias("cb"),
    )
    fitted = m.withColumn("a", F.when(F.col("vv") > 0, F.col("ca") / F.col("vv"))).withColumn("b", F.when(F.col("vv") > 0, F.col("cb") / F.col("vv")))
    return fitted.select(
        by, "n", "a", "b", (F.col("mrx") - F.col("a") * F.col("mqx") + F.col("b") * F.col("mqy")).alias("tx"), (F.col("mry") - F.col("b") * F.col("mqx") - F.col("a") * F.col("mqy")).alias("ty")
    )


def residual() -> Column:
    """Distance of a joined correspondence from where its transform puts it."""
    x, y = apply("qx", "qy")
    return F.hypot(x - F.col("rx"), y - F.col("ry"))


def rmse_inliers(corr: DataFrame, transforms: DataFrame, threshold_px: float = 3.0) -> DataFrame:
    """(frame_id, n_points, n_inliers, inlier_ratio, rmse_px), rmse over inliers and infinite without any."""
    j = corr.join(transforms.select("frame_id", *T), "frame_id").withColumn("d", residual())
    inside = F.col("d") <= threshold_px
    rmse = F.sqrt(F.avg(F.when(inside, F.col("d") * F.col("d"))))
    return j.groupBy("frame_id").agg(
        F.count("*").alias("n_points"), F.count_if(inside).alias("n_inliers"), F.avg(inside.cast("double")).alias("inlier_ratio"), F.coalesce(rmse, F.lit(float("inf"))).alias("rmse_px")
    )


MODEL = "n_points bigint, n_inliers bigint, a double, b double, tx double, ty double, rmse_px double, loss double"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters neighbours."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draw_pairs(n: int, first: int, last: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two different points of n for each of the draws first to last - 1, from a hash of the draw's number: any pair as likely as any other."""
    h = np.arange(first, last, dtype=np.uint64) * np.uint64(2) + np.uint64(2 * seed << 32)
    i = _mix(h + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)
    j = (i + np.uint64(1) + _mix(h + np.uint64(0x9E3779B97F4A7C16)) % np.uint64(n - 1)) % np.uint64(n)
    return i.astype(np.int64), j.astype(np.int64)


def _least_squares(z: np.ndarray, w: np.ndarray) -> tuple[complex, complex] | None:
    """c, t of w = c z + t by least squares, points as complex numbers; None where they don't spread."""
    mz, mw = z.mean(), w.mean()
    ss = float((np.abs(z - mz) ** 2).sum())
    if len(z) < 2 or ss <= 1e-12:
        return None
    c = complex((np.conj(z - mz) * (w - mw)).sum() / ss)
    return (c, complex(mw - c * mz)) if abs(c) > 0 else None


def search(z: np.ndarray, w: np.ndarray, threshold_px: float, cap_px: float | None, most: int, confidence: float, least_baseline: float, refits: int = 10):
    """The transform (c, t) with the largest consensus, or with cap_px the least truncated squared loss, and the mask of its inliers; None without any.

    Pairs are drawn from all points until, by the share of the best so far, a draw
    of two inliers has been missed with a probability of at most 1 - confidence, or
    there were most of them.  The first best wins; it is refitted on its inliers
    until they don't change.
    """
    n = len(z)
    if n < 2:
        return None
    span = np.hypot(np.ptp(z.real), np.ptp(z.imag))
    shortest = min(least_baseline, span / 10)
    best, best_key, need, h = None, None, most, 0
    while h < min(need, most):
        to = min(most, h + max(1, min(64, (1 << 22) // n)))
        i, j = draw_pairs(n, h, to)
        h = to
        dz, dw = z[j] - z[i], w[j] - w[i]
        ok = (np.abs(dz) > shortest) & (np.abs(dw) > 0)
        if not ok.any():
            continue
        c = dw[ok] / dz[ok]
        t = w[i][ok] - c * z[i][ok]
        d2 = np.abs(c[:, None] * z[None, :] + t[:, None] - w[None, :]) ** 2
        inside = (d2 <= threshold_px**2).sum(axis=1)
        key = inside if cap_px is None else -np.minimum(d2, cap_px**2).sum(axis=1)
        k = int(np.argmax(key))
        if best is None or key[k] > best_key:
            best, best_key = (complex(c[k]), complex(t[k])), key[k]
            share = inside[k] / n
            need = h if share >= 1 else most if share <= 0 else int(np.ceil(np.log(1 - confidence) / np.log1p(-share * share)))
    if best is None:
        return None
    within = lambda m: np.abs(m[0] * z + m[1] - w) <= threshold_px
    mask = within(best)
    for _ in range(refits):
        again = _least_squares(z[mask], w[mask]) if mask.sum() >= 2 else None
        if again is None:
            break
        new = within(again)
        if new.sum() < 2:
            break
        best, same, mask = again, bool((new == mask).all()), new
        if same:
            break
    return best, mask


def _by_frame(corr: DataFrame, f, out: str) -> DataFrame:
    """f(z, w) -> tuple of values or None for the points of each frame_id, whatever its type, in the order of their values; one row a frame."""
    kind = corr.schema["frame_id"].dataType.simpleString()
    names = [c.split()[0] for c in out.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        q = np.stack([np.asarray(table.column(c)).astype(float) for c in ("qx", "qy", "rx", "ry")])
        q = q[:, np.isfinite(q).all(axis=0)]
        q = q[:, np.lexsort(q[::-1])]
        got = f(q[0] + 1j * q[1], q[2] + 1j * q[3])
        keys = pa.array(table.column("frame_id").slice(0, 0 if got is None else 1).to_pylist(), types[0])
        return pa.table([keys, *(pa.array([] if got is None else [v], t) for v, t in zip(got or names, types[1:]))], names=["frame_id", *names])

    types = to_arrow_schema(StructType.fromDDL(f"frame_id {kind}, {out}")).types
    return corr.select("frame_id", "qx", "qy", "rx", "ry").groupBy("frame_id").applyInArrow(run, f"frame_id {kind}, {out}")


def consensus(corr: DataFrame, threshold_px: float = 3.0, min_inliers: int = 10, *, most: int = 5000, confidence: float = 0.999, least_baseline: float = 50.0) -> DataFrame:
    """(frame_id, n_points, n_inliers, a, b, tx, ty, rmse_px, loss, mqx, mqy, spread2): search()'s transform of each frame, null where it has too few inliers.

    A frame is searched in one task, over all its points with finite values, in
    whatever order they come.  mqx, mqy are the mean of the inliers and spread2 their
    sum of squared distances from it, of which read_variance() makes the centre's variance.
    """

    def one(z, w):
        found = search(z, w, threshold_px, None, most, confidence, least_baseline)
        if found is None or found[1].sum() < max(2, min_inliers):
            return (len(z), *[None] * 10)
        (c, t), mask = found
        d2, q = np.abs(c * z + t - w)[mask] ** 2, z[mask]
        m = complex(q.mean())
        return len(z), int(mask.sum()), c.real, c.imag, t.real, t.imag, float(np.sqrt(d2.mean())), float(d2.sum()), m.real, m.imag, float((np.abs(q - m) ** 2).sum())

    return _by_frame(corr, one, MODEL + ", mqx double, mqy double, spread2 double")


def read_variance(cx: float, cy: float) -> Column:
    """center_variance(), in square pixels, of a row of consensus()."""
    n, off = F.col("n_inliers"), F.pow(cx - F.col("mqx"), 2) + F.pow(cy - F.col("mqy"), 2)
    return F.when((n >= 3) & (F.col("spread2") > 0), F.col("loss") / (2 * n - 4) * (1 / n + off / F.col("spread2")))


def ransac(corr: DataFrame, threshold_px: float = 3.0, min_inliers: int = 10, min_scale: float | None = None, max_scale: float | None = None, **how) -> DataFrame:
    """(frame_id, n_points, n_inliers, a, b, tx, ty, rmse_px, loss): consensus() of the frames that have one.

    A frame whose best has too few inliers, or whose scale is out of bounds, has no row: a refusal is a left join away.
    """
    out = consensus(corr, threshold_px, min_inliers, **how).filter("n_inliers is not null").drop("mqx", "mqy", "spread2")
    if min_scale is not None:
        out = out.filter(scale() >= min_scale)
    if max_scale is not None:
        out = out.filter(scale() <= max_scale)
    return out


def msac(corr: DataFrame, cap_px: float = 12.0, *, most: int = 5000, confidence: float = 0.999, least_baseline: float = 50.0) -> DataFrame:
    """ransac()'s columns for the transform of least truncated squared loss, refitted; inliers lie within cap_px / 2, loss counts all points."""

    def one(z, w):
        found = search(z, w, cap_px / 2, cap_px, most, confidence, least_baseline)
        if found is None:
            return None
        (c, t), mask = found
        d2 = np.abs(c * z + t - w) ** 2
        rmse = float(np.sqrt(d2[mask].mean())) if mask.any() else float("inf")
        return len(z), int(mask.sum()), c.real, c.imag, t.real, t.imag, rmse, float(np.minimum(d2, cap_px**2).sum())

    return _by_frame(corr, one, MODEL)


def within_rotation(expected_deg, tolerance_deg: float = 15.0) -> Column:
    """Whether a transform turns as expected; true where nothing is expected."""
    return F.coalesce(F.abs(wrap_deg(rotation_deg() - _c(expected_deg))) <= tolerance_deg, F.lit(True))


def inliers_of(corr: DataFrame, transforms: DataFrame, threshold_px: float = 3.0) -> DataFrame:
    """The correspondences within threshold_px of where their frame's transform puts them."""
    return corr.join(transforms.select("frame_id", *T), "frame_id").filter(residual() <= threshold_px).select(*corr.columns)


def weighted_refit(corr: DataFrame, transforms: DataFrame, sigma_px: float = 1.0) -> DataFrame:
    """The transform refitted with weights 1 / (sigma^2 + d^2) of the points' distances d from the first."""
    j = corr.join(transforms.select("frame_id", *T), "frame_id").withColumn("w", 1 / (F.lit(sigma_px**2) + F.pow(residual(), 2)))
    s = {c: F.sum(F.col("w") * F.col(c)) / F.sum("w") for c in ("qx", "qy", "rx", "ry")}
    means = j.groupBy("frame_id").agg(*(v.alias(f"m{c}") for c, v in s.items()))
    k = j.join(means, "frame_id")
    dx, dy, ex, ey = (F.col(c) - F.col(f"m{c}") for c in ("qx", "qy", "rx", "ry"))
    g = k.groupBy("frame_id", "mqx", "mqy", "mrx", "mry").agg(
        F.sum(F.col("w") * (dx * dx + dy * dy)).alias("vv"), F.sum(F.col("w") * (dx * ex + dy * ey)).alias("ca"), F.sum(F.col("w") * (dx * ey - dy * ex)).alias("cb")
    )
    g = g.withColumn("a", F.col("ca") / F.col("vv")).withColumn("b", F.col("cb") / F.col("vv"))
    return g.select("frame_id", "a", "b", (F.col("mrx") - F.col("a") * F.col("mqx") + F.col("b") * F.col("mqy")).alias("tx"), (F.col("mry") - F.col("b") * F.col("mqx") - F.col("a") * F.col("mqy")).alias("ty"))


def center_variance(corr: DataFrame, transforms: DataFrame, cx: float, cy: float, mpp: float = 1.0, floor_m: float = 0.0) -> DataFrame:
    """(frame_id, n, variance_m2): the isotropic variance of where the centre lands; null below 3 points.

    sigma^2 (1/n + |c - mean|^2 / SS) mpp^2 + floor^2 with sigma^2 = sum r^2 / (2n - 4).
    """
    j = corr.join(transforms.select("frame_id", *T), "frame_id").withColumn("d2", F.pow(residual(), 2))
    g = j.groupBy("frame_id").agg(F.count("*").alias("n"), F.sum("d2").alias("rss"), F.avg("qx").alias("mx"), F.avg("qy").alias("my"), (F.var_pop("qx") + F.var_pop("qy")).alias("vv"))
    off = F.pow(cx - F.col("mx"), 2) + F.pow(cy - F.col("my"), 2)
    v = F.col("rss") / (2 * F.col("n") - 4) * (1 / F.col("n") + off / (F.col("n") * F.col("vv"))) * mpp**2 + floor_m**2
    return g.select("frame_id", "n", F.when((F.col("n") >= 3) & (F.col("vv") > 0), v).alias("variance_m2"))


def error_ellipse(xx, xy, yy) -> tuple[Column, Column, Column]:
    """Semi-axes and the angle of the major one, in [-90, 90), of a 2 x 2 covariance; 0 for an isotropic one."""
    xx, xy, yy = (_c(v) for v in (xx, xy, yy))
    mid, half = (xx + yy) / 2, F.hypot((xx - yy) / 2, xy)
    angle = F.pmod(F.degrees(0.5 * F.atan2(2 * xy, xx - yy)) + 90, F.lit(180.0)) - 90
    return F.sqrt(F.greatest(mid + half, F.lit(0.0))), F.sqrt(F.greatest(mid - half, F.lit(0.0))), angle


def inlier_spread(corr: DataFrame, width: float, height: float) -> DataFrame:
    """(frame_id, spread): mean distance of a frame's pairs of points over the image's diagonal; 0 for one point.

    Pairs are counted block by block within the frame's task, so none is ever a row.
    """
    diagonal = float(np.hypot(width, height))

    def one(z, w):
        n, total = len(z), 0.0
        for at in range(0, n, 1024):
            for to in range(at, n, 1024):
                d = np.abs(z[at : at + 1024, None] - z[None, to : to + 1024]).sum()
                total += float(d) / 2 if to == at else float(d)
        return (total / (n * (n - 1) / 2) / diagonal if n > 1 and diagonal > 0 else 0.0,)

    return _by_frame(corr, one, "spread double")


def bootstrap_scatter(inliers: DataFrame, cx: float, cy: float, draws: int = 32, seed: int = 0) -> DataFrame:
    """(frame_id, scatter_px): median distance, from their median, of the centres of fits to draws of as many inliers with replacement.

    Infinite below 4 inliers or if under half of the draws fit.  The draws come from a hash of their number.
    """

    def one(z, w):
        n = len(z)
        if n < 4:
            return (float("inf"),)
        at = (_mix(np.arange(draws * n, dtype=np.uint64) + np.uint64((seed + 1) << 40)) % np.uint64(n)).astype(np.int64).reshape(draws, n)
        fits = [m for row in at if (m := _least_squares(z[row], w[row])) is not None]
        if 2 * len(fits) < draws:
            return (float("inf"),)
        x = np.array([c * complex(cx, cy) + t for c, t in fits])
        return (float(np.median(np.abs(x - complex(np.median(x.real), np.median(x.imag))))),)

    return _by_frame(inliers, one, "scatter_px double")


def ecc_projection(a00, a01, a10, a11) -> tuple[Column, Column]:
    """(a, b) of the similarity nearest to an affine refinement."""
    return (_c(a00) + _c(a11)) / 2, (_c(a10) - _c(a01)) / 2


def ecc_accepted(shift_px, old_scale, new_scale, old_deg, new_deg, max_shift: float = 8.0, max_scale: float = 1.05, max_deg: float = 2.0) -> Column:
    ratio = _c(new_scale) / _c(old_scale)
    return (_c(shift_px) <= max_shift) & (F.greatest(ratio, 1 / ratio) <= max_scale) & (F.abs(wrap_deg(_c(new_deg) - _c(old_deg))) <= max_deg)


def _sobel_smooth(z: np.ndarray, size: int) -> np.ndarray:
    """Gaussian smoothing by a kernel of size taps, borders reflected."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-0.5 * (np.arange(size) - size // 2) ** 2 / sigma**2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (size // 2, size // 2)
        p = np.pad(z, pad, mode="reflect")
        z = sum(k[i] * np.take(p, np.arange(i, i + z.shape[axis]), axis) for i in range(size))
    return z


def _sample(z: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear values of z at (x, y), and whether the places are inside."""
    h, w = z.shape
    inside = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    return (z[y0, x0] * (1 - fx) + z[y0, x1] * fx) * (1 - fy) + (z[y1, x0] * (1 - fx) + z[y1, x1] * fx) * fy, inside


def ecc_affine(query: np.ndarray, reference: np.ndarray, start: np.ndarray, iterations: int = 100, eps: float = 1e-6, smooth: int = 5) -> np.ndarray | None:
    """The 2 x 3 affine map from query to reference pixels that maximises their enhanced correlation (Evangelidis and Psarakis), from start on; None where it doesn't converge.

    Each step linearises the warped reference in the six parameters and moves by
    the closed form of the correlation's maximum.
    """
    q, r = _sobel_smooth(query.astype(float), smooth), _sobel_smooth(reference.astype(float), smooth)
    gy, gx = np.gradient(r)
    h, w = q.shape
    yy, xx = (v.reshape(-1) for v in np.mgrid[0:h, 0:w].astype(float))
    warp, last = start.astype(float).copy(), -2.0
    for _ in range(iterations):
        x, y = warp[0, 0] * xx + warp[0, 1] * yy + warp[0, 2], warp[1, 0] * xx + warp[1, 1] * yy + warp[1, 2]
        v, inside = _sample(r, x, y)
        if inside.sum() < 64:
            return None
        dx, dy = _sample(gx, x, y)[0] * inside, _sample(gy, x, y)[0] * inside
        jacobian = np.stack([dx * xx, dy * xx, dx * yy, dy * yy, dx, dy], axis=1)
        t = np.where(inside, q.reshape(-1) - q.reshape(-1)[inside].mean(), 0)
        i = np.where(inside, v - v[inside].mean(), 0)
        jacobian -= np.where(inside[:, None], jacobian[inside].mean(axis=0), 0)
        nt, ni = float(np.linalg.norm(t)), float(np.linalg.norm(i))
        if nt <= 1e-9 or ni <= 1e-9:
            return None
        rho = float(t @ i) / (nt * ni)
        if abs(rho - last) < eps:
            return warp
        last = rho
        hessian = jacobian.T @ jacobian
        try:
            gi, gt = np.linalg.solve(hessian, np.stack([jacobian.T @ i, jacobian.T @ t], axis=1)).T
        except np.linalg.LinAlgError:
            return None
        top, bottom = ni**2 - float((jacobian.T @ i) @ gi), float(t @ i) - float((jacobian.T @ t) @ gi)
        if bottom <= 0:
            return None
        step = top / bottom * gt - gi
        warp += step.reshape(3, 2).T
        if not np.isfinite(warp).all():
            return None
    return warp


def refine_ecc(pairs: DataFrame, iterations: int = 100, max_shift: float = 8.0, max_scale: float = 1.05, max_deg: float = 2.0) -> DataFrame:
    """pairs (frame_id, …, a, b, tx, ty, height, width, query, ref_height, ref_width, reference) with the refined transform and refined, without the rasters.

    Rasters are bytes in rows.  The affine refinement is projected on the nearest
    similarity and taken only near the transform that it started from; else, and
    where a raster is missing, that one stays and refined is false.
    """
    rasters = {"query", "reference"}
    kept = [f for f in pairs.schema if f.name not in rasters]

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["refined"] = False
                if r["query"] is None or r["reference"] is None or r["a"] is None:
                    continue
                q = np.frombuffer(r["query"], np.uint8).reshape(r["height"], r["width"])
                z = np.frombuffer(r["reference"], np.uint8).reshape(r["ref_height"], r["ref_width"])
                m = ecc_affine(q, z, np.array([[r["a"], -r["b"], r["tx"]], [r["b"], r["a"], r["ty"]]]), iterations)
                if m is None:
                    continue
                old, new = complex(r["a"], r["b"]), complex((m[0, 0] + m[1, 1]) / 2, (m[1, 0] - m[0, 1]) / 2)
                centre = complex((r["width"] - 1) / 2, (r["height"] - 1) / 2)
                shift = abs(new * centre + complex(m[0, 2], m[1, 2]) - old * centre - complex(r["tx"], r["ty"]))
                ratio = abs(new) / abs(old) if abs(old) else 0.0
                turn = abs((np.degrees(np.angle(new / old)) + 180) % 360 - 180) if ratio > 0 else 180.0
                if 1 / max_scale <= ratio <= max_scale and turn <= max_deg and shift <= max_shift:
                    r |= {"a": new.real, "b": new.imag, "tx": float(m[0, 2]), "ty": float(m[1, 2]), "refined": True}
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = to_arrow_schema(StructType([*kept, *StructType.fromDDL("refined boolean").fields]))
    return pairs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", refined boolean")
