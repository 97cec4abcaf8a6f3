"""Planted transforms, refusals and calibration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyanchor.operators import evaluation, pose

SCHEMA = "frame_id bigint, i bigint, qx double, qy double, rx double, ry double"


def planted(spark, frames=3, n=80, outliers=0.0, noise=0.0, seed=0, angle=137.0, scale=1.1):
    rng = np.random.default_rng(seed)
    a, b = scale * math.cos(math.radians(angle)), scale * math.sin(math.radians(angle))
    rows = []
    for f in range(frames):
        q = rng.uniform(0, 512, (n, 2))
        r = np.stack([a * q[:, 0] - b * q[:, 1] + 300, b * q[:, 0] + a * q[:, 1] - 120], 1) + rng.normal(0, noise, (n, 2)) if noise else np.stack([a * q[:, 0] - b * q[:, 1] + 300, b * q[:, 0] + a * q[:, 1] - 120], 1)
        bad = rng.random(n) < outliers
        r[bad] += rng.uniform(50, 300, (bad.sum(), 2))
        rows += [(f, i, *map(float, q[i]), *map(float, r[i])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), a, b


def test_fit_recovers(spark):
    c, a, b = planted(spark)
    for r in pose.fit_similarity(c).collect():
        assert (r.a, r.b, r.tx, r.ty) == pytest.approx((a, b, 300, -120), abs=1e-8)


def test_fit_of_one_point_is_null(spark):
    c = spark.createDataFrame([(0, 0, 1.0, 1.0, 2.0, 2.0)], SCHEMA)
    assert pose.fit_similarity(c).first().a is None
    assert pose.fit_similarity(c.limit(0)).count() == 0


def test_ransac_with_half_outliers(spark):
    c, a, b = planted(spark, outliers=0.5)
    got = pose.ransac(c).collect()
    assert len(got) == 3 and all((r.a, r.b) == pytest.approx((a, b), abs=1e-6) for r in got)


def test_ransac_and_msac_draw_from_all_points(spark):
    rng = np.random.default_rng(5)
    rows = []
    for f, n, bad in ((0, 300, 130), (1, 90, 78)):  # the first 114 points are outliers; one inlier in eight
        for i in range(n):
            x, y = rng.uniform(0, 512, 2)
            u, v = rng.uniform(0, 512, 2) if i < bad else (0.9 * x - 0.2 * y + 30, 0.2 * x + 0.9 * y - 10)
            rows.append((f, i, *map(float, (x, y, u, v))))
    c = spark.createDataFrame(rows, SCHEMA)
    got = {r.frame_id: r for r in pose.ransac(c).collect()}
    assert all((got[f].a, got[f].b) == pytest.approx((0.9, 0.2), abs=1e-2) and got[f].n_inliers >= k for f, k in ((0, 170), (1, 12)))
    assert {r.frame_id for r in pose.msac(c).collect() if r.n_inliers >= (170, 12)[r.frame_id]} == {0, 1}


def test_outliers_that_come_first(spark):
    """Of 1,000 points the first 120 are bad, numbered with gaps, backwards and not at all."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1000):
        x, y = rng.uniform(0, 512, 2)
        u, v = rng.uniform(0, 512, 2) if i < 120 else (1.2 * x + 0.1 * y + 5, -0.1 * x + 1.2 * y + 9)
        rows += [(0, i, x, y, u, v), (1, 10**6 - 17 * i, x, y, u, v), (2, None, x, y, u, v)]
    c = spark.createDataFrame([(f, i, *map(float, r)) for f, i, *r in rows], SCHEMA).repartition(4)
    for r in [*pose.ransac(c).collect(), *pose.msac(c).collect()]:
        assert (r.n_points, r.n_inliers) == (1000, 880) and (r.a, r.b, r.tx, r.ty) == pytest.approx((1.2, -0.1, 5, 9), abs=1e-9) and r.rmse_px < 1e-9


@pytest.mark.parametrize("share", [0.2, 0.4, 0.6])
def test_outliers_up_to_three_in_five(spark, share):
    c, a, b = planted(spark, frames=8, n=300, outliers=share, noise=0.5, seed=int(share * 10))
    got = pose.ransac(c).collect()
    assert len(got) == 8 and all((r.a, r.b) == pytest.approx((a, b), abs=5e-3) and r.n_inliers > 300 * (1 - share) * 0.8 for r in got)


def test_pairs_are_drawn_from_all_points():
    i, j = pose.draw_pairs(1000, 0, 5000)
    assert (i != j).all() and len(np.unique(i)) > 950 and len(np.unique(j)) > 950 and i.max() > 990 and abs(i.mean() - 499.5) < 15
    assert set(zip(*pose.draw_pairs(2, 0, 50))) == {(0, 1), (1, 0)}


def test_rotation_gate(spark):
    c, a, b = planted(spark, angle=137.0)
    f = pose.ransac(c)
    for expected, ok in ((137.0, True), (150.0, True), (153.0, False), (-224.0, True), (100.0, False), (None, True)):
        e = F.lit(expected).cast("double")
        assert f.filter(pose.within_rotation(e)).count() == (3 if ok else 0)


def test_bad_points_are_left_out(spark):
    c, a, b = planted(spark, frames=1, n=30)
    odd = spark.createDataFrame([(0, 99, None, 1.0, 2.0, 3.0), (0, 98, float("nan"), 1.0, 2.0, 3.0), (0, 97, 1.0, 1.0, float("inf"), 3.0), (5, 0, 1.0, 1.0, 1.0, 1.0), (6, 0, None, None, None, None)], SCHEMA)
    r = pose.ransac(c.union(odd)).collect()
    assert len(r) == 1 and (r[0].n_points, r[0].n_inliers) == (30, 30)
    same = spark.createDataFrame([(0, i, 5.0, 5.0, 7.0, 7.0) for i in range(20)], SCHEMA)
    assert pose.ransac(same).count() == 0 and pose.ransac(c.limit(0)).count() == 0
    keyed = c.select(F.struct("frame_id", F.lit("x").alias("cell")).alias("frame_id"), "qx", "qy", "rx", "ry")
    assert pose.ransac(keyed).first().frame_id.cell == "x"


def test_ransac_of_small_units(spark):
    """Points within a few pixels of each other still give a transform."""
    c, a, b = planted(spark, frames=1, n=60)
    tiny = c.select("frame_id", "i", *(((F.col(x)) / 100).alias(x) for x in ("qx", "qy", "rx", "ry")))
    r = pose.ransac(tiny, threshold_px=0.01).first()
    assert (r.a, r.b) == pytest.approx((a, b), abs=1e-6)


def texture(h, w, seed=0):
    y, x = np.mgrid[0:h, 0:w].astype(float)
    rng = np.random.default_rng(seed)
    z = sum(np.sin(x * rng.uniform(-0.25, 0.25) + y * rng.uniform(-0.25, 0.25) + rng.uniform(0, 6)) for _ in range(14))
    return 128 + 28 * z


def warped(z, m, h, w):
    y, x = np.mgrid[0:h, 0:w].astype(float)
    return pose._sample(z, m[0, 0] * x + m[0, 1] * y + m[0, 2], m[1, 0] * x + m[1, 1] * y + m[1, 2])[0]


def test_ecc_refines_to_a_fraction_of_a_pixel(spark):
    rng = np.random.default_rng(3)
    rows, truth = [], {}
    ref = texture(220, 240)
    for k in range(6):
        s, t = rng.uniform(0.97, 1.03), rng.uniform(-0.05, 0.05)
        a, b, tx, ty = s * np.cos(t), s * np.sin(t), rng.uniform(40, 60), rng.uniform(40, 60)
        q = warped(ref, np.array([[a, -b, tx], [b, a, ty]]), 120, 130) * 0.8 + 20  # another exposure
        truth[k] = (a, b, tx, ty)
        at = (a * 1.004, b + 0.004, tx + 1.3, ty - 1.1)
        rows.append((k, *map(float, at), 120, 130, bytearray(np.clip(q, 0, 255).astype(np.uint8)), 220, 240, bytearray(np.clip(ref, 0, 255).astype(np.uint8))))
    rows.append((6, *map(float, truth[0]), 120, 130, None, 220, 240, bytearray(np.clip(ref, 0, 255).astype(np.uint8))))
    noise = rng.integers(0, 255, 120 * 130, dtype=np.uint8)
    rows.append((7, 1.0, 0.0, 50.0, 50.0, 120, 130, bytearray(noise), 220, 240, bytearray(np.clip(ref, 0, 255).astype(np.uint8))))
    rows.append((8, 1.0, 0.0, 50.0, 50.0, 120, 130, bytearray(120 * 130), 220, 240, bytearray(220 * 240)))
    df = spark.createDataFrame(rows, "frame_id bigint, a double, b double, tx double, ty double, height int, width int, query binary, ref_height int, ref_width int, reference binary")
    got = {r.frame_id: r for r in pose.refine_ecc(df).collect()}
    c = complex(64.5, 59.5)
    for k, (a, b, tx, ty) in truth.items():
        r = got[k]
        off = abs(complex(r.a, r.b) * c + complex(r.tx, r.ty) - complex(a, b) * c - complex(tx, ty))
        assert r.refined and off < 0.1, (k, off)
    assert not got[6].refined and not got[7].refined and not got[8].refined
    assert (got[7].a, got[7].tx) == (1.0, 50.0)


def test_ransac_refuses(spark):
    rng = np.random.default_rng(1)
    rows = [(0, i, *map(float, rng.uniform(0, 512, 4))) for i in range(40)]
    noise = spark.createDataFrame(rows, SCHEMA)
    assert pose.ransac(noise).count() == 0
    c, *_ = planted(spark, frames=1)
    assert pose.ransac(c, max_scale=1.05).count() == 0


def test_covariance_coverage(spark):
    """Shares of draws within one and two sigmas of the centre, for two normal coordinates."""
    c, a, b = planted(spark, frames=400, noise=1.0)
    v = pose.center_variance(c, (f := pose.fit_similarity(c)), 256.0, 256.0).join(f, "frame_id")
    x, y = pose.apply(F.lit(256.0), F.lit(256.0))
    d = v.select(((F.pow(x - (a * 256 - b * 256 + 300), 2) + F.pow(y - (b * 256 + a * 256 - 120), 2)) / F.col("variance_m2")).alias("d")).toPandas().d
    assert abs((d <= 1).mean() - 0.393) < 0.07 and abs((d <= 4).mean() - 0.865) < 0.06 and abs(d.mean() - 2) < 0.3


def test_spread_of_uniform_points(spark):
    c, *_ = planted(spark, frames=2, n=200)
    assert all(abs(r.spread - 0.3687) < 0.02 for r in pose.inlier_spread(c, 512, 512).collect())


def test_bootstrap_is_small_for_exact_points(spark):
    c, *_ = planted(spark, frames=1)
    assert pose.bootstrap_scatter(c, 256.0, 256.0).first().scatter_px < 1e-6
    assert math.isinf(pose.bootstrap_scatter(c.filter("i < 3"), 256.0, 256.0).first().scatter_px)


def test_inverse(spark):
    r = spark.range(1).select(*pose.inverse(F.lit(0.5), F.lit(0.3), F.lit(7.0), F.lit(-2.0))).first()
    x, y = 0.5 * 3 - 0.3 * 4 + 7, 0.3 * 3 + 0.5 * 4 - 2
    assert (r[0] * x - r[1] * y + r[2], r[1] * x + r[0] * y + r[3]) == pytest.approx((3, 4))


def test_gate_with_missing_values(spark):
    rows = [(1.0, 50, 0.5), (1.0, 50, None), (float("inf"), 50, 0.5), (float("nan"), 50, 0.5), (1.0, 3, 0.5), (1.0, 50, 0.01), (None, 50, 0.5)]
    df = spark.createDataFrame(rows, "e double, n int, m double")
    got = [r[0] for r in df.select(evaluation.passes_gate(ellipse_m="e", n_inliers="n", bar=F.lit(8), measure="m", threshold=F.lit(0.12))).collect()]
    assert got == [True, True, False, False, False, False, False]


@pytest.mark.parametrize(
    "status,accepted,correct,blame,want",
    [
        ("localized", 1, 1, "ok", "accepted_correct"), ("localized", 1, 0, "", "accepted_wrong"), ("low_confidence", 0, 1, "", "pose_correct_gated"), ("low_confidence", 0, 0, "", "pose_wrong_gated"),
        ("localized", 1, None, "", "accepted_unverified"), ("low_confidence", 0, None, "", "pose_gated_unverified"), ("not_localized", 0, None, "floor 1 x", "refused_floor1"),
        ("not_localized", 0, None, "floor 2", "refused_floor2"), ("not_localized", 0, None, "other", "refused"), ("error", None, None, None, "error"),
    ],
)
def test_outcomes(spark, status, accepted, correct, blame, want):
    df = spark.createDataFrame([(status, accepted, correct, blame)], "status string, accepted int, correct int, blame string")
    assert df.select(evaluation.outcome()).first()[0] == want


def test_both_quantiles(spark):
    df = spark.createDataFrame([(float(2**i),) for i in range(7)], "v double")
    assert evaluation.exclusive_quantile(df, "v", 0.9).first().q == pytest.approx(70.4)
    assert df.select(F.percentile("v", 0.9)).first()[0] == pytest.approx(44.8)
    assert evaluation.exclusive_quantile(df.limit(1), "v", 0.9).first().q == 1.0
    assert evaluation.exclusive_quantile(df.limit(0), "v", 0.9).first().q is None


def test_variance_read_from_the_search(spark):
    c, a, b = planted(spark, frames=5, n=60, outliers=0.2, noise=0.6, seed=4)
    f = pose.consensus(c)
    want = {r.frame_id: r.variance_m2 for r in pose.center_variance(pose.inliers_of(c, f), f, 255.5, 200.0).collect()}
    got = {r.frame_id: r.v for r in f.select("frame_id", pose.read_variance(255.5, 200.0).alias("v")).collect()}
    assert got == pytest.approx(want)
    few = spark.createDataFrame([(0, 0, 1.0, 1.0, 2.0, 2.0)], SCHEMA)
    r = pose.consensus(few).first()
    assert (r.n_points, r.n_inliers, r.a) == (1, None, None)
