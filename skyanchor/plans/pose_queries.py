"""Pose, quality, signal and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import camera as cam
from ..functions import geo
from ..operators import evaluation as ev
from ..operators import pose, report, signals
from .adapters import EVAL, correspondences, corr_sql, eval_rows, read
from .registry import d6, query, r6

_FIT = """m AS (SELECT frame_id, COUNT(*) AS n, AVG(qx) AS mqx, AVG(qy) AS mqy, AVG(rx) AS mrx, AVG(ry) AS mry, var_pop(qx) + var_pop(qy) AS vv,
  (covar_pop(qx, rx) + covar_pop(qy, ry)) AS ca, (covar_pop(qx, ry) - covar_pop(qy, rx)) AS cb FROM {src} GROUP BY frame_id),
fit AS (SELECT *, ca / vv AS a, cb / vv AS b, mrx - ca / vv * mqx + cb / vv * mqy AS tx, mry - cb / vv * mqx - ca / vv * mqy AS ty FROM m)"""
_FITTED = f"{corr_sql()}, {_FIT.format(src='corr')}"
_RES = "sqrt(pow(a * qx - b * qy + tx - rx, 2) + pow(b * qx + a * qy + ty - ry, 2))"
#: The points whose transform was planted without a fault: what a robust fit has to find, by no formula of its own.
_GOOD = f"""{corr_sql(True)}, p AS (SELECT *, sqrt(pow({1.1 * 0.8660254037844387!r}::DOUBLE * qx - {1.1 * 0.5!r}::DOUBLE * qy + 40 - rx, 2) + pow({1.1 * 0.5!r}::DOUBLE * qx + {1.1 * 0.8660254037844387!r}::DOUBLE * qy - 25 - ry, 2)) < 5 AS good FROM corr),
good AS (SELECT * FROM p WHERE good), {_FIT.format(src='good')}"""


@query(f"WITH {_FITTED} SELECT frame_id, n, {d6('a')} AS a, {d6('b')} AS b, {d6('tx', 4)} AS tx, {d6('ty', 4)} AS ty, {d6('sqrt(a * a + b * b)')} AS scale, {d6('degrees(atan2(b, a))')} AS rotation_deg FROM fit")
def pose_fit_similarity(spark, sf_dir):
    f = pose.fit_similarity(correspondences(spark, sf_dir))
    return f.select("frame_id", "n", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"), r6(F.col("tx"), 4).alias("tx"), r6(F.col("ty"), 4).alias("ty"), r6(pose.scale()).alias("scale"), r6(pose.rotation_deg()).alias("rotation_deg"))


@query(f"""WITH {_FITTED}, r AS (SELECT frame_id, {_RES} AS d FROM corr JOIN fit USING (frame_id))
SELECT frame_id, COUNT(*) AS n_points, COUNT(*) FILTER (d <= 0.5) AS n_inliers, {d6('AVG((d <= 0.5)::INT)')} AS inlier_ratio, {d6("coalesce(sqrt(AVG(d * d) FILTER (d <= 0.5)), 'inf'::DOUBLE)")} AS rmse_px FROM r GROUP BY frame_id""")
def pose_rmse_inliers(spark, sf_dir):
    c = correspondences(spark, sf_dir)
    r = pose.rmse_inliers(c, pose.fit_similarity(c), 0.5)
    return r.select("frame_id", "n_points", "n_inliers", r6(F.col("inlier_ratio")).alias("inlier_ratio"), r6(F.col("rmse_px")).alias("rmse_px"))


@query(f"""WITH {_GOOD} SELECT frame_id, COUNT(*) AS n_points, COUNT(*) FILTER (good) AS n_inliers, {d6('ANY_VALUE(a)')} AS a, {d6('ANY_VALUE(b)')} AS b, {d6('ANY_VALUE(tx)', 4)} AS tx, {d6('ANY_VALUE(ty)', 4)} AS ty,
  {d6(f'sqrt(AVG(pow({_RES}, 2)) FILTER (good))')} AS rmse_px FROM p JOIN fit USING (frame_id) GROUP BY frame_id HAVING COUNT(*) FILTER (good) >= 10""")
def pose_ransac_deterministic(spark, sf_dir):
    """RANSAC over points of which a quarter are shifted alike: it has to find those that aren't, and the least-squares fit to them."""
    r = pose.ransac(correspondences(spark, sf_dir, outliers=True))
    return r.select("frame_id", "n_points", "n_inliers", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"), r6(F.col("tx"), 4).alias("tx"), r6(F.col("ty"), 4).alias("ty"), r6(F.col("rmse_px")).alias("rmse_px"))


@query(f"""WITH {_GOOD} SELECT frame_id, COUNT(*) FILTER (good) AS n_inliers, {d6(f'SUM(least(pow({_RES}, 2), 144.0e0))', 3)} AS loss, {d6('ANY_VALUE(a)')} AS a, {d6('ANY_VALUE(b)')} AS b FROM p JOIN fit USING (frame_id) GROUP BY frame_id""")
def pose_msac_score(spark, sf_dir):
    m = pose.msac(correspondences(spark, sf_dir, outliers=True))
    return m.select("frame_id", "n_inliers", r6(F.col("loss"), 3).alias("loss"), r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"))


@query(f"""WITH {_FITTED}, j AS (SELECT c.*, a, b, tx, ty, 1 / (1 + pow({_RES}, 2)) AS w FROM corr c JOIN fit USING (frame_id)),
c0 AS (SELECT frame_id, SUM(w * qx) / SUM(w) AS wx, SUM(w * qy) / SUM(w) AS wy, SUM(w * rx) / SUM(w) AS wu, SUM(w * ry) / SUM(w) AS wv FROM j GROUP BY frame_id),
g AS (SELECT frame_id, SUM(w * (pow(qx - wx, 2) + pow(qy - wy, 2))) AS ss, SUM(w * ((qx - wx) * (rx - wu) + (qy - wy) * (ry - wv))) AS sa, SUM(w * ((qx - wx) * (ry - wv) - (qy - wy) * (rx - wu))) AS sb FROM j JOIN c0 USING (frame_id) GROUP BY frame_id)
SELECT frame_id, {d6('sa / ss')} AS a, {d6('sb / ss')} AS b FROM g""")
def pose_weighted_refit(spark, sf_dir):
    c = correspondences(spark, sf_dir)
    return pose.weighted_refit(c, pose.fit_similarity(c)).select("frame_id", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"))


_COV = f"""{_FITTED}, v AS (SELECT frame_id, ANY_VALUE(n) AS n, SUM(pow({_RES}, 2)) / (2 * ANY_VALUE(n) - 4) * (1 / ANY_VALUE(n)::DOUBLE + (pow(256 - ANY_VALUE(mqx), 2) + pow(256 - ANY_VALUE(mqy), 2)) / (ANY_VALUE(n) * ANY_VALUE(vv))) * 0.09e0 AS var
  FROM corr JOIN fit USING (frame_id) GROUP BY frame_id)"""


@query(f"WITH {_COV} SELECT frame_id, n, {d6('var')} AS variance_m2, {d6('sqrt(var)')} AS semi_major_m, {d6('sqrt(var)')} AS semi_minor_m FROM v WHERE n >= 3")
def pose_center_covariance(spark, sf_dir):
    c = correspondences(spark, sf_dir)
    v = pose.center_variance(c, pose.fit_similarity(c), 256.0, 256.0, 0.3).filter("variance_m2 is not null")
    major, minor, _ = pose.error_ellipse("variance_m2", F.lit(0.0), "variance_m2")
    return v.select("frame_id", "n", r6(F.col("variance_m2")).alias("variance_m2"), r6(major).alias("semi_major_m"), r6(minor).alias("semi_minor_m"))


@query(f"""WITH {corr_sql()}, s AS (SELECT x.frame_id, AVG(sqrt(pow(x.qx - y.qx, 2) + pow(x.qy - y.qy, 2))) / sqrt(2 * 512.0e0 * 512) AS s FROM corr x JOIN corr y ON x.frame_id = y.frame_id AND x.i < y.i GROUP BY x.frame_id)
SELECT f.frame_id, {d6('coalesce(s, 0)')} AS spread FROM (SELECT DISTINCT frame_id FROM corr) f LEFT JOIN s USING (frame_id)""")
def pose_inlier_spread(spark, sf_dir):
    return pose.inlier_spread(correspondences(spark, sf_dir), 512, 512).select("frame_id", r6(F.col("spread")).alias("spread"))


def _corner(x: str, y: str) -> tuple[str, str]:
    return f"(a * {x} - b * {y} + tx)", f"(b * {x} + a * {y} + ty)"


def _geo_sql(x: str, y: str) -> tuple[str, str]:
    from .retrieval_queries import lat_sql, lon_sql, wx_sql, wy_sql

    ox, oy = f"({wx_sql('37.6e0', '18')} - 300)", f"({wy_sql('55.7e0', '18')} - 300)"
    return lon_sql(f"({x} + {ox} + 0.5e0)", "18"), lat_sql(f"({y} + {oy} + 0.5e0)", "18")


_C = _geo_sql(*_corner("255.5e0", "255.5e0"))
_K = [_geo_sql(*_corner(x, y)) for x, y in (("0.0e0", "0.0e0"), ("511.0e0", "0.0e0"), ("511.0e0", "511.0e0"), ("0.0e0", "511.0e0"))]


@query(f"""WITH {_FITTED} SELECT frame_id, {d6(_C[0], 5)} AS lon, {d6(_C[1], 5)} AS lat, {d6('degrees(atan2(b, a)) - 360 * floor(degrees(atan2(b, a)) / 360)')} AS heading_deg,
  {d6(f"sqrt(a * a + b * b) * (2 * pi() * 6378137.0e0 / 256 * cos(radians(55.7e0)) / 262144) * 3000", 3)} AS altitude_m,
  {', '.join(f'{d6(x, 5)} AS lon{i}, {d6(y, 5)} AS lat{i}' for i, (x, y) in enumerate(_K))} FROM fit""")
def pose_readout_footprint(spark, sf_dir):
    f = pose.fit_similarity(correspondences(spark, sf_dir))
    g = geo.Georef(F.lit(37.6), F.lit(55.7), F.lit(18), F.lit(600), F.lit(600))
    lon, lat = g.to_lonlat(*pose.apply(F.lit(255.5), F.lit(255.5)))
    corners = [g.to_lonlat(*pose.apply(F.lit(x), F.lit(y))) for x, y in ((0.0, 0.0), (511.0, 0.0), (511.0, 511.0), (0.0, 511.0))]
    return f.select(
        "frame_id", r6(lon, 5).alias("lon"), r6(lat, 5).alias("lat"), r6(F.pmod(pose.rotation_deg(), F.lit(360.0))).alias("heading_deg"), r6(pose.scale() * g.mpp * 3000, 3).alias("altitude_m"),
        *(c for i, (x, y) in enumerate(corners) for c in (r6(x, 5).alias(f"lon{i}"), r6(y, 5).alias(f"lat{i}"))),
    )


@query(f"""WITH {_FITTED}, e AS (SELECT frame_id, a AS a0, b AS b0, a * (1 + (frame_id % 7) / 100.0e0) AS a00, -b + 0.01e0 AS a01, b + 0.01e0 + (frame_id % 5) / 50.0e0 AS a10, a AS a11, frame_id % 11 AS shift FROM fit),
p AS (SELECT *, (a00 + a11) / 2 AS a, (a10 - a01) / 2 AS b FROM e), s AS (SELECT *, sqrt(a * a + b * b) / sqrt(a0 * a0 + b0 * b0) AS r, degrees(atan2(b, a)) - degrees(atan2(b0, a0)) + 180 AS t FROM p)
SELECT frame_id, {d6('a')} AS a, {d6('b')} AS b, shift <= 8 AND greatest(r, 1 / r) <= 1.05 AND abs(t - 360 * floor(t / 360) - 180) <= 2 AS accepted FROM s""")
def pose_ecc_projection_gate(spark, sf_dir):
    f = pose.fit_similarity(correspondences(spark, sf_dir)).withColumnRenamed("a", "a0").withColumnRenamed("b", "b0")
    a, b = pose.ecc_projection(F.col("a0") * (1 + (F.col("frame_id") % 7) / 100.0), -F.col("b0") + 0.01, F.col("b0") + 0.01 + (F.col("frame_id") % 5) / 50.0, "a0")
    p = f.withColumn("a", a).withColumn("b", b)
    ok = pose.ecc_accepted(F.col("frame_id") % 11, pose.scale("a0", "b0"), pose.scale(), pose.rotation_deg("a0", "b0"), pose.rotation_deg())
    return p.select("frame_id", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"), ok.alias("accepted"))


@query()
def pose_bootstrap_scatter(spark, sf_dir):
    return pose.bootstrap_scatter(correspondences(spark, sf_dir), 256.0, 256.0)


_BAR = "CASE WHEN k % 3 = 0 THEN 185 ELSE 8 END"
_EL = "CASE WHEN k % 50 = 0 THEN 'nan'::DOUBLE ELSE ellipse_m END"
_S1, _S2, _S3 = ("ln(greatest(1e-6, least(1.0e0, {})))".format(x) for x in ("least(n_inliers / 30.0e0, 1.0e0)", "(k % 101) / 100.0e0", "greatest(0.0e0, photometric)"))


@query(f"""WITH {EVAL} SELECT "case", {d6(f'exp(({_S1} + {_S2} + CASE WHEN photometric IS NULL THEN 0 ELSE {_S3} END) / (2 + (photometric IS NOT NULL)::INT))')} AS confidence,
  CASE WHEN NOT isnan({_EL}) AND {_EL} <= 3 AND n_inliers >= {_BAR} AND (photometric IS NULL OR photometric >= 0.12) THEN 'localized' ELSE 'low_confidence' END AS status FROM ev""")
def quality_assess(spark, sf_dir):
    e = eval_rows(spark, sf_dir).withColumn("bar", cam.hard_inliers(F.col("k") % 3 == 0)).withColumn("el", F.when(F.col("k") % 50 == 0, float("nan")).otherwise(F.col("ellipse_m")))
    conf = ev.confidence(F.least(F.col("n_inliers") / 30.0, F.lit(1.0)), (F.col("k") % 101) / 100.0, F.when(F.col("photometric").isNotNull(), F.greatest(F.lit(0.0), F.col("photometric"))))
    ok = ev.passes_gate(ellipse_m="el", n_inliers="n_inliers", bar="bar", measure="photometric", threshold=F.lit(0.12))
    return e.select("case", r6(conf).alias("confidence"), F.when(ok, "localized").otherwise("low_confidence").alias("status"))


@query("""WITH c AS (SELECT vec_id // 15 AS frame_id, vec_id % 15 + 1 AS rank, (vec_id * 37 + label * 11) % 40 AS n_inliers, vec_id AS cell_id, 45.0e0 * (label % 8) AS rot FROM embeddings)
SELECT frame_id, cell_id, n_inliers, CASE WHEN frame_id % 2 = 0 THEN -30.0e0 ELSE -rot END + 0.0e0 AS prerotation_deg FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n_inliers DESC, rank) AS k FROM c WHERE n_inliers >= 6) WHERE k = 1""")
def candidate_winner(spark, sf_dir):
    from . import localize as loc

    c = read(spark, sf_dir, "embeddings").selectExpr("vec_id div 15 frame_id", "vec_id % 15 + 1 rank", "(vec_id * 37 + label * 11) % 40 n_inliers", "vec_id cell_id", "45D * (label % 8) rot", "'localized' status")
    best = loc.winners(c.filter("n_inliers >= 6")).withColumn("known", F.col("frame_id") % 2 == 0)
    return best.select("frame_id", "cell_id", "n_inliers", loc.prerotation(trust_yaw="known", yaw_deg=30.0, cell_rotation_deg="rot").alias("prerotation_deg"))


_PX = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), px AS (SELECT x.vec_id AS pair_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, x.e[i] AS a,
  CASE WHEN x.vec_id % 11 = 0 THEN 7.0e0 WHEN x.vec_id % 3 = 0 THEN -x.e[i] ELSE o.e[i] END AS b FROM v x JOIN v o ON o.vec_id = x.vec_id + 1, range(1, 65) t(i))"""


def _pixels(spark, sf_dir):
    """Each embedding as a raster of 8 x 8 beside the next one's, its own negative, or a flat one."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    j = e.join(o, "vec_id").select(F.col("vec_id").alias("pair_id"), F.posexplode(F.arrays_zip("embedding", "other")).alias("i", "p"))
    a, b = F.col("p.embedding").cast("double"), F.col("p.other").cast("double")
    b = F.when(F.col("pair_id") % 11 == 0, 7.0).when(F.col("pair_id") % 3 == 0, -a).otherwise(b)
    return j.select("pair_id", F.expr("cast(i div 8 as int)").alias("y"), (F.col("i") % 8).alias("x"), a.alias("a"), b.alias("b"))


@query(f"WITH {_PX} SELECT pair_id, COUNT(*) AS n, {d6('CASE WHEN var_pop(b) > 1e-12 THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) ELSE -1 END')} AS ncc FROM px GROUP BY pair_id")
def signal_ncc(spark, sf_dir):
    return signals.ncc(_pixels(spark, sf_dir), empty=-1.0).select("pair_id", "n", r6(F.col("ncc")).alias("ncc"))


@query(f"""WITH {_PX}, e AS (SELECT pair_id, MIN(a) AS la, MAX(a) AS ha, MIN(b) AS lb, MAX(b) AS hb FROM px GROUP BY pair_id),
j AS (SELECT pair_id, CASE WHEN ha > la THEN least(31, floor((a - la) / (ha - la) * 32)) ELSE 0 END AS i, CASE WHEN hb > lb THEN least(31, floor((b - lb) / (hb - lb) * 32)) ELSE 0 END AS k, COUNT(*) AS c FROM px JOIN e USING (pair_id) GROUP BY ALL),
ja AS (SELECT pair_id, i, SUM(c) AS c FROM j GROUP BY ALL), jb AS (SELECT pair_id, k, SUM(c) AS c FROM j GROUP BY ALL),
h AS (SELECT pair_id, ln(SUM(c)) - SUM(c * ln(c)) / SUM(c) AS h FROM j GROUP BY pair_id), a AS (SELECT pair_id, ln(SUM(c)) - SUM(c * ln(c)) / SUM(c) AS h FROM ja GROUP BY pair_id), b AS (SELECT pair_id, ln(SUM(c)) - SUM(c * ln(c)) / SUM(c) AS h FROM jb GROUP BY pair_id)
SELECT pair_id, {d6('CASE WHEN h.h <= 1e-12 THEN 2 ELSE (a.h + b.h) / h.h END')} AS nmi FROM h JOIN a USING (pair_id) JOIN b USING (pair_id)""")
def signal_nmi(spark, sf_dir):
    return signals.nmi(_pixels(spark, sf_dir)).select("pair_id", r6(F.col("nmi")).alias("nmi"))


@query()
def signal_gradients(spark, sf_dir):
    """Gradient correlation, gradient fields, oriented features and edge overlap of raster pairs."""
    # four pixels a side for each of the raster's, so that there are gradients to see, and 0 to 255 as a picture has
    big = F.expr("sequence(0, 1023)")
    rows = _pixels(spark, sf_dir).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct((F.col("y") * 8 + F.col("x")).alias("i"), "a", "b"))).alias("p"))
    grey = lambda c: F.transform(big, lambda k: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("p")[F.expr("0") + (F.floor(k / 128) * 8 + F.floor((k % 32) / 4)).cast("int")][c] * 300 + 128)))
    side = F.lit(32)
    return signals.gradient_signals(rows.select("pair_id", side.alias("height"), side.alias("width"), grey("a").alias("a"), grey("b").alias("b")))


@query(f"""WITH s AS (SELECT event_type, round(value, 0) AS v, (user_id % 3 = 0)::INT AS y FROM events), r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY v) + (COUNT(*) OVER (PARTITION BY event_type, v) - 1) / 2.0e0 AS r FROM s)
SELECT event_type AS regime, {d6('(SUM(r) FILTER (y = 1) - COUNT(*) FILTER (y = 1) * (COUNT(*) FILTER (y = 1) + 1) / 2.0e0) / (COUNT(*) FILTER (y = 1) * COUNT(*) FILTER (y = 0))')} AS auc FROM r GROUP BY event_type""")
def signal_auc_by_regime(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("regime"), F.round("value", 0).alias("v"), (F.col("user_id") % 3 == 0).cast("int").alias("y"))
    return ev.auc(e, "v", "y", "regime").select("regime", r6(F.col("auc")).alias("auc"))


@query(f"""WITH s AS (SELECT user_id, first(value ORDER BY event_id) FILTER (event_type = 'purchase') AS p, MAX(value) FILTER (event_type = 'error') AS n FROM events GROUP BY user_id), m AS (SELECT p - n AS m FROM s WHERE p IS NOT NULL AND n IS NOT NULL)
SELECT COUNT(*) FILTER (m > 0) AS wins, COUNT(*) AS total, {d6('quantile_cont(m, 0.5)')} AS median_margin FROM m""")
def signal_within_case(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    s = e.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.struct("event_id", "value")))["value"].alias("p"), F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("n"))
    return ev.within_case(s.withColumnsRenamed({"p": "right", "n": "wrong"})).withColumn("median_margin", r6(F.col("median_margin")))


_TOL = "CASE WHEN truth_source = 'manual' THEN greatest(50.0e0, 0.25e0 * footprint_m) ELSE 50.0e0 END"
_OUT = f"""{EVAL}, g AS (SELECT *, {_TOL} AS tol, {_BAR} AS bar FROM ev),
f AS (SELECT *, CASE WHEN error_m IS NULL THEN NULL ELSE (error_m <= tol)::INT END AS correct,
  array_to_string(list_filter([CASE WHEN n_inliers < bar THEN 'inliers' END, CASE WHEN photometric < 0.12 THEN 'measure' END, CASE WHEN ellipse_m > 3 THEN 'ellipse' END], lambda x: x IS NOT NULL), ', ') AS gs FROM g),
b AS (SELECT *, CASE WHEN gs = '' THEN 'gate' ELSE gs END AS gate FROM f),
l AS (SELECT *, CASE WHEN status = 'not_localized' THEN CASE WHEN true_cell_rank > 15 THEN 'floor 1' WHEN true_cell_rank IS NOT NULL THEN 'floor 2' ELSE 'no pose' END
  WHEN accepted = 1 THEN CASE WHEN error_m IS NULL THEN 'accepted, no truth' WHEN correct = 1 THEN 'ok' ELSE 'FALSE' END
  WHEN error_m IS NULL THEN 'pose held: ' || gate WHEN correct = 1 THEN 'gate held a CORRECT one: ' || gate ELSE 'gate held a wrong one: ' || gate END AS blame FROM b),
o AS (SELECT *, CASE WHEN status = 'not_localized' THEN CASE WHEN blame = 'floor 1' THEN 'refused_floor1' WHEN blame = 'floor 2' THEN 'refused_floor2' ELSE 'refused' END
  WHEN correct IS NULL THEN CASE WHEN accepted = 1 THEN 'accepted_unverified' ELSE 'pose_gated_unverified' END
  WHEN accepted = 1 THEN CASE WHEN correct = 1 THEN 'accepted_correct' ELSE 'accepted_wrong' END WHEN correct = 1 THEN 'pose_correct_gated' ELSE 'pose_wrong_gated' END AS outcome FROM l)"""
_RANK = "CASE outcome WHEN 'accepted_wrong' THEN -20 WHEN 'error' THEN -10 WHEN 'pose_correct_gated' THEN 1 WHEN 'pose_gated_unverified' THEN 1 WHEN 'accepted_unverified' THEN 2 WHEN 'accepted_correct' THEN 3 ELSE 0 END"


def outcomes(spark, sf_dir):
    e = eval_rows(spark, sf_dir).withColumn("tol", ev.tolerance()).withColumn("bar", F.when(F.col("k") % 3 == 0, 185).otherwise(8))
    e = e.withColumn("correct", F.when(F.col("error_m").isNotNull(), (F.col("error_m") <= F.col("tol")).cast("int")))
    e = e.withColumn("gate", ev.failed_gate(n_inliers="n_inliers", bar="bar", measure="photometric", threshold=F.lit(0.12), ellipse_m="ellipse_m"))
    e = e.withColumn("blame", ev.blame(tolerance_m="tol", gate=F.col("gate")))
    return e.withColumn("outcome", ev.outcome())


@query(f"WITH {_OUT} SELECT \"case\", {d6('tol')} AS tolerance_m, blame, outcome, ({_RANK})::BIGINT AS rank FROM o")
def eval_outcome_class(spark, sf_dir):
    return outcomes(spark, sf_dir).select("case", r6(F.col("tol")).alias("tolerance_m"), "blame", "outcome", ev.outcome_rank("outcome").cast("bigint").alias("rank"))


@query(f"WITH {_OUT} SELECT outcome, COUNT(*) AS n FROM o GROUP BY outcome")
def eval_outcome_histogram(spark, sf_dir):
    return ev.outcome_histogram(outcomes(spark, sf_dir))


@query(f"""WITH {_OUT}, s AS (SELECT regime, error_m, correct, row_number() OVER (PARTITION BY regime ORDER BY error_m) AS rn, COUNT(*) OVER (PARTITION BY regime) AS n FROM o WHERE correct = 1),
q AS (SELECT *, greatest(1, least(n - 1, floor(0.9e0 * (n + 1)))) AS j FROM s), x AS (SELECT regime, SUM(error_m * CASE WHEN n = 1 THEN 1 WHEN rn = j THEN 1 - (0.9e0 * (n + 1) - j) ELSE 0.9e0 * (n + 1) - j END) AS p90 FROM q WHERE n = 1 OR rn IN (j, j + 1) GROUP BY regime)
SELECT o.regime, COUNT(*) AS cases, COUNT(*) FILTER (status <> 'not_localized') AS poses, COUNT(*) FILTER (accepted = 1) AS accepted, COUNT(*) FILTER (correct = 1) AS correct, COUNT(*) FILTER (accepted = 1 AND correct = 0) AS false_accepted,
  COUNT(*) FILTER (accepted = 0 AND correct = 1) AS gate_missed, {d6('quantile_cont(error_m, 0.5) FILTER (correct = 1)')} AS median_m, {d6('quantile_cont(error_m, 0.9) FILTER (correct = 1)')} AS p90_inclusive_m, {d6('ANY_VALUE(p90)')} AS p90_exclusive_m,
  {d6('MAX(error_m) FILTER (correct = 1)')} AS max_m, COUNT(*) FILTER (blame LIKE 'floor 1%') AS floor1, COUNT(*) FILTER (blame LIKE 'floor 2%') AS floor2 FROM o LEFT JOIN x ON x.regime = o.regime GROUP BY o.regime""")
def eval_report_summary(spark, sf_dir):
    o = outcomes(spark, sf_dir)
    right = F.when(F.col("correct") == 1, F.col("error_m"))
    n = lambda c: F.count_if(F.expr(c))
    g = o.groupBy("regime").agg(
        F.count("*").alias("cases"), n("status <> 'not_localized'").alias("poses"), n("accepted = 1").alias("accepted"), n("correct = 1").alias("correct"), n("accepted = 1 and correct = 0").alias("false_accepted"),
        n("accepted = 0 and correct = 1").alias("gate_missed"), r6(F.percentile(right, 0.5)).alias("median_m"), r6(F.percentile(right, 0.9)).alias("p90_inclusive_m"), r6(F.max(right)).alias("max_m"),
        n("blame like 'floor 1%'").alias("floor1"), n("blame like 'floor 2%'").alias("floor2"),
    )
    q = ev.exclusive_quantile(o.filter("correct = 1"), "error_m", 0.9, ["regime"])
    return g.join(q, "regime", "left").withColumn("p90_exclusive_m", r6(F.col("q"))).drop("q")


@query(f"""WITH {EVAL}, b AS (SELECT regime, status, least(4, floor(coalesce(photometric, 0) * 5))::BIGINT AS bin, accepted FROM ev)
SELECT regime, status, bin, COUNT(*) AS n, {d6('AVG(accepted)')} AS accepted_share FROM b GROUP BY GROUPING SETS ((regime, status), (regime), (bin), ())""")
def eval_rollup_regime(spark, sf_dir):
    return ev.rollup(eval_rows(spark, sf_dir)).select("regime", "status", "bin", "n", r6(F.col("share")).alias("accepted_share"))


_GOLD = f"""{_OUT}, gold AS (SELECT CASE WHEN k % 11 = 0 THEN 'x' || k ELSE "case" END AS "case", CASE WHEN k % 13 = 0 THEN 'pose_correct_gated' ELSE outcome END AS was, CASE WHEN k % 3 = 0 THEN error_m * 2 + 11 WHEN k % 3 = 1 THEN error_m / 4 ELSE error_m END AS was_m FROM o)"""


@query(f"""WITH {_GOLD}, j AS (SELECT coalesce(o."case", g."case") AS "case", g.was, o.outcome AS now, g.was_m, o.error_m AS now_m FROM o FULL JOIN gold g ON g."case" = o."case"),
r AS (SELECT *, {_RANK.replace('outcome', 'was')} AS wr, {_RANK.replace('outcome', 'now')} AS nr, CASE WHEN was_m IS NULL OR now_m IS NULL OR was IN ('pose_wrong_gated', 'accepted_wrong') THEN '' WHEN now_m > greatest(was_m + 10, was_m * 1.5e0) THEN 'worse'
  WHEN now_m + 10 < was_m AND now_m * 1.5e0 < was_m THEN 'better' ELSE '' END AS d FROM j)
SELECT "case", was, now, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'missing' WHEN now = 'accepted_wrong' THEN 'regression' WHEN nr < wr THEN 'regression' WHEN nr > wr THEN 'improvement' WHEN d = 'better' THEN 'improvement' WHEN d = 'worse' THEN 'degraded' ELSE 'ok' END AS severity FROM r""")
def regression_compare(spark, sf_dir):
    o = outcomes(spark, sf_dir)
    m = F.when(F.col("k") % 3 == 0, F.col("error_m") * 2 + 11).when(F.col("k") % 3 == 1, F.col("error_m") / 4).otherwise(F.col("error_m"))
    name = F.when(F.col("k") % 11 == 0, F.concat(F.lit("x"), F.col("k").cast("string"))).otherwise(F.col("case"))
    gold = o.select(name.alias("case"), F.when(F.col("k") % 13 == 0, "pose_correct_gated").otherwise(F.col("outcome")).alias("outcome"), m.alias("error_m"))
    return ev.compare(o.select("case", "outcome", "error_m"), gold)


@query("""WITH w AS (SELECT * FROM (VALUES ('matcher', 'a'), ('top_k', '15'), ('overlap', NULL), ('encoder', 'x'), ('note', 'p')) t(key, value)), n AS (SELECT * FROM (VALUES ('matcher', 'b'), ('top_k', '15'), ('overlap', NULL), ('pca_dim', '1024'), ('note', 'q')) t(key, value))
SELECT coalesce(w.key, n.key) AS key, w.value AS was, n.value AS now FROM w FULL JOIN n ON w.key = n.key WHERE w.value IS DISTINCT FROM n.value AND coalesce(w.key, n.key) <> 'note'""")
def regression_config_diff(spark, sf_dir):
    was = spark.createDataFrame([("matcher", "a"), ("top_k", "15"), ("overlap", None), ("encoder", "x"), ("note", "p")], "key string, value string")
    now = spark.createDataFrame([("matcher", "b"), ("top_k", "15"), ("overlap", None), ("pca_dim", "1024"), ("note", "q")], "key string, value string")
    return ev.config_diff(was, now)


@query(f"""WITH {_OUT}, d AS (SELECT 'm' || k % 500 AS "case", k, outcome, error_m / 7 AS error_m, n_inliers, photometric / 3 AS photometric FROM o), lst AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY k DESC) AS n FROM d)
SELECT "case", outcome, round_even(error_m, 1) AS error_m, n_inliers::BIGINT AS n_inliers, round_even(photometric, 4) AS ncc FROM lst WHERE n = 1""")
def regression_freeze(spark, sf_dir):
    o = outcomes(spark, sf_dir).withColumn("case", F.concat(F.lit("m"), (F.col("k") % 500).cast("string"))).withColumn("error_m", F.col("error_m") / 7).withColumn("photometric", F.col("photometric") / 3)
    return ev.freeze(o, "k").withColumn("n_inliers", F.col("n_inliers").cast("bigint"))


@query(f"""SELECT l_returnflag AS grid, {d6('quantile_cont(l_quantity, 0.5) FILTER (l_discount < 0.08)')} AS median, {d6('quantile_cont(l_quantity, 0.9) FILTER (l_discount < 0.08)')} AS p90, MAX(l_quantity) FILTER (l_discount < 0.08) AS max, {d6('AVG((l_discount < 0.08)::INT)')} AS success FROM lineitem GROUP BY l_returnflag""")
def grid_summary(spark, sf_dir):
    g = ev.grid_summary(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", F.col("l_discount") < 0.08)
    return g.select("grid", r6(F.col("median")).alias("median"), r6(F.col("p90")).alias("p90"), "max", r6(F.col("success")).alias("success"))


@query("""WITH r AS (SELECT l_returnflag AS kind, l_linenumber AS strength, AVG((l_quantity + 4 * l_linenumber <= 45)::INT) AS rate FROM lineitem GROUP BY ALL)
SELECT kind, (MIN(strength) FILTER (rate < 0.75))::BIGINT AS breaks_at FROM r GROUP BY kind""")
def ladder_breakpoint(spark, sf_dir):
    b = ev.breakpoint(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", F.col("l_quantity") + 4 * F.col("l_linenumber") <= 45)
    return b.withColumn("breaks_at", F.col("breaks_at").cast("bigint"))


_REASON = "CASE k % 7 WHEN 0 THEN 'uniqueness 0.01' WHEN 1 THEN 'outside prior' WHEN 2 THEN 'no fine convergence' WHEN 3 THEN 'no candidates' WHEN 4 THEN 'few correspondences' WHEN 5 THEN 'odd' END"


@query(f"""WITH {EVAL}, r AS (SELECT *, coalesce({_REASON}, '') AS r, k % 2 = 0 AS yaw FROM ev), s AS (SELECT *, contains(r, 'no fine convergence') OR contains(r, 'few correspondences') AS stuck FROM r),
t AS (SELECT *, list_filter([CASE WHEN contains(r, 'uniqueness') THEN 'narrow the prior or fly higher' END, CASE WHEN contains(r, 'outside prior') THEN 'widen sigma or correct the prior' END, CASE WHEN stuck THEN 'check the ground sampling distance' END,
  CASE WHEN stuck AND NOT yaw THEN 'give the heading' END, CASE WHEN stuck THEN 'mind the season of the imagery' END, CASE WHEN contains(r, 'no candidates') THEN 'widen the map''s radius' END, CASE WHEN contains(r, 'no imagery') THEN 'no imagery at this place' END,
  CASE WHEN status = 'low_confidence' THEN 'look at the overlay' END], lambda x: x IS NOT NULL) AS tips FROM s)
SELECT "case", CASE WHEN status = 'localized' THEN '' WHEN len(tips) > 0 THEN array_to_string(tips, '; ') ELSE 'reason: ' || CASE WHEN r = '' THEN 'none given' ELSE r END END AS advice,
  CASE WHEN status = 'localized' THEN printf('%.2f', ellipse_m + 1) || ' x ' || printf('%.2f', ellipse_m + 0.5) || ' m' ELSE '-' END AS ellipse FROM t""")
def report_advice(spark, sf_dir):
    e = eval_rows(spark, sf_dir).withColumn("reason", F.expr(_REASON)).withColumn("yaw", F.col("k") % 2 == 0).withColumn("minor", F.col("ellipse_m") + 0.5).withColumn("major", F.col("ellipse_m") + 1)
    return e.select("case", F.array_join(report.advice(trust_yaw="yaw"), "; ").alias("advice"), report.ellipse_words(semi_major_m="major", semi_minor_m="minor").alias("ellipse"))


@query(f"""WITH {EVAL}, c AS (SELECT k, 1.0e0 + k % 17 AS xx, 0.5e0 + k % 5 AS yy, ((k % 9) - 4) / 10.0e0 AS xy FROM ev), m AS (SELECT *, (xx + yy) / 2 AS m, sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS h FROM c)
SELECT k, {d6('sqrt(m + h)')} AS semi_major_m, {d6('sqrt(greatest(0, m - h))')} AS semi_minor_m, {d6('CASE WHEN xy = 0 THEN CASE WHEN xx >= yy THEN 0 ELSE -90 END ELSE degrees(atan((m + h - xx) / xy)) END')} AS angle_deg FROM m""")
def error_ellipse_axes(spark, sf_dir):
    """Ellipses of covariances that lean; the oracle takes the angle from the major axis' own direction."""
    e = eval_rows(spark, sf_dir).select("k", (F.lit(1.0) + F.col("k") % 17).alias("xx"), (F.lit(0.5) + F.col("k") % 5).alias("yy"), ((F.col("k") % 9 - 4) / 10.0).alias("xy"))
    major, minor, angle = pose.error_ellipse("xx", "xy", "yy")
    return e.select("k", r6(major).alias("semi_major_m"), r6(minor).alias("semi_minor_m"), r6(angle).alias("angle_deg"))
