"""Requests, orchestration, set operations, ordering and the remaining idioms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import camera as cam
from ..functions import geo, request
from ..operators import evaluation, pose, retrieval, sequence
from . import localize as loc
from .adapters import CELLS, EVAL, FRAMES, cells, correspondences, eval_rows, frames, haversine_sql, read
from .pose_queries import _FITTED, _OUT, outcomes
from .registry import d6, query, r6
from .retrieval_queries import _SIM, MPP0, mpp_sql


@query(f"""WITH r AS (SELECT o_orderkey AS id, 4000 AS width, CASE WHEN o_orderkey % 3 = 0 THEN 0.01e0 * (o_orderkey % 20) END AS gsd, CASE WHEN o_orderkey % 4 <> 0 THEN 100.0e0 + o_custkey % 300 END AS alt, CASE WHEN o_orderkey % 5 = 1 THEN 73.0e0 END AS fov,
  CASE WHEN o_orderkey % 5 = 2 THEN 8.8e0 END AS fmm, CASE WHEN o_orderkey % 10 <> 2 THEN 13.2e0 END AS smm, CASE WHEN o_custkey % 3 <> 0 THEN 50.0e0 END AS lat, 10.0e0 AS lon, CASE WHEN o_custkey % 7 <> 0 THEN (o_custkey % 11) * 100.0e0 END AS sigma,
  CASE WHEN o_orderkey % 2 = 0 THEN 45.0e0 END AS yaw, CASE WHEN o_custkey % 2 = 0 THEN 0.05e0 END AS xg, 300.0e0 AS xa, CASE WHEN o_custkey % 2 = 0 THEN 51.0e0 END AS xlat, (o_orderkey % 25)::DOUBLE AS xp, o_custkey % 4 = 0 AS fx FROM orders),
f AS (SELECT *, coalesce(fmm * width / smm, width / 2.0e0 / tan(radians(fov) / 2)) AS focal, fov IS NOT NULL OR fmm IS NOT NULL AS lens FROM r),
s AS (SELECT *, CASE WHEN gsd IS NOT NULL THEN 'given' WHEN alt IS NOT NULL AND lens THEN 'altitude and lens' WHEN xg IS NOT NULL THEN 'metadata' END AS src, CASE WHEN gsd IS NOT NULL THEN gsd WHEN alt IS NOT NULL AND lens THEN alt / focal WHEN xg IS NOT NULL THEN xg END AS used,
  CASE WHEN lat IS NOT NULL THEN 'given' WHEN fx AND xlat IS NOT NULL THEN 'metadata, no independent check' END AS pr FROM f),
n AS (SELECT *, array_to_string(list_filter([CASE WHEN gsd IS NOT NULL AND alt IS NULL THEN 'altitude assumed' END, CASE WHEN gsd IS NOT NULL AND lens THEN 'scale outranks the lens' END, CASE WHEN src = 'metadata' AND abs(xp) > 10 THEN 'tilted' END,
  CASE WHEN lat IS NOT NULL AND xlat IS NOT NULL AND NOT fx THEN 'metadata position not used' END, CASE WHEN lat IS NULL AND fx AND xlat IS NOT NULL THEN 'prior from the frame itself' END, CASE WHEN yaw IS NULL THEN 'heading unknown' END], lambda x: x IS NOT NULL), '; ') AS notes,
  array_to_string(list_filter([CASE WHEN gsd <= 0 THEN 'scale not positive' END, CASE WHEN gsd IS NULL AND alt IS NOT NULL AND lens AND focal IS NULL THEN 'lens incomplete' END, CASE WHEN src IS NULL THEN 'no scale' END, CASE WHEN pr IS NULL THEN 'no prior' END,
  CASE WHEN sigma IS NULL THEN 'no sigma' END, CASE WHEN sigma <= 0 THEN 'sigma not positive' END], lambda x: x IS NOT NULL), '; ') AS problems FROM s)
SELECT id, src AS gsd_source, pr AS prior_source, {d6("CASE WHEN problems = '' THEN used END")} AS gsd, notes, problems FROM n""")
def request_builder(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    none = F.lit(None).cast("double")
    r = read(spark, sf_dir, "orders").select(
        k.alias("id"), F.lit(4000).alias("width"), F.when(k % 3 == 0, 0.01 * (k % 20)).alias("gsd_m"), F.when(k % 4 != 0, 100.0 + c % 300).alias("altitude_m"), F.when(k % 5 == 1, 73.0).alias("fov_deg"), F.when(k % 5 == 2, 8.8).alias("focal_mm"),
        F.when(k % 10 != 2, 13.2).alias("sensor_mm"), F.when(c % 3 != 0, 50.0).alias("lat"), F.lit(10.0).alias("lon"), F.when(c % 7 != 0, (c % 11) * 100.0).alias("sigma_m"), F.when(k % 2 == 0, 45.0).alias("yaw_deg"), F.when(c % 2 == 0, 0.05).alias("exif_gsd_m"),
        F.lit(300.0).alias("exif_altitude_m"), F.when(c % 2 == 0, 51.0).alias("exif_lat"), F.lit(10.0).alias("exif_lon"), none.alias("exif_yaw_deg"), (k % 25).cast("double").alias("exif_pitch_deg"), (c % 4 == 0).alias("from_exif"),
    )
    b = request.build_request(r)
    return b.select("id", "gsd_source", "prior_source", r6(F.col("gsd_m_used")).alias("gsd"), F.array_join("notes", "; ").alias("notes"), F.array_join("problems", "; ").alias("problems"))


@query(f"""WITH {CELLS}, c AS (SELECT cell_id, CASE WHEN cell_id % 9 <> 0 THEN lat END AS lat, lon, cell_id % 2 = 0 AS trust, CASE WHEN cell_id % 3 <> 0 THEN lat + 0.0001e0 * (cell_id % 40) END AS plat FROM cells),
d AS (SELECT *, {haversine_sql('lat', 'lon', 'plat', 'lon')} AS drift FROM c)
SELECT cell_id, CASE WHEN lat IS NULL THEN NULL WHEN trust THEN 'exif' WHEN drift <= 150 THEN 'pose' END AS source, {d6("CASE WHEN lat IS NULL THEN NULL WHEN trust THEN 0 WHEN drift <= 150 THEN drift END", 3)} AS drift_m FROM d""")
def oracle_alignment(spark, sf_dir):
    k = F.col("cell_id")
    c = cells(spark, sf_dir).select("cell_id", F.when(k % 9 != 0, F.col("lat")).alias("lat"), "lon", (k % 2 == 0).alias("trust"), F.when(k % 3 != 0, F.col("lat") + 0.0001 * (k % 40)).alias("plat"))
    a = request.alignment(true_lat="lat", true_lon="lon", trust_yaw="trust", yaw_deg=F.lit(1.0), pose_lat="plat", pose_lon="lon", pose_yaw=F.lit(2.0))
    return c.select("cell_id", a["source"].alias("source"), r6(a["drift_m"], 3).alias("drift_m"))


@query(f"""WITH r AS (SELECT c_custkey, 30.0e0 + c_nationkey AS lat, 0.02e0 + (c_custkey % 40) / 100.0e0 AS gsd, 100.0e0 + c_custkey % 400 AS fp, 250.0e0 * (c_custkey % 8 + 1) AS sigma FROM customer),
h AS (SELECT *, 0.5e0 * fp + 3.0e0 * sigma AS half, greatest(0, least(19, round_even(log2({MPP0} * cos(radians(lat)) / gsd), 0)))::INT AS z_fine FROM r),
z AS (SELECT *, least(z_fine, greatest(0, least(19, floor(log2({MPP0} * cos(radians(lat)) / (2 * half / 2048)) + 1e-6))))::INT AS z_coarse FROM h)
SELECT c_custkey, z_fine::BIGINT AS z_fine, z_coarse::BIGINT AS z_coarse, (ceil(2 * half / {mpp_sql('lat', 'z_coarse')} / 2) * 2)::BIGINT AS coarse_size FROM z""")
def plan_coarse_window(spark, sf_dir):
    k = F.col("c_custkey")
    r = read(spark, sf_dir, "customer").select("c_custkey", (30.0 + F.col("c_nationkey")).alias("lat"), (0.02 + (k % 40) / 100.0).alias("gsd_m"), (100.0 + k % 400).alias("footprint_m"), (250.0 * (k % 8 + 1)).alias("sigma_m"))
    return loc.plan_scales(r).select("c_custkey", *(F.col(c).cast("bigint").alias(c) for c in ("z_fine", "z_coarse", "coarse_size")))


@query(f"""WITH {_FITTED} SELECT frame_id, {d6('0.3e0 * (cos(radians(20)) * (a * 256 - b * 256 + tx - 256) - sin(radians(20)) * (b * 256 + a * 256 + ty - 256))', 4)} AS east, {d6('-0.3e0 * (sin(radians(20)) * (a * 256 - b * 256 + tx - 256) + cos(radians(20)) * (b * 256 + a * 256 + ty - 256))', 4)} AS north,
  {d6('degrees(atan2(b, a))')} AS turn, {d6('sqrt(a * a + b * b)')} AS scale FROM fit""")
def sequence_vo_step(spark, sf_dir):
    f = pose.fit_similarity(correspondences(spark, sf_dir))
    v = sequence.vo_step(a="a", b="b", tx="tx", ty="ty", cx=256.0, cy=256.0, gsd_m=0.3, prev_heading_deg=20.0)
    return f.select("frame_id", r6(v["delta_east_m"], 4).alias("east"), r6(v["delta_north_m"], 4).alias("north"), r6(v["delta_yaw_deg"]).alias("turn"), r6(v["scale"]).alias("scale"))


@query(f"""WITH m AS (SELECT l_suppkey AS frame_id, CASE WHEN l_discount > 0.01 THEN l_discount * 8 + 0.0 END AS conf FROM lineitem)
SELECT frame_id, COUNT(conf) AS n_matches, {d6('quantile_cont(conf, 0.1)')} AS conf_p10, {d6('quantile_cont(conf, 0.5)')} AS conf_p50, {d6('quantile_cont(conf, 0.9)')} AS conf_p90, {d6('quantile_cont(conf, 0.99)')} AS conf_p99, {d6('MAX(conf)')} AS conf_max,
  {d6('AVG((conf > 0.1)::INT)')} AS conf_frac_gt010, {d6('AVG((conf > 0.5)::INT)')} AS conf_frac_gt050 FROM m GROUP BY frame_id""")
def match_evidence(spark, sf_dir):
    m = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("frame_id"), F.when(F.col("l_discount") > 0.01, F.col("l_discount") * 8 + 0.0).alias("conf"))
    e = request.evidence(m, "frame_id")
    return e.select("frame_id", "n_matches", *(r6(F.col(c)).alias(c) for c in e.columns[2:]))


@query(f"WITH {_OUT} SELECT \"case\", n_inliers::BIGINT AS n_inliers, outcome FROM o WHERE outcome IN ('accepted_wrong', 'pose_wrong_gated') ORDER BY n_inliers DESC, \"case\" LIMIT 12")
def top_wrong_poses(spark, sf_dir):
    return evaluation.top_wrong(outcomes(spark, sf_dir)).select("case", F.col("n_inliers").cast("bigint").alias("n_inliers"), "outcome")


@query('WITH t AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n, COUNT(*) OVER (PARTITION BY c_mktsegment) AS total FROM customer) SELECT c_mktsegment AS dataset, c_custkey FROM t WHERE (n - 1) % greatest(1, total // 50) = 0')
def thin_samples(spark, sf_dir):
    return evaluation.thinned(read(spark, sf_dir, "customer").selectExpr("c_mktsegment dataset", "c_custkey"), "dataset", "c_custkey")


@query("""WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0)
SELECT 'union' AS op, COUNT(*) AS n, SUM(k)::BIGINT AS s FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', COUNT(*), SUM(k)::BIGINT FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'missing', COUNT(*), SUM(k)::BIGINT FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'new', COUNT(*), SUM(k)::BIGINT FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def case_set_operations(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    a, b = o.filter("k % 2 = 0"), o.filter("k % 3 = 0")
    parts = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("missing", a.exceptAll(b)), ("new", b.exceptAll(a))]
    done = [df.agg(F.lit(name).alias("op"), F.count("*").alias("n"), F.sum("k").alias("s")) for name, df in parts]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


@query(f"WITH {EVAL}, w AS (SELECT \"case\", regime, NTILE(4) OVER (PARTITION BY regime ORDER BY n_inliers, k)::BIGINT AS quartile, {d6('percent_rank() OVER (PARTITION BY regime ORDER BY n_inliers)')} AS pr, {d6('cume_dist() OVER (PARTITION BY regime ORDER BY n_inliers)')} AS cd, {d6('AVG(n_inliers) OVER (PARTITION BY regime ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS smooth FROM ev) SELECT * FROM w")
def eval_window_ranks(spark, sf_dir):
    e = eval_rows(spark, sf_dir)
    w = e.selectExpr(
        "`case`", "regime", "cast(ntile(4) over (partition by regime order by n_inliers, k) as bigint) quartile", "percent_rank() over (partition by regime order by n_inliers) pr", "cume_dist() over (partition by regime order by n_inliers) cd",
        "avg(n_inliers) over (partition by regime order by k rows between 2 preceding and 2 following) smooth",
    )
    return w.select("case", "regime", "quartile", *(r6(F.col(c)).alias(c) for c in ("pr", "cd", "smooth")))


@query(f"""WITH {_SIM}, d AS (SELECT frame_id, cell_id, rank, {haversine_sql('true_lat', 'true_lon', 'lat', 'lon')} AS m FROM ranked WHERE rank <= 20), l AS (SELECT *, CASE WHEN m <= 50 THEN 1 WHEN m >= 150 THEN 0 END AS label FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY frame_id, label ORDER BY rank) AS k FROM l WHERE label IS NOT NULL) SELECT frame_id, cell_id, label::BIGINT AS label FROM n WHERE label = 1 OR k <= 3""")
def calibration_hard_negatives(spark, sf_dir):
    f, c = frames(spark, sf_dir), cells(spark, sf_dir)
    j = retrieval.topk_join(f, c, 20).join(c.select("cell_id", "lat", "lon"), "cell_id").join(f.select("frame_id", "true_lat", "true_lon"), "frame_id")
    j = j.withColumn("distance_m", geo.haversine(lat1="true_lat", lon1="true_lon", lat2="lat", lon2="lon"))
    return loc.hard_negatives(j).select("frame_id", "cell_id", F.col("label").cast("bigint").alias("label"))


@query("WITH p AS (SELECT label, 54.7e0 + 0.002e0 * (vec_id // 25) AS lat, 55.9e0 + 0.003e0 * (vec_id % 25) AS lon FROM embeddings) SELECT label, round(AVG(lat), 6) AS lat, round(AVG(lon), 6) AS lon FROM p GROUP BY label")
def cluster_centroids(spark, sf_dir):
    return sequence.centroids(cells(spark, sf_dir), "label").select("label", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'not_localized  few correspondences' ELSE printf('localized  %.6f %.6f  heading %.0f', 40 + c_custkey % 9 / 8.0e0, 10 + c_custkey % 5 / 4.0e0, (c_custkey % 360)::DOUBLE) || CASE WHEN c_custkey % 2 = 0 THEN ', ellipse 1 x 1 m' ELSE '' END END AS line FROM customer""")
def report_summary_line(spark, sf_dir):
    k = F.col("c_custkey")
    found = k % 3 != 0
    c = read(spark, sf_dir, "customer").select(
        "c_custkey", F.when(found, "localized").otherwise("not_localized").alias("status"), F.when(found, 40 + k % 9 / 8.0).alias("lat"), F.when(found, 10 + k % 5 / 4.0).alias("lon"), (k % 360).cast("double").alias("heading_deg"),
        F.when(k % 2 == 0, "1 x 1 m").otherwise("-").alias("ellipse"), F.when(~found, "few correspondences").alias("reason"),
    )
    return c.select("c_custkey", request.summary_line().alias("line"))


def _flown(spark, sf_dir):
    """Frames with what a flight would know and, for the matcher, the truth: half of them fly higher than believed, half know their heading."""
    k = F.expr("frame_id div 23")
    f = frames(spark, sf_dir).withColumn("altitude_m", F.lit(600.0)).withColumn("altitude_sigma_m", F.lit(150.0)).withColumn("true_yaw_deg", (F.col("frame_id") * 17 % 360).cast("double"))
    f = f.withColumn("trust_yaw", k % 2 == 0).withColumn("yaw_deg", F.when(k % 2 == 0, F.col("true_yaw_deg"))).withColumn("true_altitude_m", F.when(k % 4 < 2, 600.0).otherwise(1000.0))
    return f, f.filter(k % 3 != 0).select("frame_id", "true_lat", "true_lon", "true_altitude_m", "true_yaw_deg")


@query(f"""WITH {FRAMES}, k AS (SELECT *, frame_id // 23 AS k, (frame_id // 23) % 3 <> 0 AS found FROM frames)
SELECT frame_id, CASE WHEN found THEN 'localized' ELSE 'not_localized' END AS status, CASE WHEN NOT found THEN 'no candidate converged: few correspondences' END AS reason, CASE WHEN found THEN frame_id END AS cell_id,
  CASE WHEN found THEN {d6('true_lat', 5)} END AS lat, CASE WHEN found THEN {d6('true_lon', 5)} END AS lon, CASE WHEN found THEN {d6('frame_id * 17 % 360', 3)} END AS heading_deg,
  CASE WHEN found THEN CASE WHEN k % 4 < 2 THEN 600.0e0 ELSE 1000.0e0 END END AS altitude_m, CASE WHEN found THEN CASE WHEN k % 4 < 2 THEN 19 ELSE 18 END END AS z_fine FROM k""")
def localize_pipeline(spark, sf_dir):
    """Frames through retrieval, windows, matches, the scale loop and gates to one result each, held against where they were planted; every third frame has no matches."""
    f, truth = _flown(spark, sf_dir)
    camera = {"width": 1000, "height": 800, "focal_px": 3000.0}
    r = loc.localize(f, cells(spark, sf_dir), loc.exact_matcher(truth, **camera), **camera)
    ok = F.col("status") != "not_localized"
    return r.select(
        "frame_id", "status", "reason", F.when(ok, F.col("cell_id")).alias("cell_id"), r6(F.col("lat"), 5).alias("lat"), r6(F.col("lon"), 5).alias("lon"), r6(F.pmod(F.round("heading_deg", 3), F.lit(360.0)), 3).alias("heading_deg"),
        r6(F.col("altitude_m"), 1).alias("altitude_m"), F.when(ok, F.col("z_fine")).alias("z_fine"),
    )


@query(f"""WITH {FRAMES} SELECT frame_id, CASE WHEN (frame_id // 23) % 3 <> 0 THEN {d6('true_lat', 5)} END AS lat, CASE WHEN (frame_id // 23) % 3 <> 0 THEN {d6('true_lon', 5)} END AS lon, CASE WHEN (frame_id // 23) % 3 = 0 THEN 'no coarse candidate' END AS reason FROM frames""")
def localize_coarse(spark, sf_dir):
    """Where frames are about, by matches with one wide window each; every third frame's matches are scattered."""
    f, _ = _flown(spark, sf_dir)
    r = f.select("frame_id", "true_lat", "true_lon", F.col("prior_lat").alias("lat"), F.col("prior_lon").alias("lon"), "sigma_m", "altitude_m", "altitude_sigma_m", F.lit(0.2).alias("gsd_m"), F.lit(200.0).alias("footprint_m"), F.lit(None).cast("double").alias("expected_deg"))
    r = loc.plan_scales(r)
    g = geo.Georef(F.col("lon"), F.col("lat"), F.col("z_coarse"), F.col("coarse_size"), F.col("coarse_size"))
    side = cam.resampled(size=F.lit(1000), gsd_m="gsd_m", target_mpp=geo.ground_mpp(lat="lat", zoom="z_coarse"))
    tx, ty = g.to_pixel(lon="true_lon", lat="true_lat")
    p = r.withColumn("cx", tx).withColumn("cy", ty).withColumn("side", side).withColumn("s", 0.2 * 1000 / F.col("side") / g.mpp).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(39).cast("bigint"))))
    p = p.withColumn("qx", F.expr("cast((i * 389 + 17) % side as double)")).withColumn("qy", F.expr("cast((i * 631 + 91) % side as double)"))
    good, c = F.expr("(frame_id div 23) % 3 <> 0"), (F.col("side") - 1) / 2
    rx = F.when(good, F.col("s") * (F.col("qx") - c) + F.col("cx")).otherwise(F.expr("cast((i * i * 3701 + i * 97) % 1999 as double)"))
    ry = F.when(good, F.col("s") * (F.col("qy") - c) + F.col("cy")).otherwise(F.expr("cast((i * i * 1009 + i * 331) % 1789 as double)"))
    out = loc.coarse_center(r.drop("true_lat", "true_lon"), p.select("frame_id", "i", "qx", "qy", rx.alias("rx"), ry.alias("ry")), width=1000, height=1000)
    return out.select("frame_id", r6(F.col("lat"), 5).alias("lat"), r6(F.col("lon"), 5).alias("lon"), "reason")


@query(f"""WITH {FRAMES}, a AS (SELECT frame_id, true_lat AS la, true_lon AS lo, d::DOUBLE AS d, b::DOUBLE AS b FROM frames, (VALUES (300), (600), (1200)) x(d), (VALUES (0), (90), (180), (270)) y(b))
SELECT frame_id AS "case", {d6('true_lat', 7)} AS lat, {d6('true_lon', 7)} AS lon, 0.0e0 AS distance_m, 0.0e0 AS bearing_deg, 1 AS label FROM frames
UNION ALL SELECT frame_id, {d6('la + d * cos(radians(b)) / 111320.0e0', 7)}, {d6('lo + d * sin(radians(b)) / (111320.0e0 * cos(radians(la)))', 7)}, d, b, 0 FROM a""")
def negatives_by_distance_and_bearing(spark, sf_dir):
    c = frames(spark, sf_dir).select(F.col("frame_id").alias("case"), F.col("true_lat").alias("lat"), F.col("true_lon").alias("lon"))
    return loc.negatives_around(c).withColumn("lat", r6(F.col("lat"), 7)).withColumn("lon", r6(F.col("lon"), 7))


@query(f"""WITH {EVAL}, s AS (SELECT row_number() OVER (ORDER BY m.o, k.top_k, b.bar) - 1 AS run, m.kernel, k.top_k, b.bar FROM (VALUES (0, 'sparse'), (1, 'dense')) m(o, kernel), (VALUES (5), (15)) k(top_k), (VALUES (3.0e0), (5.0e0)) b(bar)),
r AS (SELECT s.*, n_inliers >= CASE WHEN kernel = 'dense' THEN 185 ELSE 8 END AND ellipse_m <= bar AND coalesce(true_cell_rank <= top_k, FALSE) AS localized, error_m FROM s, ev WHERE error_m IS NOT NULL)
SELECT run, kernel, top_k, bar, COUNT(*) AS n, COUNT(*) FILTER (localized) AS localized, {d6('COUNT(*) FILTER (localized) / COUNT(*)::DOUBLE')} AS share, {d6('quantile_cont(error_m, 0.5) FILTER (localized)')} AS median_error, COUNT(*) FILTER (localized AND error_m <= 50) AS correct
FROM r GROUP BY ALL""")
def sweep_of_settings(spark, sf_dir):
    """All evaluation rows under every combination of kernel, candidates and bar."""
    s = loc.sweep(spark, kernel=["sparse", "dense"], top_k=[5, 15], bar=[3.0, 5.0])
    e = eval_rows(spark, sf_dir).filter("error_m is not null").crossJoin(F.broadcast(s))
    ok = (F.col("n_inliers") >= cam.hard_inliers(F.col("kernel") == "dense")) & (F.col("ellipse_m") <= F.col("bar")) & F.coalesce(F.col("true_cell_rank") <= F.col("top_k"), F.lit(False))
    out = loc.sweep_summary(e.withColumn("localized", ok), ["run", "kernel", "top_k", "bar"])
    return out.withColumn("share", r6(F.col("share"))).withColumn("median_error", r6(F.col("median_error")))


@query("""WITH y AS (SELECT i, v FROM (VALUES (0, 0), (1, 45), (2, 137), (3, 225), (4, 315)) t(i, v)), r AS (SELECT i, v FROM (VALUES (0, 0.8e0), (1, 1.0e0), (2, 1.2e0)) t(i, v)), o AS (SELECT i, v FROM (VALUES (0, 0.0e0), (1, 20.0e0)) t(i, v))
SELECT (y.i * 6 + r.i * 2 + o.i)::BIGINT AS frame_id, TRUE AS localized, 0.0e0 AS center_error_m, 0.0e0 AS center_error_px, 0.0e0 AS heading_error_deg, 0.0e0 AS scale_error_pct FROM y, r, o""")
def testbench_grid(spark, sf_dir):
    """Errors of the synthetic acceptance grid, whose points are exact: none of them is off by a hundredth."""
    pairs, corr = loc.sample_grid(spark)
    r = loc.against_reference(pairs, corr, width=1024, height=1024, window_px=1280, focal_px=3000.0)
    return loc.sample_metrics(r, pairs).select("frame_id", "localized", *(r6(F.abs(F.col(c)), 2).alias(c) for c in ("center_error_m", "center_error_px", "heading_error_deg", "scale_error_pct")))

