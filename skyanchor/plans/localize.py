"""The whole of a localization as one plan: candidates, correspondences, transform, read-out, gates, winner.

Refusals are rows with a reason and no geometry, never missing rows.  The pose of
a pair of frame and cell is keyed by (frame_id, cell_id) packed into one struct
column named frame_id, so that the pose operators serve both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import camera as cam
from ..functions import geo
from ..operators import evaluation, pose, retrieval
from ..sources.shared import cut

MAX_RETRIES = 2
GATE_SIGMA = 3.0


def plan_scales(requests: DataFrame, gate_sigma: float = 3.0, coarse_target_px: int = 2048, max_zoom: int = 19) -> DataFrame:
    """requests (lat, gsd_m, footprint_m, sigma_m) with z_fine, z_coarse and coarse_size of the disk of gate_sigma sigmas."""
    half = 0.5 * F.col("footprint_m") + gate_sigma * F.col("sigma_m")
    r = requests.withColumn("z_fine", geo.zoom_for(mpp="gsd_m", lat="lat", max_zoom=max_zoom)).withColumn("half_m", half)
    r = r.withColumn("z_coarse", F.least("z_fine", geo.zoom_for(mpp=2 * F.col("half_m") / coarse_target_px, lat="lat", mode="coarser", max_zoom=max_zoom)))
    return r.withColumn("coarse_size", cam.even_ceil(2 * F.col("half_m") / geo.ground_mpp(lat="lat", zoom="z_coarse"))).drop("half_m")


def prerotation(*, trust_yaw, yaw_deg, cell_rotation_deg=0.0, wanted=True) -> Column:
    """How far to turn a frame before a matcher that doesn't take turns: back by a heading that is trusted, else by the turn of the cell that it matched; 0 where not wanted."""
    turn = F.when(F.coalesce(geo._c(trust_yaw), F.lit(False)), -geo._c(yaw_deg)).otherwise(-geo._c(cell_rotation_deg))
    return F.when(geo._c(wanted) if not isinstance(wanted, bool) else F.lit(wanted), turn).otherwise(0.0) + F.lit(0.0)


def resized(*, width, height, max_side: int | None, multiple: int = 8) -> dict[str, Column]:
    """Size and factor of an image whose longer side may have max_side pixels at most, and the size padded to a multiple; the factor is 1 or less."""
    w, h = geo._c(width), geo._c(height)
    f = F.lit(1.0) if max_side is None else F.least(F.lit(1.0), max_side / F.greatest(w, h))
    nw, nh = F.greatest(F.lit(1), F.bround(w * f).cast("int")), F.greatest(F.lit(1), F.bround(h * f).cast("int"))
    pad = lambda x: (F.ceil(x / multiple) * multiple).cast("int")
    return {"factor": f, "width": nw, "height": nh, "padded_width": pad(nw), "padded_height": pad(nh)}


def restored(corr: DataFrame, *, factor="factor") -> DataFrame:
    """Correspondences of a pair of images that were resized by one factor, in the pixels of the originals; those in the padding are dropped by their sizes.

    corr (…, qx, qy, rx, ry, factor) and, where known, width, height, ref_width and
    ref_height of the resized images.
    """
    f = geo._c(factor)
    if "width" in corr.columns:
        corr = corr.filter("qx < width and qy < height")
    if "ref_width" in corr.columns:
        corr = corr.filter("rx < ref_width and ry < ref_height")
    return corr.withColumns({c: (F.col(c) + 0.5) / f - 0.5 for c in ("qx", "qy", "rx", "ry")})


def match_points(corr: DataFrame, *, shared_scale=1.0, turn_deg=0.0, cx: float = 0.0, cy: float = 0.0) -> DataFrame:
    """Correspondences of resized and pre-turned frames with qx, qy brought back to the frame's own pixels."""
    t = F.radians(geo._c(turn_deg))
    x, y = F.col("qx") / shared_scale - cx, F.col("qy") / shared_scale - cy
    return corr.withColumns({"qx": F.cos(t) * x + F.sin(t) * y + cx, "qy": -F.sin(t) * x + F.cos(t) * y + cy})


def against_reference(
    pairs: DataFrame, corr: DataFrame, *, width: int, height: int, window_px: int | Column, focal_px: float, min_inliers: int = 10, bar: int | Column = 8, max_ellipse_m: float = 3.0,
    threshold_px: float = 3.0, rotation_tolerance_deg: float = 15.0, measure_kind: str | Column = "ncc",
) -> DataFrame:
    """One row for each of pairs (frame_id, ref_lat, ref_lon, zoom, prior_lat, prior_lon, sigma_m, altitude_m, altitude_sigma_m).

    corr (frame_id, i, qx, qy, rx, ry) has reference points in pixels of the
    window of window_px about (ref_lon, ref_lat).  Steps: enough points, a
    transform within the altitude's scale bounds that turns as expected_deg says
    (a column of pairs, null for any turn), the centre inside the prior, then the
    quality gate, which tells localized from low_confidence.  Pairs may bring
    measure, how well their rasters agree by measure_kind; its threshold is part of the gate.
    """
    for name in ("expected_deg", "measure"):
        if name not in pairs.columns:
            pairs = pairs.withColumn(name, F.lit(None).cast("double"))
    cx, cy = (width - 1) / 2, (height - 1) / 2
    j = pairs.join(pose.consensus(corr, threshold_px, min_inliers).withColumn("variance_m2", pose.read_variance(cx, cy)), "frame_id", "left")
    size = F.lit(window_px) if isinstance(window_px, int) else window_px
    g = geo.Georef(F.col("ref_lon"), F.col("ref_lat"), F.col("zoom"), size, size)
    j = j.withColumn("mpp", g.mpp).withColumn("scale", pose.scale()).withColumn("semi_major_m", F.sqrt("variance_m2") * F.col("mpp"))
    lo, hi = cam.scale_bounds(altitude_m="altitude_m", altitude_sigma_m="altitude_sigma_m")
    expected = F.col("altitude_m") / focal_px / F.col("mpp")
    lon, lat = g.to_lonlat(*pose.apply(F.lit(cx), F.lit(cy)))
    corners = [g.to_lonlat(*pose.apply(F.lit(x), F.lit(y))) for x, y in ((0.0, 0.0), (width - 1.0, 0.0), (width - 1.0, height - 1.0), (0.0, height - 1.0))]
    j = j.withColumn("found_lon", lon).withColumn("found_lat", lat)
    off = geo.haversine(lat1="prior_lat", lon1="prior_lon", lat2="found_lat", lon2="found_lon")
    reason = (
        F.when(F.coalesce(F.col("n_points"), F.lit(0)) < 3, "few correspondences").when(F.col("a").isNull(), "no model")
        .when(~F.col("scale").between(expected * lo, expected * hi), "scale out of bounds").when(~pose.within_rotation("expected_deg", rotation_tolerance_deg), "turned otherwise than expected")
        .when(off > GATE_SIGMA * F.col("sigma_m"), "outside prior")
    )
    j = j.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    kind = F.lit(measure_kind) if isinstance(measure_kind, str) else measure_kind
    least = F.element_at(F.create_map(*(F.lit(x) for kv in evaluation.THRESHOLDS.items() for x in kv)), kind)
    bar = F.lit(bar) if isinstance(bar, int) else bar
    passed = evaluation.passes_gate(ellipse_m="semi_major_m", n_inliers="n_inliers", bar=bar, measure="measure", threshold=least, max_ellipse_m=max_ellipse_m)
    keep = lambda c: F.when(ok, c)
    conf = evaluation.confidence(F.least(F.col("n_inliers") / 30.0, F.lit(1.0)), F.col("n_inliers") / F.col("n_points"), F.when(F.col("measure").isNotNull(), F.greatest(F.lit(0.0), F.col("measure"))))
    return j.select(
        "frame_id", F.when(ok & passed, "localized").when(ok, "low_confidence").otherwise("not_localized").alias("status"), "reason", keep(F.col("found_lat")).alias("lat"), keep(F.col("found_lon")).alias("lon"),
        keep(F.pmod(pose.rotation_deg(), F.lit(360.0))).alias("heading_deg"), keep(F.col("scale") * F.col("mpp") * focal_px).alias("altitude_m"), keep(F.col("scale")).alias("scale"), F.col("n_inliers"),
        keep(F.col("semi_major_m")).alias("semi_major_m"), keep(conf).alias("confidence"), keep(F.array(*(F.struct(x.alias("lon"), y.alias("lat")) for x, y in corners))).alias("ring"),
    )


def coarse_center(requests: DataFrame, corr: DataFrame, *, width: int, height: int, min_inliers: int = 6, rotation_tolerance_deg: float = 15.0) -> DataFrame:
    """(frame_id, lat, lon, coarse_mpp, reason): where a frame is about, by matches with the one wide window about its prior.

    requests are plan_scales()'s rows with frame_id, lat and lon of the prior,
    altitude_m, altitude_sigma_m and expected_deg.  corr has query points in pixels of
    the frame resized to the window's resolution, so that the scale is about 1.  Without
    a reason the candidate lies within the prior.
    """
    coarse_mpp = geo.ground_mpp(lat="lat", zoom="z_coarse")
    r = requests.withColumn("coarse_mpp", coarse_mpp)
    wq, hq = (cam.resampled(size=F.lit(v), gsd_m="gsd_m", target_mpp="coarse_mpp") for v in (width, height))
    fitted = pose.ransac(corr, min_inliers=min_inliers).select("frame_id", *pose.T)
    j = r.join(fitted, "frame_id", "left")
    lo, hi = cam.scale_bounds(altitude_m="altitude_m", altitude_sigma_m="altitude_sigma_m")
    g = geo.Georef(F.col("lon"), F.col("lat"), F.col("z_coarse"), F.col("coarse_size"), F.col("coarse_size"))
    lon, lat = g.to_lonlat(*pose.apply((wq - 1) / 2, (hq - 1) / 2))
    fits = F.col("a").isNotNull() & pose.scale().between(lo, hi) & pose.within_rotation("expected_deg", rotation_tolerance_deg)
    j = j.withColumn("found_lat", F.when(fits, lat)).withColumn("found_lon", F.when(fits, lon))
    off = geo.haversine(lat1="lat", lon1="lon", lat2="found_lat", lon2="found_lon")
    reason = F.when(F.col("found_lat").isNull(), "no coarse candidate").when(off > GATE_SIGMA * F.col("sigma_m"), "candidate outside prior")
    return j.select("frame_id", F.when(reason.isNull(), F.col("found_lat")).alias("lat"), F.when(reason.isNull(), F.col("found_lon")).alias("lon"), "coarse_mpp", reason.alias("reason"))


def fine_windows(candidates: DataFrame, *, width: int, height: int, focal_px: float, max_window_px: int = cam.MAX_WINDOW_PX) -> DataFrame:
    """candidates (…, lat, lon, coarse_mpp, altitude_m, z_fine) with margin_m and window_px, the even side of the window that holds the frame about them."""
    footprint = F.lit(float(max(width, height))) * F.col("altitude_m") / focal_px
    mpp = geo.ground_mpp(lat="lat", zoom="z_fine")
    c = candidates.withColumn("margin_m", cam.fine_margin(coarse_mpp="coarse_mpp", footprint_m=footprint, mpp=mpp, max_window_px=max_window_px))
    return c.withColumn("window_px", cam.even_ceil(2 * (0.5 * footprint + F.col("margin_m")) / mpp))


def fine_pass(candidates: DataFrame, match, *, width: int, height: int, focal_px: float, **how) -> DataFrame:
    """against_reference()'s rows for candidates (frame_id, cell_id, lat, lon, coarse_mpp, altitude_m, altitude_sigma_m, z_fine, expected_deg, …), with their frame_id, cell_id and z_fine.

    match(windows) gives the correspondences (frame_id, cell_id, i, qx, qy, rx, ry) of
    the windows of fine_windows(), in pixels of the frame and the window.  The margin
    of the window is the sigma that the result must keep to.
    """
    key = F.struct("frame_id", "cell_id")
    w = fine_windows(candidates, width=width, height=height, focal_px=focal_px)
    pairs = w.select(
        key.alias("frame_id"), F.col("lat").alias("ref_lat"), F.col("lon").alias("ref_lon"), F.col("z_fine").alias("zoom"), F.col("lat").alias("prior_lat"), F.col("lon").alias("prior_lon"), F.col("margin_m").alias("sigma_m"),
        "altitude_m", "altitude_sigma_m", "expected_deg", "window_px",
    )
    corr = match(w).select(key.alias("frame_id"), "i", "qx", "qy", "rx", "ry")
    done = against_reference(pairs, corr, width=width, height=height, window_px=F.col("window_px"), focal_px=focal_px, **how)
    flat = done.select("frame_id.frame_id", "frame_id.cell_id", *[c for c in done.columns if c != "frame_id"])
    return flat.join(candidates.select("frame_id", "cell_id", "z_fine"), ["frame_id", "cell_id"])


def fine_with_scale_loop(candidates: DataFrame, match, *, focal_px: float, scale_iters: int = MAX_RETRIES, max_zoom: int = 19, **how) -> DataFrame:
    """The best fine pass of each candidate: while the altitude that was found asks for a zoom not tried yet, and its pass has no fewer inliers, that one counts.

    With as many inliers the zoom of the altitude found is the better one: the window of
    the first zoom may happen to hold all points.
    """
    named = ["status", "reason", "lat", "lon", "heading_deg", "altitude_m", "scale", "n_inliers", "semi_major_m", "confidence", "ring", "z_fine"]
    best = cut(fine_pass(candidates, match, focal_px=focal_px, **how).withColumn("zooms", F.array("z_fine")).withColumn("open", F.lit(True)))
    key = ["frame_id", "cell_id"]
    for _ in range(scale_iters):
        asked = best.filter("open and status <> 'not_localized'").select(*key, F.col("altitude_m").alias("found_m"), "zooms")
        again = candidates.join(asked, key)
        zoom = geo.zoom_for(mpp=F.col("found_m") / focal_px, lat="lat", max_zoom=max_zoom)
        again = again.withColumn("z_fine", zoom).withColumn("altitude_m", F.col("found_m")).filter(~F.array_contains("zooms", F.col("z_fine"))).drop("found_m", "zooms")
        tried = fine_pass(again, match, focal_px=focal_px, **how)
        j = best.join(tried.select(*key, F.struct(*named).alias("new")), key, "left")
        gain = F.coalesce((F.col("new.status") != "not_localized") & (F.col("new.n_inliers") >= F.coalesce("n_inliers", F.lit(0))), F.lit(False))
        zooms = F.when(F.col("new").isNotNull(), F.array_union("zooms", F.array("new.z_fine"))).otherwise(F.col("zooms"))
        best = cut(j.select(*key, *(F.when(gain, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in named), zooms.alias("zooms"), gain.alias("open")))
    return best.drop("open").withColumn("scale_iters_done", F.size("zooms") - 1)


def winners(results: DataFrame) -> DataFrame:
    """The best candidate of each frame_id from rows (frame_id, rank, status, n_inliers, …): most inliers, then the earlier rank; refusals last."""
    w = "over (partition by frame_id order by status <> 'not_localized' desc, n_inliers desc nulls last, rank)"
    return results.selectExpr("*", f"row_number() {w} as __n").filter("__n = 1").drop("__n")


def retrieval_candidates(frames: DataFrame, cells: DataFrame, *, top_k: int = 5, min_uniqueness: float = 0.0, radius_m: float = 500.0, gate_sigma: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Candidates (frame_id, cell_id, rank, lat, lon, coarse_mpp, cell_rotation_deg) and (frame_id, reason) of the frames without any.

    The best cells within the prior are candidates, unless, with min_uniqueness, the
    best of them doesn't lead those farther than radius_m from it by so much.
    """
    near = cut(retrieval.topk_within(frames, cells, top_k, gate_sigma))
    clear = near
    if min_uniqueness > 0:
        lead = retrieval.uniqueness_within(frames, cells, radius_m, gate_sigma)
        clear = cut(near.join(lead.filter(retrieval.unique_enough("uniqueness", min_uniqueness)).select("frame_id"), "frame_id", "left_semi"))
    turn = F.col("rotation_deg") if "rotation_deg" in cells.columns else F.lit(0.0)
    at = cells.select("cell_id", "lat", "lon", (F.col("size_px") * geo.ground_mpp(lat="lat", zoom="zoom") / 12.0).alias("coarse_mpp"), turn.alias("cell_rotation_deg"))
    found = clear.join(at, "cell_id").select("frame_id", "cell_id", "rank", "lat", "lon", "coarse_mpp", "cell_rotation_deg")
    none = frames.select("frame_id", F.col("embedding").isNull().alias("void")).join(clear.select("frame_id").distinct(), "frame_id", "left_anti").join(near.select("frame_id", F.lit(True).alias("some")).distinct(), "frame_id", "left")
    reason = F.when(F.col("void"), "no candidates").when(F.col("some"), "not unique").otherwise("all cells outside prior")
    return found, none.select("frame_id", reason.alias("reason"))


def localize(
    frames: DataFrame, cells: DataFrame, match, *, width: int, height: int, focal_px: float, top_k: int = 5, min_uniqueness: float = 0.0, radius_m: float = 500.0, gate_sigma: float = GATE_SIGMA, scale_iters: int = MAX_RETRIES,
    max_zoom: int = 19, refine=None, **how,
) -> DataFrame:
    """One row a frame: the result of its best candidate, or a refusal with its reason and no geometry.

    frames (frame_id, embedding, prior_lat, prior_lon, sigma_m, altitude_m,
    altitude_sigma_m and, if known, yaw_deg, trust_yaw), cells (cell_id, lat, lon, zoom,
    size_px, rotation_deg, embedding).  Retrieval gives candidates inside the prior, the
    fine pass with its scale loop tries each, the most inliers win, refine(winners), if
    given, polishes them, and the prior gates the outcome once more.
    """
    for name, kind in (("yaw_deg", "double"), ("trust_yaw", "boolean")):
        if name not in frames.columns:
            frames = frames.withColumn(name, F.lit(None).cast(kind))
    found, none = retrieval_candidates(frames, cells, top_k=top_k, min_uniqueness=min_uniqueness, radius_m=radius_m, gate_sigma=gate_sigma)
    gsd = F.col("altitude_m") / focal_px
    known = frames.select("frame_id", "altitude_m", "altitude_sigma_m", "yaw_deg", "trust_yaw", geo.zoom_for(mpp=gsd, lat="prior_lat", max_zoom=max_zoom).alias("z_fine"), F.when(F.col("trust_yaw"), F.col("yaw_deg")).alias("expected_deg"))
    asked = found.join(known, "frame_id").withColumn("prerotation_deg", prerotation(trust_yaw="trust_yaw", yaw_deg="yaw_deg", cell_rotation_deg="cell_rotation_deg"))
    done = fine_with_scale_loop(asked, match, width=width, height=height, focal_px=focal_px, scale_iters=scale_iters, max_zoom=max_zoom, **how)
    best = winners(done.join(found.select("frame_id", "cell_id", "rank"), ["frame_id", "cell_id"]))
    if refine is not None:
        best = refine(best)
    out = frames.select("frame_id", F.col("prior_lat").alias("p_lat"), F.col("prior_lon").alias("p_lon"), F.col("sigma_m").alias("p_sigma")).join(best, "frame_id", "left").join(none.withColumnRenamed("reason", "refused"), "frame_id", "left")
    off = geo.haversine(lat1="p_lat", lon1="p_lon", lat2="lat", lon2="lon")
    placed = F.coalesce(F.col("status") != "not_localized", F.lit(False))
    outside = placed & (off > gate_sigma * F.col("p_sigma"))
    reason = F.when(F.col("status").isNull(), F.col("refused")).when(~placed, F.concat(F.lit("no candidate converged: "), F.coalesce("reason", F.lit("")))).when(outside, "outside prior")
    ok = placed & ~outside
    geometry = ("lat", "lon", "heading_deg", "altitude_m", "scale", "semi_major_m", "confidence", "ring")
    return out.select("frame_id", F.when(ok, F.col("status")).otherwise("not_localized").alias("status"), reason.alias("reason"), "cell_id", "rank", "n_inliers", "z_fine", *(F.when(ok, F.col(c)).alias(c) for c in geometry))


def sample_grid(spark, yaws=(0, 45, 137, 225, 315), ratios=(0.8, 1.0, 1.2), offsets=(0.0, 20.0), points: int = 120, mpp_zoom: int = 18, lat: float = 55.7558, lon: float = 37.6173, focal_px: float = 3000.0, size: int = 1024, window_px: int = 1280) -> tuple[DataFrame, DataFrame]:
    """Pairs and correspondences of a cross product of headings, altitude ratios and prior offsets, under the exact transform.

    Points come from integer arithmetic on their number, so the same in any engine;
    true_scale and yaw are kept in the pairs for the metrics.
    """
    axes = [spark.createDataFrame([(v,) for v in values], f"{name} double") for name, values in (("yaw", map(float, yaws)), ("ratio", ratios), ("offset_m", offsets))]
    grid = axes[0].crossJoin(axes[1]).crossJoin(axes[2])
    specs = grid.selectExpr("cast(row_number() over (order by yaw, ratio, offset_m) - 1 as bigint) frame_id", "*")
    mpp = geo.ground_mpp(lat=F.lit(lat), zoom=F.lit(mpp_zoom))
    la, lo = geo.offset(lat=F.lit(lat), lon=F.lit(lon), distance_m="offset_m", bearing_deg=F.lit(90.0))
    altitude = 0.2 * focal_px
    specs = specs.withColumn("true_scale", F.lit(altitude) * F.col("ratio") / focal_px / mpp)
    pairs = specs.select(
        "*", la.alias("ref_lat"), lo.alias("ref_lon"), F.lit(mpp_zoom).alias("zoom"), la.alias("prior_lat"), lo.alias("prior_lon"), F.lit(200.0).alias("sigma_m"), F.lit(altitude).alias("altitude_m"), F.lit(100.0).alias("altitude_sigma_m"),
        F.lit(lat).alias("true_lat"), F.lit(lon).alias("true_lon"),
    )
    g = geo.Georef(F.col("ref_lon"), F.col("ref_lat"), F.col("zoom"), F.lit(window_px), F.lit(window_px))
    tx, ty = g.to_pixel(lon="true_lon", lat="true_lat")
    p = pairs.withColumn("cx", tx).withColumn("cy", ty).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))))
    p = p.withColumn("qx", F.expr(f"cast((i * 389 + 17) % {size} as double)")).withColumn("qy", F.expr(f"cast((i * 631 + 91) % {size} as double)"))
    t, c = F.radians("yaw"), (size - 1) / 2
    dx, dy = F.col("qx") - c, F.col("qy") - c
    corr = p.select("frame_id", "i", "qx", "qy", (F.col("true_scale") * (F.cos(t) * dx - F.sin(t) * dy) + F.col("cx")).alias("rx"), (F.col("true_scale") * (F.sin(t) * dx + F.cos(t) * dy) + F.col("cy")).alias("ry"))
    return pairs, corr


def exact_matcher(truth: DataFrame, *, width: int, height: int, focal_px: float, points: int = 60):
    """A matcher for fine_pass() that knows the truth (frame_id, true_lat, true_lon, true_altitude_m, true_yaw_deg): exact points of the frame that fall into the window."""

    def match(windows: DataFrame) -> DataFrame:
        w = windows.select("frame_id", "cell_id", "lat", "lon", "z_fine", "window_px").join(truth, "frame_id")
        g = geo.Georef(F.col("lon"), F.col("lat"), F.col("z_fine"), F.col("window_px"), F.col("window_px"))
        tx, ty = g.to_pixel(lon="true_lon", lat="true_lat")
        p = w.withColumn("cx", tx).withColumn("cy", ty).withColumn("s", F.col("true_altitude_m") / focal_px / g.mpp).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))))
        p = p.withColumn("qx", F.expr(f"cast((i * 389 + 17) % {width} as double)")).withColumn("qy", F.expr(f"cast((i * 631 + 91) % {height} as double)"))
        t, dx, dy = F.radians("true_yaw_deg"), F.col("qx") - (width - 1) / 2, F.col("qy") - (height - 1) / 2
        rx, ry = F.col("s") * (F.cos(t) * dx - F.sin(t) * dy) + F.col("cx"), F.col("s") * (F.sin(t) * dx + F.cos(t) * dy) + F.col("cy")
        corr = p.select("frame_id", "cell_id", "i", "qx", "qy", rx.alias("rx"), ry.alias("ry"), "window_px")
        return corr.filter("rx between -0.5 and window_px - 0.5 and ry between -0.5 and window_px - 0.5").drop("window_px")

    return match


def sample_metrics(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(frame_id, localized, center_error_m, center_error_px, heading_error_deg, scale_error_pct), null where there is no pose."""
    j = results.join(truth.select("frame_id", "true_lat", "true_lon", "yaw", "true_scale", "zoom"), "frame_id")
    e = geo.haversine(lat1="true_lat", lon1="true_lon", lat2="lat", lon2="lon")
    return j.select(
        "frame_id", (F.col("status") != "not_localized").alias("localized"), e.alias("center_error_m"), (e / geo.ground_mpp(lat="true_lat", zoom="zoom")).alias("center_error_px"),
        F.abs(geo.wrap_deg(F.col("heading_deg") - F.col("yaw"))).alias("heading_error_deg"), (100 * (F.col("scale") / F.col("true_scale") - 1)).alias("scale_error_pct"),
    )


def negatives_around(cases: DataFrame, distances_m=(300.0, 600.0, 1200.0), bearings_deg=(0.0, 90.0, 180.0, 270.0)) -> DataFrame:
    """(case, lat, lon, distance_m, bearing_deg, label): each case's own place, labelled 1, and places at every distance and bearing from it, labelled 0."""
    at = F.explode(F.array(*(F.struct(F.lit(float(d)).alias("distance_m"), F.lit(float(b)).alias("bearing_deg")) for d in distances_m for b in bearings_deg)))
    c = cases.filter("lat is not null and lon is not null").select("case", "lat", "lon")
    lat, lon = geo.offset(lat="lat", lon="lon", distance_m="distance_m", bearing_deg="bearing_deg")
    wrong = c.withColumn("at", at).select("case", "lat", "lon", "at.distance_m", "at.bearing_deg").select("case", lat.alias("lat"), lon.alias("lon"), "distance_m", "bearing_deg", F.lit(0).alias("label"))
    right = c.select("case", "lat", "lon", F.lit(0.0).alias("distance_m"), F.lit(0.0).alias("bearing_deg"), F.lit(1).alias("label"))
    return right.unionByName(wrong)


def sweep(spark, **axes) -> DataFrame:
    """Every combination of the axes' values as a row (run, axis…), numbered in the order of the axes: what benches, ladders, comparisons and probes run over."""
    out = None
    for k, (name, values) in enumerate(axes.items()):
        values = list(values)
        kind = {bool: "boolean", int: "bigint", float: "double", str: "string"}[type(values[0])]
        axis = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"_{k} int, `{name}` {kind}")
        out = axis if out is None else out.crossJoin(axis)
    order = ", ".join(f"_{k}" for k in range(len(axes)))
    return out.selectExpr(f"cast(row_number() over (order by {order}) - 1 as bigint) as run", *(f"`{n}`" for n in axes))


def sweep_summary(results: DataFrame, by: list[str], error: str = "error_m", within_m: float = 50.0) -> DataFrame:
    """(by…, n, localized, share, median_error, correct): how each setting of a sweep did, of results (by…, localized, error)."""
    g = results.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("localized")).alias("localized"), F.percentile(F.when(F.col("localized"), F.col(error)), 0.5).alias("median_error"), F.count_if(F.col("localized") & (F.col(error) <= within_m)).alias("correct")
    )
    return g.select(*by, "n", "localized", (F.col("localized") / F.col("n")).alias("share"), "median_error", "correct")


def hard_negatives(candidates: DataFrame, true_m: float = 50.0, false_m: float = 150.0, most: int = 3) -> DataFrame:
    """Calibration labels of candidates (frame_id, rank, distance_m): 1 within true_m, 0 from false_m on for the first few by rank, the band between left out."""
    label: Column = F.when(F.col("distance_m") <= true_m, 1).when(F.col("distance_m") >= false_m, 0)
    c = candidates.withColumn("label", label).filter("label is not null")
    return c.selectExpr("*", "row_number() over (partition by frame_id, label order by rank) as __n").filter((F.col("label") == 1) | (F.col("__n") <= most)).drop("__n")
